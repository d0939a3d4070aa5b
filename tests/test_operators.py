import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamloom import constants as K
from beamloom.functions import captions, colors, depth, scene
from beamloom.operators import alignment, assign, display, episodes, gaps, gates, grid, kernels, layers, nearest, quality, signal, spots

PLAN = "acq_id int, spot_idx bigint, x double, y double, energy double, mu double, fwhm_x double, fwhm_y double"
ROWS = "acq_id int, row_idx bigint, t double, a double, b double, channel double, fit_a double, fit_b double, sigma_a double, sigma_b double, gate int"


def plan_of(spark, points, mu=None):
    mu = mu or [1.0] * len(points)
    return spark.createDataFrame([(0, i, float(x), float(y), float(e), m, None, None) for i, ((x, y, e), m) in enumerate(zip(points, mu, strict=True))], PLAN)


def rows_of(spark, items):
    """Items (t, a, b, gate)."""
    num = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(0, i, num(t), num(a), num(b), 1.0, 0.5, None, None, None, g) for i, (t, a, b, g) in enumerate(items)], ROWS)


SMALL = [(0, 0, 100), (5, 0, 100), (0, 5, 120), (5, 5, 120)]
ACQ = [(0.0, 0, 0, 1), (0.05, 5, 0, 1), (0.5, 0, 5, 3)]


def test_layers(spark):
    plan = plan_of(spark, [(0, 0, 100), (5, 0, 100), (0, 0, 120), (0, 5, 100)])
    assert [(r["layer"], r["energy"]) for r in layers.layer_energies(plan).orderBy("layer").collect()] == [(0, 100), (1, 120), (2, 100)]
    table = layers.layer_table(plan).orderBy("layer").collect()
    assert [(r["n_spots"], r["first_slot"]) for r in table] == [(3, 0), (1, 3), (0, 4)]
    ids = spark.createDataFrame([(0, i) for i in range(6)], "acq_id int, spot_id bigint")
    got = layers.delivery_layers(ids, layers.layer_table(plan)).orderBy("spot_id").collect()
    assert [r["layer"] for r in got] == [0, 0, 0, 1, 2, 2]
    row = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0)], "acq_id int, row_idx bigint, mx double, my double, layer double")
    assert nearest.match_on_layer(row, plan).first()["distance"] == math.inf


def test_spread(spark):
    table = spark.createDataFrame([(0, i, 100.0 - i, 3, 3 * i, 1.0) for i in range(3)], "acq_id int, layer int, energy double, n_spots bigint, first_slot bigint, total_mu double")
    for n in (1, 2, 5, 9, 20):
        spans = spark.createDataFrame([(0, i, 100 - i) for i in range(n)], "acq_id int, span_id bigint, row_start bigint")
        got = {r["span_id"]: r["layer"] for r in layers.spread_layers(spans, table).collect()}
        want = [min(int(np.searchsorted(np.cumsum([3, 3, 3]) / 9, (i + 0.5) / n, side="right")), 2) for i in range(n)]
        assert [got[n - 1 - i] for i in range(n)] == want


def test_gate_counter(spark):
    got = assign.assign(rows_of(spark, ACQ), plan_of(spark, SMALL), "gate_counter").orderBy("row_idx")
    assert [(r["spot_id"], r["layer"]) for r in got.collect()] == [(0, 0), (0, 0), (1, 0)]
    assert sorted(r["spot_idx"] for r in assign.coverage(got, plan_of(spark, SMALL), "gate_counter").collect()) == [2, 3]
    m = assign.aggregate(got, None, "gate_counter").orderBy("spot_id").collect()
    assert [(r["a"], r["b"], r["weight"], r["t"]) for r in m] == [(2.5, 0.0, 2.0, 0.025), (0.0, 5.0, 1.0, 0.5)]
    matched = nearest.match_on_layer(spots.weighted_spots(got).withColumns({"mx": F.col("b"), "my": F.col("a")}), plan_of(spark, SMALL))
    assert sorted(r["distance"] for r in matched.collect()) == [0.0, 2.5]


def test_gate_phases(spark):
    gate = [2, 1, 1, 2, 3, 3, 5, -1, 5, 4, 7]
    got = gates.gate_phase_spots(rows_of(spark, [(i, 0, 0, g) for i, g in enumerate(gate)])).orderBy("row_idx").collect()
    assert [r["phase_id"] for r in got] == [-1, 0, 0, -1, 1, 1, 2, -1, 2, -1, 3]


def test_gate_phases_like_a_loop(spark):
    rng = random.Random(4)
    gate = [rng.choice([-1, 1, 1, 2, 3, 4, 5, None]) for _ in range(300)]
    want, before, n = [], None, 0
    for g in gate:
        if g is None or g < 0:
            want.append(-1)
            continue
        if before is not None and before % 2 == 1 and (g % 2 == 0 or g != before):
            n += 1
        want.append(n if g % 2 == 1 else -1)
        before = g
    got = gates.gate_phase_spots(rows_of(spark, [(i, 0, 0, g) for i, g in enumerate(gate)])).orderBy("row_idx").collect()
    assert [r["phase_id"] for r in got] == want


def test_time_gap(spark):
    got = assign.assign(rows_of(spark, ACQ), plan_of(spark, SMALL), "time_gap").orderBy("row_idx").collect()
    assert [(r["spot_id"], r["layer"]) for r in got] == [(0, 0), (0, 0), (1, 0)]
    free = gaps.assign_by_gap(rows_of(spark, ACQ), None).orderBy("row_idx").collect()
    assert [r["layer"] for r in free] == [0, 0, 1]
    near = gaps.gap_spots(spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 5.0, 1.0, 1.0), (0, 2, 9.0, 9.0, 1.0)], "acq_id int, row_idx bigint, t double, mx double, my double"))
    assert [r["spot_id"] for r in near.orderBy("row_idx").collect()] == [0, 0, 1]


def test_time_gap_like_a_loop(spark):
    rng = random.Random(7)
    points = [(5 * (i % 3), 5 * (i // 3 % 3), 150 - 10 * (i // 9)) for i in range(45)]
    items, t = [], 0.0
    for _ in range(200):
        t += rng.choice([0.01, 0.01, 0.3])
        items.append((t, rng.uniform(-3, 13) + rng.choice([0, 0, 40]), rng.uniform(-3, 13), None))
    by_layer = [[(x, y) for x, y, e in points if e == 150 - 10 * k] for k in range(5)]
    dist = lambda k, p: min(math.hypot(x - p[0], y - p[1]) for x, y in by_layer[k])
    want, spot, layer, before = [], 0, 0, None
    for tt, a, b, _ in items:
        if before and tt - before[0] >= 0.2 and math.hypot(b - before[1], a - before[2]) > 3:
            spot += 1
            if layer < 4:
                stay, step = dist(layer, (b, a)), dist(layer + 1, (b, a))
                layer += stay > 35 or not (step > stay + 5 or step > 1.4 * max(stay, 1))
        want.append((spot, layer))
        before = (tt, b, a)
    got = assign.assign(rows_of(spark, items), plan_of(spark, points), "time_gap").orderBy("row_idx").collect()
    assert [(r["spot_id"], r["layer"]) for r in got] == want


def test_viterbi_like_a_table(spark):
    """Many small acquisitions with whole coordinates, so that ties are many: some with a layer without spots, one with a row
    without a position. Against the table of all costs, row by row."""
    rng = np.random.default_rng(1)
    plan, rows, want = [], [], {}
    for acq in range(60):
        m, n = int(rng.integers(1, 6)), int(rng.integers(1, 14))
        energies = [100.0 + k for k in range(m)]
        if acq % 10 == 3 and m > 2:
            energies[2] = energies[0]  # comes back: the third layer has no spots of its own
        points = [[(int(rng.integers(0, 4)), int(rng.integers(0, 4))) for _ in range(int(rng.integers(1, 4)))] for _ in range(m)]
        flat = [(float(x), float(y), e) for e, layer in zip(energies, points, strict=True) for x, y in layer]
        plan += [(acq, i, *p, 1.0, None, None) for i, p in enumerate(flat)]
        xy = [(int(rng.integers(0, 4)), int(rng.integers(0, 4))) for _ in range(n)]
        rows += [(acq, i, float(x), float(y)) if (acq, i) != (7, 0) else (acq, i, None, float(y)) for i, (x, y) in enumerate(xy)]
        first = [energies.index(e) for e in energies]
        emit = np.array([[min(((px - x) ** 2 + (py - y) ** 2 for px, py, e in flat if first[energies.index(e)] == k), default=np.inf) for k in range(m)] for x, y in xy])
        cost, back = np.full((n, m), np.inf), np.zeros((n, m), int)
        cost[0, 0] = emit[0, 0]
        for i in range(1, n):
            for k in range(m):
                stay, up = cost[i - 1, k], cost[i - 1, k - 1] + 2.0 if k else np.inf
                back[i, k] = k if stay <= up else k - 1
                cost[i, k] = emit[i, k] + min(stay, up)
        k = int(cost[-1].argmin())
        for i in range(n - 1, -1, -1):
            want[acq, i] = 0 if acq == 7 else k
            k = back[i, k]
    frame = spark.createDataFrame(rows, "acq_id int, row_idx bigint, mx double, my double")
    got = episodes.cheapest_layers(frame, spark.createDataFrame(plan, PLAN), 2.0)
    assert {(r["acq_id"], r["row_idx"]): r["layer"] for r in got.collect()} == want and got.columns == [*frame.columns, "layer"]


def test_episode_counts_like_folds(spark):
    """The number of episodes for every ratio, without a fold, against the folds; metrics on and beside the ratios."""
    rng, ratios, rows = np.random.default_rng(9), episodes.dead_ratios(), []
    signals = {}
    for acq in range(40):
        n = int(rng.integers(1, 60))
        metric = np.where(rng.random(n) < 0.3, rng.choice(ratios, n), rng.uniform(0.4, 0.95, n)) if acq % 4 else np.full(n, (0.1, 0.9)[acq % 8 // 4])
        signals[acq] = metric, int(rng.integers(1, 9))
        rows += [(acq, i, float(m), signals[acq][1]) for i, m in enumerate(metric)]
    got = episodes.episode_counts(spark.createDataFrame(rows, "acq_id int, row_idx bigint, metric double, min_rows int")).collect()
    found = {(r["acq_id"], r["k"]): r["count"] for r in got}
    for acq, (metric, least) in signals.items():
        assert [found.get((acq, k), 0) for k in range(len(ratios))] == [len(kernels.segment(metric <= r, least)) for r in ratios]
    assert sum(found.values()) > 1000


def test_nearest_like_all_pairs(spark):
    """Lattices, clusters with one spot far away, single spots and repeated ones; positions inside, far outside, missing."""
    rng = np.random.default_rng(11)
    plan, rows, xy = [], [], {}
    for acq in range(24):
        p = rng.integers(0, 9, (int(rng.integers(1, 60)), 2)).astype(float) * rng.choice([0.1, 1, 50], 2)
        if acq % 4 == 0:
            p[0] = 1e4
        q = np.concatenate([rng.normal(0, 300, (30, 2)), p[:5] + 0.01, p[:5], rng.uniform(-1, 10, (30, 2)), [[1e12, -1e12]]])
        layer = rng.integers(0, 2, len(p)) if acq % 3 else np.zeros(len(p), int)
        order = np.argsort(layer, kind="stable")
        p, layer = p[order], layer[order]
        plan += [(acq, i, float(x), float(y), 100.0 - int(k), 1.0, None, None) for i, ((x, y), k) in enumerate(zip(p, layer, strict=True))]
        rows += [(acq, i, float(x), float(y), float(i % 2)) for i, (x, y) in enumerate(q)] + [(acq, len(q), None, 1.0, 0.0)]
        xy[acq] = p, layer - layer[0], q
    frame, planned = spark.createDataFrame(rows, "acq_id int, row_idx bigint, mx double, my double, layer double"), spark.createDataFrame(plan, PLAN)
    every = {(r["acq_id"], r["row_idx"]): r for r in nearest.match_on_plan(frame, planned).collect()}
    own = {(r["acq_id"], r["row_idx"]): r for r in nearest.match_on_layer(frame, planned).collect()}
    emit = {(r["acq_id"], r["row_idx"]): r["emit"] for r in nearest.layer_distances(frame, planned).collect()}
    for acq, (p, layer, q) in xy.items():
        d2 = ((p[None, :, 0] - q[:, None, 0]) ** 2) + ((p[None, :, 1] - q[:, None, 1]) ** 2)
        for i in range(len(q)):
            got = every[acq, i]
            assert (got["nn_spot_idx"], got["distance"]) == (d2[i].argmin(), math.sqrt(d2[i].min()))
            k = min(i % 2, layer.max())
            of = np.flatnonzero(layer == k)
            assert own[acq, i]["nn_spot_idx"] == of[d2[i, of].argmin()] and own[acq, i]["nn_local_idx"] == d2[i, of].argmin()
            assert emit[acq, i] == [d2[i, layer == k].min() for k in range(layer.max() + 1)]
        lost = every[acq, len(q)], own[acq, len(q)]
        assert all(r["distance"] == math.inf and r["nn_local_idx"] == -1 and r["expected_x"] is None for r in lost) and not any(emit[acq, len(q)])
    assert len(every) == len(own) == len(emit) == len(rows)


def test_layer_distances_by_numpy(spark, monkeypatch):
    """Layers of few spots and of many, and without any; positions far away and beyond numbers; pieces of a row each. No row folds lists of spots."""
    from beamloom.operators.grid import Layers

    rng = np.random.default_rng(5)
    p, layer = rng.normal(0, 10, (900, 2)), np.sort(rng.choice([0, 1, 3], 900, p=[0.01, 0.09, 0.9]))
    q = np.concatenate([rng.normal(0, 10, (300, 2)), [[1e9, 3.0], [np.inf, 0.0], [np.nan, 1.0]]])
    every = ((p[:, 0] - q[:, :1]) ** 2) + ((p[:, 1] - q[:, 1:]) ** 2)
    want = np.column_stack([every[:, layer == k].min(axis=1) if k != 2 else np.full(len(q), np.nan) for k in range(4)])
    for few in (0, 5, 256, 10_000):
        monkeypatch.setattr(Layers, "FEW", few)
        assert np.array_equal(Layers(p, layer, 4).squared(q), want, equal_nan=True)
    monkeypatch.setattr(nearest, "PIECE", 1)
    rows = spark.createDataFrame([(a, i, x, 1.0) for a in (1, 2) for i, x in enumerate([0.0, 7.0, None])], "acq_id int, row_idx bigint, mx double, my double")
    plan = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 1.0, None, None), (1, 1, None, 0.0, 8.0, 1.0, None, None), (1, 2, 5.0, 1.0, 7.0, 1.0, None, None)], PLAN)
    found = nearest.layer_distances(rows, plan)
    assert {(r["acq_id"], r["row_idx"]): r["emit"] for r in found.collect()} == {(1, 0): [1.0, None, 25.0], (1, 1): [50.0, None, 4.0], (1, 2): [None] * 3, (2, 0): None, (2, 1): None, (2, 2): None}
    assert not [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "lambda" in line and "mx#" in line]


def test_viterbi(spark):
    got = assign.assign(rows_of(spark, [(t, a, b, None) for t, a, b, _ in ACQ]), plan_of(spark, SMALL), "plan_viterbi", penalty=400.0).orderBy("row_idx").collect()
    assert [(r["spot_id"], r["layer"]) for r in got] == [(0, 0), (0, 0), (0, 0)]


def test_sequential_slots():
    plan, w = np.array([[0.0, 0.0], [10.0, 0.0]]), np.ones(9)
    run = lambda x: kernels.sequential_slots(np.isnan(x), np.nan_to_num(x), np.zeros(len(x)), w[: len(x)], plan).tolist()
    nan = np.nan
    assert run(np.array([nan, 0, 20, nan, 10])) == [-1, 0, 1, -1, 1]
    assert run(np.array([0, 20, nan, 10])) == [0, 0, -1, 1]
    three = np.array([[0.0, 0], [10, 0], [20, 0]])
    x = np.array([0, nan, 10, nan, 20])
    assert kernels.sequential_slots(np.isnan(x), np.nan_to_num(x), np.zeros(5), w, three).tolist() == [0, -1, 1, -1, 2]


def test_sequential_like_a_loop():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, plan = int(rng.integers(1, 30)), rng.integers(0, 5, (int(rng.integers(1, 6)), 2)) * 10.0
        dead, x, y, w = rng.random(n) < 0.3, rng.normal(15, 15, n), rng.normal(15, 15, n), rng.random(n) + 0.1
        want, slot, broken, rows = [], 0, False, 0
        for i in range(n):
            if dead[i]:
                broken = True
                want.append(-1)
                continue
            if slot < len(plan) - 1 and broken and rows:
                back = [i]
                while len(back) < 5 and back[-1] > 0 and not dead[back[-1] - 1]:
                    back.append(back[-1] - 1)
                c = [np.average(v[back], weights=w[back]) for v in (x, y)]
                d = [((np.array(c) - plan[k]) ** 2).sum() for k in (slot, slot + 1)]
                slot += d[1] + 4 < d[0]
                broken = False
            elif slot >= len(plan) - 1:
                broken = False
            want.append(slot)
            rows += 1
        assert kernels.sequential_slots(dead, x, y, w, plan).tolist() == want


def test_spans():
    assert kernels.runs(np.array([0, 1, 1, 0, 1], bool)).tolist() == [[1, 3], [4, 5]]
    assert kernels.absorb_tiny(np.array([[0, 1], [2, 8], [9, 10]]), 2).tolist() == [[0, 8], [9, 10]]
    assert kernels.absorb_short(np.array([[0, 1], [2, 8], [9, 10], [11, 20]]), 3).tolist() == [[0, 10], [11, 20]]
    assert kernels.even_parts(0, 10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert kernels.weight_quantiles(4, 2, np.cumsum([1.0, 1, 1, 1])).tolist() == [[0, 2], [2, 4]]


def test_refine_and_counts():
    x = np.array([0.0] * 8 + [10.0] * 12)
    s = kernels.Signal(np.arange(20.0), x, np.zeros(20), np.ones(20))
    plan = np.array([[0.0, 0.0], [10.0, 0.0]])
    assert kernels.refine(s, np.array([[0, 10], [10, 20]]), plan).tolist() == [[0, 8], [8, 20]]
    ab = np.array([[0.0, 0.0], [0.0, 4.0], [0.0, 10.0]])
    got, ok = kernels.fit_count(s, np.array([[0, 4], [4, 8], [8, 20]]), ab, np.ones(3), 2, plan)
    assert ok and got.tolist() == [[0, 8], [8, 20]]
    for n in (1, 3, 7):
        got, ok = kernels.fit_count(s, np.array([[0, 20]]), np.zeros((1, 2)), np.ones(1), n, np.column_stack([np.linspace(0, 10, n), np.zeros(n)]))
        assert ok and len(got) == n and got[0, 0] == 0 and got[-1, 1] == 20 and (got[1:, 0] == got[:-1, 1]).all()
    got, ok = kernels.fit_count(s, np.array([[0, 20]]), np.zeros((1, 2)), np.ones(1), 5, None)
    assert ok and len(got) == 5
    assert not kernels.fit_count(s, np.array([[0, 20]]), np.zeros((1, 2)), np.ones(1), 21, None)[1]


def test_paths():
    plan = np.array([[0.0, 0], [5, 0], [10, 0], [15, 0]])
    assert kernels.banded_path(plan + 0.3, plan).tolist() == [0, 1, 2, 3]
    assert kernels.banded_path(np.array([[0.0, 0], [0.2, 0], [5, 0]]), plan).tolist() == [0, 0, 1]
    emit = np.array([[0.0, 0, 9, 9], [9.0, 9, 0, 0]])
    assert kernels.partition_plan(emit, 4) == [(0, 2), (2, 4)] and kernels.partition_plan(emit, 1) == []


def test_auto(spark):
    items = []
    for k in range(4):
        items += [(8, k, 100.0, 10.0)] * 8 + [(1, k, 5.0, 0.5)]
    data = [(0, i, 0.01 * i, float(k), 0.0, ch, fa, None, None, None, None) for i, (_, k, ch, fa) in enumerate(items)]
    rows = spark.createDataFrame(data, ROWS)
    plan = plan_of(spark, [(0, k, 100 - k // 2) for k in range(4)])
    got = assign.assign(rows, plan, "auto")
    m = assign.aggregate(got, plan, "auto").orderBy("spot_id").collect()
    assert len(m) == 4 and [round(r["a"]) for r in m] == [0, 1, 2, 3]
    par = episodes.auto_parameters(episodes.prepare_auto(rows, plan), plan).first()
    assert 0.48 <= par["dead_ratio"] <= 0.85 and par["penalty"] == 400 and par["min_rows"] == 1
    dead = [(0, i, 0.01 * i, None if i % 9 == 8 else 10.0 * (i // 9), None if i % 9 == 8 else 0.0, 100.0, None if i % 9 == 8 else 10.0, None, None, None, None) for i in range(36)]
    far = plan_of(spark, [(0, 10 * k, 100) for k in range(4)])
    seq = assign.assign(spark.createDataFrame(dead, ROWS), far, "auto", method="plan_sequential")
    assert [r["layer"] for r in assign.aggregate(seq, far, "auto", "plan_sequential").orderBy("spot_id").collect()] == [0.0] * 4
    with pytest.raises(ValueError):
        assign.assign(rows, plan, "auto", method="what")
    with pytest.raises(ValueError):
        assign.assign(rows, None, "gate_counter")


def test_rolling_mean_like_numpy(spark):
    for n in (1, 4, 14, 15, 40):
        ch, fa = np.random.default_rng(n).random((2, n)) + 0.5
        data = [(0, i, 0.0, 0.0, 0.0, float(ch[i]), float(fa[i]), None, None, None, None) for i in range(n)]
        got = [r["metric"] for r in signal.delivery_metric(spark.createDataFrame(data, ROWS)).orderBy("row_idx").collect()]
        w = min(15, n)
        mean = lambda v: np.convolve(v, np.ones(w) / w, mode="full")[(w - 1) // 2 : (w - 1) // 2 + n]
        assert np.allclose(got, np.sqrt(ch / mean(ch) * fa / mean(fa)))


def test_weighted_mean(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 0, 1.0), (0, 0, 1, 3.0, 4.0, 0, 3.0), (0, 1, 2, 10.0, 20.0, 1, 2.0), (0, 2, 3, 1.0, 0.0, 0, 0.0), (0, 2, 4, 2.0, 0.0, 0, 0.0), (0, -1, 5, 9.0, 9.0, 0, 9.0)], "acq_id int, spot_id bigint, row_idx bigint, a double, b double, layer int, weight double")
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("sigma_a", "sigma_b", "channel", "t")} | {"partial": F.lit(0)})
    got = spots.weighted_spots(df).orderBy("spot_id").collect()
    assert [(r["a"], r["b"]) for r in got] == [(2.5, 3.5), (10.0, 20.0), (1.5, 0.0)] and got[0]["sigma_a"] is None


def test_quality(spark):
    plan = plan_of(spark, [(0, 0, 100), (10, 0, 100), (20, 0, 100)], [10.0, 20.0, 70.0])
    rows = spark.createDataFrame([(0, i, float(10 * i), 0.0, 0.0, w, None) for i, w in enumerate([11.0, 19.0, 70.0])], "acq_id int, row_idx bigint, mx double, my double, layer double, weight double, channel double")
    d = quality.dose_fractions(rows, plan).orderBy("row_idx").collect()
    assert [round(r["plan_fraction"], 6) for r in d] == [0.1, 0.2, 0.7] and [round(r["deviation_pp"], 6) for r in d] == [1, 1, 0]
    c = quality.merged_dose_counts(quality.dose_fractions(rows, plan), 0.5, 1.5).first()
    assert (c["n_pass"], c["n_warn"], c["n_fail"]) == (1, 2, 0)
    t = spark.createDataFrame([(0, v) for v in (-4.0, -2.0, 0.0, 2.0, 4.0, None)], "acq_id int, signed_pp double")
    assert quality.dose_counts(t, 1, 3).first()[1:6] == (1, 1, 1, 1, 1)
    p = spark.createDataFrame([(0, v) for v in (0.5, 1.0, 2.0, 3.0, 3.1, None, math.inf)], "acq_id int, distance double")
    assert quality.position_counts(p).first()[1:4] == (2, 3, 2)
    with pytest.raises(ValueError):
        quality.position_counts(p, 3, 1)


def test_fliers_and_imputation(spark):
    row = spark.createDataFrame([(0, 0, 3.0, 0.0, 0.0, 1.0, 1.0)], "acq_id int, row_idx bigint, mx double, my double, layer double, sigma_a double, sigma_b double")
    plan = plan_of(spark, [(0, 0, 100)])
    assert nearest.filter_fliers(row, plan, 3.0).count() == 1 and nearest.filter_fliers(row, plan, 2.9).count() == 0 and nearest.filter_fliers(row, plan, 0).count() == 1
    part = spark.createDataFrame([(0, 0, 4.0, None), (0, 1, None, 4.9), (0, 2, None, None), (0, 3, 1.0, 1.0)], "acq_id int, row_idx bigint, mx double, my double")
    got = nearest.impute_axes(part, plan_of(spark, SMALL)).orderBy("row_idx").collect()
    assert [(r["mx"], r["my"]) for r in got] == [(5.0, 0.0), (0.0, 5.0), (0.0, 0.0), (1.0, 1.0)]


def test_rigid(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 20, (40, 2))
    r = alignment.Rigid(22.0, 4.0, -3.0)
    c, s = math.cos(math.radians(22)), math.sin(math.radians(22))
    p = m @ np.array([[c, s], [-s, c]]) + [4, -3]
    pairs = spark.createDataFrame([(0, *map(float, (*a, *b))) for a, b in zip(m, p, strict=True)], "acq_id int, mx double, my double, px double, py double")
    got = alignment.rigid_sums(pairs).first()
    assert got["theta_deg"] == pytest.approx(22) and (got["tx"], got["ty"]) == pytest.approx((4, -3)) and got["rms"] < 1e-6
    x, y = r.columns(F.col("mx"), F.col("my"))
    back = r.inverse(F.col("px"), F.col("py"))
    assert pairs.select(F.max(F.abs(x - F.col("px")) + F.abs(y - F.col("py")) + F.abs(back[0] - F.col("mx")) + F.abs(back[1] - F.col("my")))).first()[0] < 1e-9


def test_coarse(spark):
    """One acquisition turned, one mirrored, one without positions."""
    plan = np.random.default_rng(8).uniform(-60, 60, (40, 2))
    c, s = math.cos(math.radians(-22)), math.sin(math.radians(-22))
    of = {0: (plan - [4, -3]) @ np.array([[c, s], [-s, c]]), 1: plan * [-1, 1], 2: np.full((3, 2), np.nan)}
    rows = [(a, i, *(None if np.isnan(v) else float(v) for v in p)) for a, xy in of.items() for i, p in enumerate(xy)]
    planned = spark.createDataFrame([(a, i, float(x), float(y), 100.0, 1.0, None, None) for a in of for i, (x, y) in enumerate(plan)], PLAN)
    fits = {r["acq_id"]: r for r in alignment.coarse_align(spark.createDataFrame(rows, "acq_id int, row_idx bigint, mx double, my double"), planned).collect()}
    assert fits.keys() == {0, 1} and fits[0]["rms"] < 1 and fits[1]["rms"] < 0.2
    assert all(f["n_pairs"] == f["n_fit"] == 40 and 1 <= f["iterations"] <= K.ICP_ITERATIONS for f in fits.values())
    for a, f in fits.items():
        back = of[a] @ np.array([[f["m11"], f["m12"]], [f["m21"], f["m22"]]]).T + [f["t1"], f["t2"]]
        d2 = ((back[:, None] - plan[None]) ** 2).sum(axis=2).min(axis=1)
        assert f["rms"] == pytest.approx(math.sqrt(d2.mean()), abs=1e-9)


def _moments(m, p, w):
    row = {"w": w.sum(), "pp": (w[:, None] * p * p).sum()}
    for (a, u), (b, v) in [((a, u), (b, v)) for a, u in (("x", m[:, 0]), ("y", m[:, 1])) for b, v in (("x", m[:, 0]), ("y", m[:, 1]), ("p", p[:, 0]), ("q", p[:, 1]))]:
        row[a + b] = (w * u * v).sum()
    row |= {c: (w * u).sum() for c, u in zip("xypq", (*m.T, *p.T), strict=True)}
    return alignment.Moments.of({f"s_{c}": v for c, v in row.items()})


def test_fit_by_moments():
    """The least-squares fit of noisy pairs: no small change of a parameter is better, and the moments give its residual."""
    rng = np.random.default_rng(3)
    m, w = rng.normal(0, 40, (60, 2)), rng.uniform(0.1, 2, 60)
    truth = alignment.Similarity(3.0, 1.5, -2.0, 1.03, 0.98).matrix()
    p = m @ truth[:, :2].T + truth[:, 2] + rng.normal(0, 0.5, m.shape)
    rms = lambda f: float(np.sqrt((w * ((m @ f.matrix()[:, :2].T + f.matrix()[:, 2] - p) ** 2).sum(axis=1)).sum() / w.sum()))
    for parts in ((True, True, True), (True, False, False), (False, True, False), (True, True, False), (False, False, True)):
        g = _moments(m, p, w)
        fit = alignment.fit_similarity(g, 60, *parts)
        assert g.rms(fit.matrix()) == pytest.approx(rms(fit), abs=1e-9)
        names = [n for n, on in zip((("tx", "ty"), ("theta_deg",), ("sx", "sy")), parts, strict=True) if on]
        for name in sum(names, ()):
            for step in (-0.05, 0.05):
                moved = alignment.replace(fit, **{name: getattr(fit, name) + step * (0.1 if name[0] == "s" else 1)})
                assert rms(moved) > rms(fit) - 1e-5
    assert _moments(m, p, w).against(truth).rms(truth) < 1e-6
    one = alignment.fit_similarity(_moments(np.array([[1.0, 2.0]]), np.array([[3.0, 5.0]]), np.ones(1)), 1)
    assert (one.theta_deg, one.tx, one.ty, one.sx) == (0.0, 2.0, 3.0, 1.0)


def test_fine(spark):
    truth = alignment.Similarity(4.75, 1.625, -0.4, 1.035, 0.985)
    plan = [(-30, -30, 100), (30, -30, 100), (-30, 30, 100), (30, 30, 100)]
    inverse = []
    for x, y, _ in plan:
        c, s = math.cos(math.radians(-truth.theta_deg)), math.sin(math.radians(-truth.theta_deg))
        u, v = x - truth.tx, y - truth.ty
        inverse.append(((u * c - v * s) / truth.sx, (u * s + v * c) / truth.sy))
    rows = spark.createDataFrame([(0, i, float(y), float(x), float(x), float(y), 0.0, 1.0) for i, (x, y) in enumerate(inverse)], "acq_id int, row_idx bigint, a double, b double, mx double, my double, layer double, weight double")
    out, fits = alignment.fine_align(rows, plan_of(spark, plan))
    fit = fits.first()
    assert abs(fit["theta_deg"] - truth.theta_deg) < 0.22 and abs(fit["sx"] - truth.sx) < 0.15 and abs(fit["tx"] - truth.tx) < 0.2 and fit["rms_after"] < 0.2
    assert alignment.residual(out, plan_of(spark, plan)).first()["rms"] < 0.2
    assert alignment.fine_align(rows, plan_of(spark, plan), False, False, False)[1] is None
    assert alignment.fine_captions(fits).first()["caption"].startswith("Fine align: ")


def _turned(points, degrees, shift):
    """Positions whose rotation by ``degrees`` and shift gives the points."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (np.asarray(points) - shift) @ np.array([[c, -s], [s, c]])


def test_alignment_is_by_acquisition(spark):
    """Acquisitions turned by +1 and -1 degree, one without positions, one without a plan."""
    points = np.random.default_rng(6).uniform(-30, 30, (40, 2)).tolist()
    turns = {0: (1.0, (0.3, -0.2)), 1: (-1.0, (-0.1, 0.4))}
    plan = spark.createDataFrame([(a, i, x, y, 100.0, 1.0, None, None) for a in (0, 1, 2) for i, (x, y) in enumerate(points)], PLAN)
    data = [(a, i, float(y), float(x), 0.0, 1.0) for a, (d, t) in turns.items() for i, (x, y) in enumerate(_turned(points, d, t))]
    data += [(2, 0, None, None, 0.0, 1.0), (3, 0, 1.0, 2.0, 0.0, 1.0)]
    rows = spark.createDataFrame(data, "acq_id int, row_idx bigint, a double, b double, layer double, weight double").selectExpr("*", "b mx", "a my")
    for out, fits in (alignment.fine_align(rows, plan), (alignment.apply(rows, whole := alignment.coarse_align(rows, plan)), whole)):
        found = {r["acq_id"]: r for r in fits.collect()}
        assert found.keys() == {0, 1}
        for a, (d, t) in turns.items():
            c, s = math.cos(math.radians(d)), math.sin(math.radians(d))  # an orientation and a rotation may make the same map
            assert [found[a][k] for k in alignment.AFFINE] == pytest.approx([c, -s, s, c, *t], abs=2e-3)
        assert out.columns == rows.columns and out.count() == len(data)
        rms = {r["acq_id"]: r["rms"] for r in alignment.residual(out, plan).collect()}
        assert rms[0] < 2e-3 and rms[1] < 2e-3 and rms[2] is None
        assert [r["mx"] for r in out.filter("acq_id = 3").collect()] == [2.0]
    captions_ = {r["acq_id"]: r["caption"] for r in alignment.total_captions(rows, alignment.apply(rows, whole), whole, None).collect()}
    assert captions_.keys() == {0, 1} and all(c.startswith("Total align: ") for c in captions_.values())


def test_grid_like_all_pairs():
    rng = np.random.default_rng(11)
    for _ in range(60):
        p = rng.integers(0, 9, (int(rng.integers(1, 40)), 2)).astype(float) * rng.choice([0.1, 1, 50], 2)
        q = np.concatenate([rng.normal(0, 100, (30, 2)), p[:5] + 0.01, p[:5], rng.uniform(-1, 10, (30, 2))])
        d2 = ((q[:, None] - p[None]) ** 2).sum(axis=2)
        at, found = grid.Spots(p).nearest(q)
        assert (at == d2.argmin(axis=1)).all() and (found == d2.min(axis=1)).all()


def test_depth(spark):
    table = {10: 1.23, 50: 22.27, 70: 40.80, 100: 77.18, 150: 157.70, 200: 259.60, 230: 329.50, 350: 662.80, 72.5: 43.49}
    df = spark.createDataFrame([(float(e), r) for e, r in table.items()], "e double, r double")
    assert df.filter(F.abs(depth.csda_range_mm(F.col("e")) - F.col("r")) > 1e-9).count() == 0
    low, high = df.limit(1).select(depth.csda_range_mm(F.lit(5.0)), depth.csda_range_mm(F.lit(400.0))).first()
    assert 0 < low < 1.23 and high > 662.8 and depth.metric("R90 ") == "r90" and depth.metric("x") == "csda"
    assert df.limit(1).select(depth.label_at(F.lit(5.0), F.lit(0.0), F.lit(10.0), F.lit(100.0), F.lit(200.0))).first()[0] == 150
    assert depth.axis_label_count(0, 100, 5) == 11 and depth.axis_label_count(0, 1, 0) == 5
    assert depth.end_labels([(0, 1), (0, 2), (10, 4)], -10, 20) == (0.0, 6.0)
    assert depth.axis_spec([(5.0, 1.0)], True)["z_min"] == 4.5


def test_scene(spark):
    assert scene.grown(-7, 23, 10) == (-10, 30) and scene.ticks(-25, 25, 10) == (-20, -10, 10, 20) and scene.ticks(1, 1, 5) == ()
    grid = scene.plan_grid(scene.Frame(-7, 23, -4, 9, 0, 10))
    assert len(grid.major) == 2 and len(grid.minor) == 4 + 4 + 2 and len(grid.labels) == 4 + 8 + 12
    assert scene.beyond((0, 0, 0), (0, 10, 0), 4) == (0, -4, 0)
    df = spark.createDataFrame([(-25.0, 25.0), (3.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(scene.tick_column(F.col("a"), F.col("b"), 10.0)).collect()] == [[-20, -10, 10, 20], []]


def test_display(spark):
    t = spark.createDataFrame([(0, v) for v in (0.0, 0.4, 1.1, 1.9, 2.0)], "acq_id int, t double")
    pick = lambda *a: [r[0] for r in t.select(display.time_slice(F.col("t"), *a)).collect()]
    assert pick(0, 1) == [True, True, False, False, False] and pick(1, 1) == [False, False, True, True, True] and pick(1.0, -1, 0.0) == [True, True, False, False, False]
    assert display.timeline_range(t).first()[1:] == (0, 2000)
    assert colors.rgb("#22c55e") == (34, 197, 94) and colors.rgb("xyz") == (214, 39, 40)
    assert captions.timeline(75.25) == "1:15.2" and captions.timeline(math.nan) == "—" and captions.number(1234.5678) == "1235"
    assert captions.playback_start(0, 100, 2.0, 0, 150) == 150
    p = plan_of(spark, SMALL)
    assert display.crosses(p.limit(1)).count() == 2 and display.glyph_sizes(p).first()["half_x"] == K.FWHM_DEFAULT_MM / 2
    shown = display.display_plan(p, p.filter("spot_idx = 1")).orderBy("spot_idx").collect()
    assert [r["missing"] for r in shown] == [False, True, False, False] and shown[0]["scene_z"] == 120
    assert [r["value"] for r in captions.spot_details(p, "plan").filter("label = 'X'").orderBy("spot").collect()] == ["0.000 mm", "5.000 mm", "0.000 mm", "5.000 mm"]


def test_kernels_at_scale():
    """A million rows of 4000 spots, and 8000 single-row episodes merged to 6200, in seconds."""
    import time

    n, each = 4000, 251
    spots_ = np.column_stack([np.arange(n) % 50 * 5.0, np.arange(n) // 50 * 5.0])
    on = np.arange(n * each) % each != each - 1
    s = kernels.Signal(np.arange(n * each) * 0.001, np.repeat(spots_[:, 0], each), np.repeat(spots_[:, 1], each), on.astype(float))
    start = time.time()
    got, ok = kernels.fit_count(s, kernels.refine(s, kernels.segment(~on, 2), spots_), np.zeros((n, 2)), np.ones(n), n, spots_)
    assert ok and len(got) == n and time.time() - start < 30
    m, on = 8000, np.arange(16_000) % 2 == 0
    x, y = np.repeat(np.arange(m) % 50 * 5.0, 2), np.repeat(np.arange(m) // 50 * 5.0, 2)
    s, spans = kernels.Signal(np.arange(2 * m) * 0.001, x, y, on.astype(float)), kernels.runs(on)
    start = time.time()
    got, ok = kernels.fit_count(s, spans, np.column_stack([y[spans[:, 0]], x[spans[:, 0]]]), np.ones(m), 6200, np.column_stack([np.arange(6200) % 50 * 5.0, np.arange(6200) // 50 * 5.0]))
    assert ok and len(got) == 6200 and time.time() - start < 60


def test_settings_out_of_range(spark):
    from beamloom.config import Config

    plan, rows = plan_of(spark, SMALL), rows_of(spark, ACQ)
    for bad in ({"min_episode_rows": 0}, {"dead_ratio": 0.0}, {"max_points": 0}, {"layer_gap_s": 0.0}, {"penalty_mm2": -1.0}, {"auto_method": "other"}, {"layer_mode": "other"}):
        with pytest.raises(ValueError):
            Config(**bad)
    for mode, bad in (("time_gap", {"gap_s": 0.0}), ("time_gap", {"tolerance_mm": -1.0}), ("plan_viterbi", {"penalty": -1.0}), ("auto", {"min_rows": 0}), ("auto", {"min_rows": 1, "dead_ratio": 0.0}), ("auto", {"method": "other"})):
        with pytest.raises(ValueError):
            assign.assign(rows, plan, mode, **bad)
    for mode in ("gate_counter", "plan_viterbi", "auto"):
        with pytest.raises(ValueError):
            assign.assign(rows, None, mode)


def test_quantile_spans_like_arrays(spark):
    """Shares of the weight by windows, against the kernel: weights of 0, few rows, fewer rows than spots, no weight at all."""
    rng, rows, plan, want = np.random.default_rng(21), [], [], {}
    for acq in range(40):
        n, m = int(rng.integers(1, 30)), int(rng.integers(1, 12))
        w = rng.choice([0.0, 0.0, 1.0, 3.0, 7.5], n) if acq % 5 else np.zeros(n)
        rows += [(acq, i, float(v)) for i, v in enumerate(w)]
        plan += [(acq, i, 0.0, 0.0, 100.0, 1.0, None, None) for i in range(m)]
        if n >= m:
            want |= {(acq, k): (s, e) for k, (s, e) in enumerate(kernels.weight_quantiles(n, m, np.cumsum(w)).tolist())}
    got = spots.quantile_spans(spark.createDataFrame(rows, "acq_id int, row_idx bigint, weight double"), spark.createDataFrame(plan, PLAN)).collect()
    assert {(r["acq_id"], r["span_id"]): (r["row_start"], r["row_end"]) for r in got} == want


def test_positions_between_columns_of_spots_meet_few_of_them(monkeypatch):
    """Columns of spots far apart, as those of the coarse search: a position is compared with a few spots, not with all."""
    i = np.arange(500)
    p = np.column_stack([i % 5 * 5.0 - 10, i % 25 // 5 * 5.0 - 10 + 0.4 * (i // 25)])
    q = np.random.default_rng(3).uniform(-12, 12, (3000, 2))
    sizes, squared = [], grid.Spots._squared
    monkeypatch.setattr(grid.Spots, "_squared", staticmethod(lambda *a: sizes.append(len(a[0]) * a[1].shape[-1]) or squared(*a)))
    at, found = grid.Spots(p).nearest(q)
    every = (q[:, None, 0] - p[:, 0]) ** 2 + (q[:, None, 1] - p[:, 1]) ** 2
    assert (at == every.argmin(axis=1)).all() and (found == every.min(axis=1)).all()
    assert sum(sizes) < every.size / 5


def _final_plan(found):
    found.collect()
    return found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_lists_of_spots_are_not_broadcast(spark, sf_dir):
    """They grow with the plan, and packed ones look small enough to broadcast."""
    from beamloom.functions import rows as R
    from beamloom.operators.nearest import layer_distances, match_on_layer
    from beamloom.plans.base import complete_rows
    from beamloom.sources.tables import acquisition_view, plan_view

    plan = plan_view(spark, sf_dir)
    matched = _final_plan(match_on_layer(complete_rows(spark, sf_dir), plan).select("distance"))
    joins = [line for line in matched.splitlines() if "Join" in line]
    assert not [line for line in joins if "Broadcast" in line and ("_cx" in line or "_layer" in line)]
    assert [line for line in joins if "SortMergeJoin" in line and "_all" in line]  # so long lists' rows are spread by it
    assert "BroadcastHashJoin" not in _final_plan(layer_distances(R.with_plan_axes(acquisition_view(spark, sf_dir)), plan).select("emit"))


def test_ratios_get_partitions_by_the_files(spark, sf_dir, monkeypatch):
    """A row may cross many ratios, so that their edges are many more than Spark's number of partitions is meant for."""
    from beamloom.operators.episodes import episode_counts
    from beamloom.sources import partitions

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey div 100 as acq_id", "l_orderkey * 10 + l_linenumber as row_idx", "l_tax * 10 as metric", "2 as min_rows")
    want = sorted(map(tuple, episode_counts(rows).collect()))
    monkeypatch.setattr(partitions, "SMALL", 0)
    found = episode_counts(rows)
    assert "hashpartitioning(acq_id" in (text := found._jdf.queryExecution().executedPlan().toString()) and ", 16), REPARTITION_BY_NUM" in text
    assert sorted(map(tuple, found.collect())) == want
