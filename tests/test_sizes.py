"""That work and data grow no faster than they have to: what steps compare, shuffle and broadcast."""

import re

import numpy as np

from beamloom.config import Config
from beamloom.operators import alignment, episodes, kernels, nearest, spots
from beamloom.operators.grid import Spots
from beamloom.plans import assignments, pipeline
from beamloom.sources import partitions, tables


def test_few_comparisons_for_positions_far_away(monkeypatch):
    """Positions that are turned and mirrored away from a plan meet few of its spots, and find the nearest one."""
    k = np.arange(500) // 25
    plan = np.column_stack([np.arange(500) % 5 * 5.0 + 0.37 * k * k, np.arange(500) % 25 // 5 * 5.0 + 0.4 * k])
    centred = plan - plan.mean(axis=0)
    far = np.concatenate([centred[:, ::-1] * side + plan.mean(axis=0) + move for side in ([1, -1], [-1, 1]) for move in ([0.3, 0.2], [-90.0, 1.7])])
    counted, squared = [], Spots._squared
    monkeypatch.setattr(Spots, "_squared", staticmethod(lambda q, x, y: counted.append(len(q) * x.shape[-1]) or squared(q, x, y)))
    at, d2 = Spots(plan).nearest(far)
    every = ((far[:, None, :] - plan) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()
    assert sum(counted) < 40 * len(far)  # of 500


def test_nearest_of_odd_lists():
    """Equal points, one point, points in a line, and positions beyond every grid."""
    rng = np.random.default_rng(5)
    at = rng.uniform(-900, 900, (400, 2))
    for points in (np.zeros((3, 2)), np.array([[1.0, 2.0]]), np.column_stack([np.arange(60.0), np.zeros(60)]), rng.integers(0, 4, (300, 2)) * 1.0, np.concatenate([rng.normal(0, 1e-3, (400, 2)), [[50.0, 50.0]]])):
        q = np.concatenate([at, at / 20, points, points + 0.5])
        got, d2 = Spots(points).nearest(q)
        every = (q[:, :1] - points[:, 0]) ** 2 + (q[:, 1:] - points[:, 1]) ** 2
        assert (got == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_by_spot_are_not_broadcast(spark):
    """Coverage and delivery times join tables as long as the plan: neither side goes through the driver."""
    plan = spark.sql("select 0 as acq_id, id as spot_idx, 1.0 as x, 2.0 as y from range(5)")
    rows = spark.sql("select 0 as acq_id, id as row_idx, id % 3 as plan_idx, 1.0 as weight, 0.5 * id as t from range(9)")
    missing, times = spots.uncovered(plan, rows), spots.delivery_times(plan, rows).filter("delivery_t is not null")
    assert sorted(r["spot_idx"] for r in missing.collect()) == [3, 4]
    assert {r["spot_idx"]: r["delivery_t"] for r in times.collect()} == {0: 1.5, 1: 2.0, 2: 2.5}
    assert "Broadcast" not in _plan_of(missing) + _plan_of(times)


def test_a_summary_assigns_rows_once(spark, sf_dir):
    assert "l_partkey" not in _plan_of(assignments.run_summary(spark, sf_dir))  # its parts start from the assigned rows


def test_edges_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Of rows that cross many ratios, the rows are shuffled, not an edge for each ratio."""
    monkeypatch.setattr(partitions, "SMALL", 0)
    spark.sql("select id % 3 as acq_id, id div 3 as row_idx, rand(7) as metric, 1 as min_rows from range(3000)").write.parquet(f"{tmp_path}/rows")
    counted = episodes.episode_counts(spark.read.parquet(f"{tmp_path}/rows"))
    above = _plan_of(counted).split("Generate")[0]
    assert "Window" in above and "Exchange" not in above
    want = {}
    for acq in range(3):
        rows = counted.sparkSession.read.parquet(f"{tmp_path}/rows").filter(f"acq_id = {acq}").orderBy("row_idx").toPandas()
        want |= {(acq, k): len(kernels.segment(rows["metric"].to_numpy() <= ratio, 1)) for k, ratio in enumerate(episodes.dead_ratios())}
    assert {(r["acq_id"], r["k"]): r["count"] for r in counted.collect()} == want


def test_a_run_reads_its_rows_once(spark, sf_dir):
    """Row numbers are given once: rows aren't joined to themselves by them, to be completed or filtered."""
    plan = _plan_of(assignments.full_run(spark, sf_dir))
    assert plan.count("l_partkey") and len([line for line in plan.splitlines() if "FileScan" in line and "l_partkey" in line]) == 1


def test_rows_of_a_run_stay_where_they_are(spark, sf_dir):
    """Rows are shuffled by acquisition, and then not before they are spots."""
    rows, plan = tables.acquisition_view(spark, sf_dir), tables.plan_view(spark, sf_dir)
    text = _plan_of(pipeline.run(rows, plan, Config(flier_sigma=3.0)).assigned)
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\), ", text)
    assert keys and not [k for k in keys if re.search("row_idx|_cx|_layer", k)], keys


def test_own_spots_of_layers(spark, monkeypatch):
    """Complete, one-axis and empty rows meet the first nearest spot of their layer, whether it is compared whole or by a grid."""
    rng = np.random.default_rng(3)
    p, layer = np.round(rng.normal(0, 9, (600, 2))), np.sort(rng.choice([0, 1, 2], 600, p=[0.02, 0.2, 0.78]))
    q, of = np.round(np.concatenate([rng.normal(0, 12, (400, 2)), [[1e9, -3.0]]]), 1), rng.integers(0, 4, 401)
    q[100:180, 0], q[150:250, 1] = np.nan, np.nan
    plan = spark.createDataFrame([(7, i, float(x), float(y), 100.0 - int(k), 1.0) for i, ((x, y), k) in enumerate(zip(p, layer, strict=True))], "acq_id int, spot_idx int, x double, y double, energy double, mu double")
    number = lambda v: None if np.isnan(v) else float(v)
    rows = spark.createDataFrame([(7, i, number(x), number(y), int(k)) for i, ((x, y), k) in enumerate(zip(q, of, strict=True))], "acq_id int, row_idx bigint, mx double, my double, layer int")
    monkeypatch.setattr(nearest, "PIECE", 64)
    got = {r["row_idx"]: r for r in nearest.impute_on_layer(rows, plan, keep_own=True).collect()}
    assert len(got) == len(q)
    for i, (x, y) in enumerate(q):
        at = np.flatnonzero(layer == of[i])
        if not len(at):
            assert (got[i]["mx"], got[i]["my"], got[i]["own"]["x"]) == (number(x), number(y), None)
            continue
        far = (p[at, 0] - x) ** 2 + (p[at, 1] - y) ** 2 if not np.isnan(x + y) else np.abs(p[at, 0] - x) if not np.isnan(x) else np.abs(p[at, 1] - y) if not np.isnan(y) else p[at, 0]
        own = tuple(p[at[far.argmin()]])
        assert (got[i]["own"]["x"], got[i]["own"]["y"]) == own and (got[i]["mx"], got[i]["my"]) == (own if np.isnan(x + y) else (x, y))


def test_starts_side_by_side(monkeypatch):
    """Starts that are fitted together end as each does alone, and look up their nearest points together."""
    rng = np.random.default_rng(9)
    plan, m = rng.uniform(-20, 20, (90, 2)), rng.uniform(-20, 20, (400, 2))
    starts = [alignment._start(m, d) for d in (0, 45, 90, 200)]
    alone = [alignment.icp(m, plan, *s) for s in starts]
    counted, lookup = [], Spots.nearest
    monkeypatch.setattr(Spots, "nearest", lambda self, q: counted.append(len(q)) or lookup(self, q))
    together = alignment.icp_starts(m, plan, starts)
    for a, b in zip(alone, together, strict=True):
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2:] == b[2:]
    assert len(counted) == max(a[4] for a in alone) < sum(a[4] for a in alone)


def test_fine_alignment_reads_written_spots(spark, sf_dir):
    """The spots are not measured again for the rows that a fit moves."""
    rows, plan = tables.acquisition_view(spark, sf_dir), tables.plan_view(spark, sf_dir)
    assert "l_partkey" not in _plan_of(pipeline.run(rows, plan, Config(fine_shift=True)).matched)
