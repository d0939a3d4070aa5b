"""Registered queries against the same rows in SQL, whole runs from files, streams."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from beamloom.config import Config
from beamloom.plans import pipeline
from beamloom.plans.registry import QUERIES
from beamloom.sources import tables
from beamloom.streaming import live

NAMES = [n for n, (_, sql) in QUERIES.items() if sql]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted(repr(tuple(float(v) + 0.0 if type(v).__name__ in ("float", "Decimal") else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, sf_dir, con, name):
    query, sql = QUERIES[name]
    got = query(spark, sf_dir)
    assert sorted(got.columns) == sorted(con.sql(sql).columns)
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({sql})").fetchall()
    assert _plain(map(tuple, got.select(*sorted(got.columns)).collect())) == _plain(want)


def _runs(dead, least):
    """Runs of live rows; runs of up to two rows take in the next one, then those shorter than ``least`` go to the one before."""
    out, begin = [], None
    for i, d in enumerate([*dead, True]):
        if not d and begin is None:
            begin = i
        elif d and begin is not None:
            if out and out[-1][1] - out[-1][0] <= 2:
                out[-1][1] = i
            else:
                out.append([begin, i])
            begin = None
    kept = []
    for s, e in out:
        if kept and least > 1 and (e - s < least or kept[-1][1] - kept[-1][0] < least):
            kept[-1][1] = e
        else:
            kept.append([s, e])
    return kept


def _signal(con, acq):
    """Live rows of one acquisition as columns, and their metric."""
    q = f"select row_idx, t, a, b, case when channel > 0 then channel else 1.0 end w, fit_a from ({tables.ACQ_SQL}) where acq_id = {acq} and a is not null and b is not null order by row_idx"
    c = con.sql(q).fetchnumpy()
    n = min(15, len(c["t"]))
    mean = lambda v: np.convolve(v, np.ones(n) / n, mode="full")[(n - 1) // 2 : (n - 1) // 2 + len(v)]
    return c, np.sqrt(c["w"] / mean(c["w"]) * c["fit_a"] / mean(c["fit_a"]))


def _ratio(metric, n_plan, least):
    grid = np.linspace(0.48, 0.85, 49)
    counts = [len(_runs(metric <= r, least)) for r in grid]
    off = [abs(k - n_plan) for k in counts]
    best = grid[off.index(min(off))]
    above, below = [i for i, k in enumerate(counts) if k >= n_plan], [i for i, k in enumerate(counts) if k <= n_plan]
    if min(off) and above and below and above[0] > below[-1] and counts[above[0]] != counts[below[-1]]:
        i, j = above[0], below[-1]
        best = grid[j] + (n_plan - counts[j]) / (counts[i] - counts[j]) * (grid[i] - grid[j])
    return min(max(best, 0.48), 0.85)


class _Spans:
    """Spans of rows, merged, refined and split by plain loops over all of them."""

    def __init__(self, c, metric, plan, spans):
        self.c, self.plan, self.spans = c, plan, spans
        self.on = np.maximum(c["w"], 1e-18) * (metric >= 0.45)

    def centre(self, s, e):
        w = self.on[s:e]
        return (self.c["b"][s:e] @ w / w.sum(), self.c["a"][s:e] @ w / w.sum()) if e > s and w.sum() > 0 else (self.c["b"][s], self.c["a"][s])

    def away(self, s, e, k):
        x, y = self.centre(s, e)
        return (x - self.plan[k][0]) ** 2 + (y - self.plan[k][1]) ** 2

    def refine(self, n):
        if n < 2 or len(self.plan) < n:
            return
        for _ in range(4):
            moved = False
            for i in range(n - 1):
                (s0, e0), (s1, e1) = self.spans[i], self.spans[i + 1]
                low, high = max(s0 + 1, e0 - 32, s1 - 32), min(e1 - 1, e0 + 32, s1 + 32)
                if e1 <= s0 + 1 or high <= low:
                    continue
                fit = lambda k, i=i, s0=s0, e1=e1: self.away(s0, k, i) + self.away(k, e1, i + 1)
                best, cut = fit(e0), e0
                for k in range(low, high + 1):
                    if (f := fit(k)) < best - 1e-9:
                        best, cut = f, k
                if cut != e0:
                    self.spans[i][1] = self.spans[i + 1][0] = cut
                    moved = True
            if not moved:
                break

    def merge(self, n):
        def stats(s, e):
            w = self.c["w"][s:e]
            return [self.c["a"][s:e] @ w / w.sum(), self.c["b"][s:e] @ w / w.sum(), w.sum()]

        means = [stats(s, e) for s, e in self.spans]

        def cost(i):
            (s0, e0), (s1, e1) = self.spans[i : i + 2]
            signal = (means[i][0] - means[i + 1][0]) ** 2 + (means[i][1] - means[i + 1][1]) ** 2 + 50 * max(0.0, self.c["t"][s1] - self.c["t"][e0 - 1]) ** 2
            if i + 1 >= len(self.plan):
                return signal
            w0, w1 = self.on[s0:e0].sum(), self.on[s1:e1].sum()
            p, q = self.centre(s0, e0), self.centre(s1, e1)
            m = [(p[k] * w0 + q[k] * w1) / (w0 + w1) for k in (0, 1)] if w0 + w1 > 0 else p
            return 0.65 * min((m[0] - x) ** 2 + (m[1] - y) ** 2 for x, y in self.plan[i : i + 2]) + 0.35 * signal

        bids = [(cost(i), i) for i in range(len(self.spans) - 1)]
        while len(self.spans) > n and bids:
            called = min(bids)
            bids.remove(called)
            i = called[1]
            if i >= len(self.spans) - 1:
                continue
            if (now := cost(i)) > called[0] + 1e-12:
                bids.append((now, i))
                continue
            self.spans[i] = [self.spans[i][0], self.spans.pop(i + 1)[1]]
            (a, b, w), (a1, b1, w1) = means[i], means.pop(i + 1)
            means[i] = [(a * w + a1 * w1) / (w + w1), (b * w + b1 * w1) / (w + w1), w + w1]
            bids += [(cost(j), j) for j in (i - 1, i) if 0 <= j < len(self.spans) - 1]

    def expand(self, n):
        """Edge i is the largest of what earlier edges and its own share ask for, as far as there is room for those after it."""
        weights = [self.on[s:e].sum() for s, e in self.spans]
        k, total, at = len(weights), sum(weights), np.cumsum(weights)
        share = [0, *[int((at <= total * j / k).sum()) for j in range(1, k)]]
        edges = [*[min(max(share[j] + i - j for j in range(i + 1)), n - k + i) for i in range(k)], n]
        out = []
        for (s, e), parts in zip(self.spans, np.diff(edges), strict=True):
            even = [int(s + (e - s) * j / parts) for j in range(parts)]
            cuts = [*[min(max(even[j] + i - j for j in range(i + 1)), e) for i in range(parts)], e]
            out += [[a, b if b > a else min(a + 1, e)] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.spans = out


@pytest.mark.parametrize("given", [None, (4, 0.7)])
def test_auto_episodes_like_loops(spark, sf_dir, con, given):
    """Dead ratio and episodes of all rows, with inferred and with given parameters, against plain loops."""
    if given is None:
        ratios = {r["acq_id"]: r["dead_ratio"] for r in QUERIES["dead_ratio"][0](spark, sf_dir).collect()}
        assigned = QUERIES["auto_episodes"][0](spark, sf_dir)
    else:
        config = Config(layer_mode="auto", auto_infer=False, min_episode_rows=given[0], dead_ratio=given[1])
        assigned = pipeline.run(tables.acquisition_view(spark, sf_dir), tables.plan_view(spark, sf_dir), config).assigned
    got = sorted(map(tuple, assigned.select("acq_id", "row_idx", "spot_id", "layer").collect()))
    want = []
    for (acq,) in con.sql(f"select distinct acq_id from ({tables.PLAN_SQL})").fetchall():
        plan = con.sql(f"select x, y, energy from ({tables.PLAN_SQL}) where acq_id = {acq} order by spot_idx").fetchall()
        c, metric = _signal(con, acq)
        least, ratio = given or (max(1, min(20, round(len(metric) / len(plan) * 0.03))), None)
        if ratio is None:
            ratio = ratios[acq]
            assert ratio == pytest.approx(_ratio(metric, len(plan), least), abs=1e-9)
        xy = [p[:2] for p in plan]
        spans = _Spans(c, metric, xy, _runs(metric <= ratio, least))
        spans.refine(min(len(spans.spans), len(xy)))
        if len(spans.spans) > len(xy):
            spans.merge(len(xy))
        elif len(spans.spans) < len(xy):
            spans.expand(len(xy))
        spans.refine(len(xy))
        energies = sorted({p[2] for p in plan}, reverse=True)
        order = sorted(range(len(xy)), key=lambda k: (spans.spans[k][0], k))
        for rank, k in enumerate(order):
            layer = energies.index(plan[(2 * rank + 1) * len(plan) // (2 * len(xy))][2])
            want += [(acq, i, k, layer) for i in range(*spans.spans[k])]
    assert got == sorted(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_run_files(spark, tmp_path):
    (tmp_path / "p_cube.csv").write_text("ENERGY,X_POSITION,Y_POSITION,CHARGE_REQ\n" + "".join(f"{e},{x},{y},1\n" for x, y, e in [(0, 0, 100), (5, 0, 100), (0, 5, 120), (5, 5, 120)]))
    rows = ["0.0,1,0.5,0,0,1", "0.05,1,0.5,5,0,1", "0.5,1,0.5,0,5,3", "0.6,1,0.5,0,5,5"]
    (tmp_path / "a.csv").write_text("time (s),IX512 Channel Sum (nA),Fit Amplitude A (nA),Fit Mean Position A (mm),Fit Mean Position B (mm),Gate Counter\n" + "\n".join(rows) + "\n")
    seen = []
    config = Config(flier_sigma=20.0, fine_shift=True)
    result = pipeline.run_files(spark, str(tmp_path / "a.csv"), str(tmp_path / "p_cube.csv"), config, seen.append)
    table = pipeline.export(result, config).collect()
    assert len(table) == 3 and [r["spot_index"] for r in sorted(table)] == [1, 2, 3] and seen[0] == "loading"
    assert result.missing.count() == 1 and result.delivery.filter("delivery_t is not null").count() == 3
    assert result.position_counts(config).first()["n"] == 3 and result.dose_counts(config).first()["n"] == 3
    for mode in ("time_gap", "plan_viterbi", "auto"):
        assert pipeline.run_files(spark, str(tmp_path / "a.csv"), str(tmp_path / "p_cube.csv"), Config(layer_mode=mode, flier_sigma=None)).measured.count() > 0


def test_invariants(spark, sf_dir):
    rows, plan = tables.acquisition_view(spark, sf_dir), tables.plan_view(spark, sf_dir)
    r = pipeline.run(rows, plan, Config())
    total = r.assigned.agg(F.sum("weight")).first()[0]
    assert r.measured.agg(F.sum("weight")).first()[0] == pytest.approx(total)
    c = r.position_counts(Config()).first()
    assert c["n_pass"] + c["n_warn"] + c["n_fail"] == c["n"]


def test_live(spark, sf_dir, tmp_path):
    from beamloom.operators.gaps import gap_spots

    fit = tables.acquisition_view(spark, sf_dir).filter("a is not null and b is not null").withColumns({"mx": F.col("b"), "my": F.col("a"), "layer": F.floor(F.col("spot") / 25).cast("double"), "arrived": F.timestamp_seconds(F.col("t") + 1e6)})
    for k in (1, 0):  # rows out of order over two triggers
        fit.filter(F.col("row_idx") % 2 == k).repartition(1).sortWithinPartitions(F.desc("row_idx")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fit.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told, listener = [], None
    spark.streams.addListener(listener := live.Progress(lambda *batch: told.append(batch)))
    q = live.live_gap_spots(stream, late="1000 seconds", forget_s=100.0).writeStream.format("memory").queryName("live_spots").outputMode("append").start()
    q.processAllAvailable()
    assert spark.table("live_spots").count() == 0  # all may be late yet
    after = fit.filter("row_idx = 0").withColumns({"acq_id": F.lit(99).cast("bigint"), "arrived": F.col("arrived") + F.expr("interval 2000 seconds")})
    after.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    got = {(r["acq_id"], r["row_idx"]): r["spot_id"] for r in spark.table("live_spots").collect()}
    assert got == {(r["acq_id"], r["row_idx"]): r["spot_id"] for r in gap_spots(fit).collect()}
    after.limit(1).withColumns({"acq_id": F.lit(98).cast("bigint"), "arrived": F.col("arrived") + F.expr("interval 2000 seconds")}).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # those delivered long ago are forgotten
    q.stop()
    spark.streams.removeListener(listener)
    assert sum(rows for name, _, rows, _ in told if name == "live_spots") >= fit.count()
    q = live.live_tiers(stream, tables.plan_view(spark, sf_dir)).writeStream.format("memory").queryName("live_tiers").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("live_tiers").selectExpr("sum(n_pass + n_warn + n_fail)").first()[0] == fit.count() + 2
