"""Queries over whole assignment modes and alignment fits, with SQL that folds rows by recursion where order matters.

The views repeat one grid of positions on every layer. Where a rule has to tell layers or spots apart by position, the
queries move layer k of plan and rows by ``DRIFT * k * k`` along x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import rows as R
from ..operators import alignment, assign, episodes, gaps, gates, layers, nearest, signal, spots
from ..sources.tables import acquisition_view, plan_view
from ..sources.workspace import landed
from . import pipeline
from .base import SPOT, measured_spots, query, rounded, sql

DRIFT = 0.37
_PER_LAYER = 25  # spots of a layer in the views
_SHIFT = f"{DRIFT} * CAST(floor({{s}} / {_PER_LAYER}) AS DOUBLE) * CAST(floor({{s}} / {_PER_LAYER}) AS DOUBLE)"
_PLAN2 = f"SELECT * REPLACE (x + {_SHIFT.format(s='spot_idx')} AS x) FROM plan0"
_ACQ2 = f"SELECT * REPLACE (b + {_SHIFT.format(s='spot')} AS b) FROM acq0"


def _shift(c: str):
    k = F.floor(F.col(c) / _PER_LAYER).cast("double")
    return F.lit(DRIFT) * k * k


def _drifting_plan(spark, sf) -> DataFrame:
    return plan_view(spark, sf).withColumn("x", F.col("x") + _shift("spot_idx"))


def _drifting_rows(spark, sf) -> DataFrame:
    return acquisition_view(spark, sf).withColumn("b", F.col("b") + _shift("spot"))


def _drifting(*needs: str, body: str, **more) -> str:
    from .base import WITH

    first = {"plan0": WITH["plan"], "acq0": WITH["acq"], "plan": _PLAN2, "acq": _ACQ2}
    rest = {n: WITH[n] for n in needs}
    recursive, other = more.pop("recursive", False), more
    return sql(body=body, recursive=recursive, **(first | rest | other))


_WHOLE = ("plan", "acq", "layers", "pl", "gated", "whole")


@query(sql(*_WHOLE, body="SELECT acq_id, row_idx, spot_id, layer, partial, weight, round(a, 6) AS a, round(b, 6) AS b FROM whole"))
def gate_assignment(spark, sf):
    """The gate counter's mode: spots, layers, weights, one-axis rows completed on their layer."""
    got = assign.assign(acquisition_view(spark, sf), plan_view(spark, sf), "gate_counter")
    return got.select("acq_id", "row_idx", "spot_id", "layer", "partial", "weight", rounded("a").alias("a"), rounded("b").alias("b"))


_CAPPED = """
SELECT acq_id, row_idx, spot_id FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY row_idx) AS n FROM whole) WHERE n <= 500"""


@query(sql(*_WHOLE, body=_CAPPED))
def gate_max_points(spark, sf):
    """The gate counter's mode with its limit of points for each acquisition."""
    return gates.assign_by_gate(acquisition_view(spark, sf), plan_view(spark, sf), max_points=500).select("acq_id", "row_idx", "spot_id")


# Rows completed along their known axis over the whole plan, and pauses between them.
_HEALED = """
SELECT a.* EXCLUDE (a, b), CASE WHEN a.a IS NULL THEN 1 WHEN a.b IS NULL THEN 2 ELSE 0 END AS partial, a.a AS a0, a.b AS b0,
       coalesce(CASE WHEN a.a IS NULL OR a.b IS NULL THEN p.x END, a.b) AS mx, coalesce(CASE WHEN a.a IS NULL OR a.b IS NULL THEN p.y END, a.a) AS my
FROM acq a LEFT JOIN (
  SELECT * FROM (SELECT a.acq_id, a.row_idx, p.x, p.y, row_number() OVER (PARTITION BY a.acq_id, a.row_idx
                   ORDER BY CASE WHEN a.b IS NOT NULL THEN abs(p.x - a.b) ELSE abs(p.y - a.a) END, p.spot_idx) AS k
                 FROM acq a JOIN plan p ON a.acq_id = p.acq_id WHERE (a.a IS NULL) <> (a.b IS NULL)) WHERE k = 1) p
  ON a.acq_id = p.acq_id AND a.row_idx = p.row_idx
WHERE a.a IS NOT NULL OR a.b IS NOT NULL"""
_PAUSED = """
SELECT *, CAST(sum(new) OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS spot_id
FROM (SELECT *, CASE WHEN t - lag(t) OVER w >= 0.2 AND NOT sqrt((mx - lag(mx) OVER w) ** 2 + (my - lag(my) OVER w) ** 2) <= 3.0
                     THEN 1 ELSE 0 END AS new FROM healed WINDOW w AS (PARTITION BY acq_id ORDER BY row_idx))"""
_FAR = """
SELECT r.acq_id, r.spot_id, p.layer, sqrt(min((p.x - r.mx) * (p.x - r.mx) + (p.y - r.my) * (p.y - r.my))) AS d
FROM paused r JOIN pl p ON r.acq_id = p.acq_id WHERE r.new = 1 GROUP BY ALL"""
_ADVANCE = """
SELECT acq_id, CAST(0 AS BIGINT) AS spot_id, 0 AS layer FROM (SELECT DISTINCT acq_id FROM paused)
UNION ALL
SELECT s.acq_id, s.spot_id + 1, CASE WHEN n.d IS NOT NULL AND (h.d > 35 OR NOT (n.d > h.d + 5 OR n.d > 1.4 * greatest(h.d, 1.0))) THEN s.layer + 1 ELSE s.layer END
FROM step s JOIN far h ON h.acq_id = s.acq_id AND h.spot_id = s.spot_id + 1 AND h.layer = s.layer
LEFT JOIN far n ON n.acq_id = s.acq_id AND n.spot_id = s.spot_id + 1 AND n.layer = s.layer + 1"""
_GAP_LAYERS = "SELECT p.acq_id, p.row_idx, p.spot_id, s.layer FROM paused p JOIN step s USING (acq_id, spot_id)"
_GAP_PARTS = {"healed": _HEALED, "paused": _PAUSED, "far": _FAR, "step": _ADVANCE}


@query(sql("plan", "acq", "layers", "pl", body=_GAP_LAYERS, recursive=True, **_GAP_PARTS))
def time_gap_layers(spark, sf):
    """Spots by pauses and layers by plausible advances, one-axis rows completed."""
    return gaps.assign_by_gap(acquisition_view(spark, sf), plan_view(spark, sf), heal=True).select("acq_id", "row_idx", "spot_id", "layer")


@query(_drifting("layers", "pl", body=_GAP_LAYERS, recursive=True, **_GAP_PARTS))
def time_gap_drifting(spark, sf):
    """The same where layers stand apart, so that advances are refused and made up."""
    return gaps.assign_by_gap(_drifting_rows(spark, sf), _drifting_plan(spark, sf), heal=True).select("acq_id", "row_idx", "spot_id", "layer")


def _first(most: int, *needs: str, body: str, **more) -> str:
    """SQL over the first complete rows of each acquisition."""
    from .base import WITH

    capped = f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY row_idx) AS n FROM acq0 WHERE a IS NOT NULL AND b IS NOT NULL) WHERE n <= {most}"
    recursive = more.pop("recursive", False)
    return sql(body=body, recursive=recursive, **({"plan": WITH["plan"], "acq0": WITH["acq"], "acq": capped} | {n: WITH[n] for n in needs} | more))


@query(_first(700, "layers", "pl", body=_GAP_LAYERS, recursive=True, **_GAP_PARTS))
def time_gap_max_points(spark, sf):
    """Spots by pauses among the first rows of each acquisition."""
    return gaps.assign_by_gap(acquisition_view(spark, sf), plan_view(spark, sf), max_points=700).select("acq_id", "row_idx", "spot_id", "layer")


# The cheapest monotone path, layer by layer: best(k, i) = S(k, i) + min over j <= i of (best(k - 1, j - 1) + penalty - S(k, j - 1)).
_EMIT = """
SELECT r.acq_id, p.layer, row_number() OVER (PARTITION BY r.acq_id, p.layer ORDER BY r.row_idx) AS i, r.row_idx, round_even(min((p.x - r.b) * (p.x - r.b) + (p.y - r.a) * (p.y - r.a)) * 1000000, 0) AS e
FROM acq r JOIN pl p ON r.acq_id = p.acq_id WHERE r.a IS NOT NULL AND r.b IS NOT NULL GROUP BY r.acq_id, p.layer, r.row_idx"""
_SUMS = "SELECT *, sum(e) OVER (PARTITION BY acq_id, layer ORDER BY i) AS s FROM emit"
_BEST = """
SELECT acq_id, layer, i, s AS best, CAST(0 AS BIGINT) AS came FROM sums WHERE layer = 0
UNION ALL
SELECT acq_id, layer, i, s + low.v, low.j FROM (
  SELECT c.acq_id, c.layer, c.i, c.s, min({'v': b.best + 400000000.0 - (c.s - c.e), 'j': c.i}) OVER (PARTITION BY c.acq_id ORDER BY c.i) AS low
  FROM best b JOIN sums c ON c.acq_id = b.acq_id AND c.layer = b.layer + 1 AND c.i = b.i + 1)"""
_ENDS = """
SELECT acq_id, layer, i, came FROM (SELECT b.*, row_number() OVER (PARTITION BY b.acq_id ORDER BY best, b.layer) AS k
                                    FROM best b JOIN (SELECT acq_id, max(i) AS i FROM emit GROUP BY acq_id) n USING (acq_id, i)) WHERE k = 1
UNION ALL
SELECT b.acq_id, b.layer, b.i, b.came FROM ends e JOIN best b ON b.acq_id = e.acq_id AND b.layer = e.layer - 1 AND b.i = e.came - 1"""
_PATH = """
SELECT x.acq_id, x.row_idx, h.phase_id AS spot_id, x.layer FROM emit x JOIN ends d ON x.acq_id = d.acq_id AND x.layer = d.layer AND x.i <= d.i AND x.i >= d.came
JOIN phases h ON h.acq_id = x.acq_id AND h.row_idx = x.row_idx"""
_PHASES = """
SELECT acq_id, row_idx, CAST(sum(CASE WHEN g0 % 2 = 1 AND (gate % 2 = 0 OR gate <> g0) THEN 1 ELSE 0 END) OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS phase_id
FROM (SELECT *, lag(gate) OVER (PARTITION BY acq_id ORDER BY row_idx) AS g0 FROM acq WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(_drifting("layers", "pl", body=_PATH, recursive=True, emit=_EMIT, sums=_SUMS, best=_BEST, ends=_ENDS, phases=_PHASES))
def viterbi_layers(spark, sf):
    """The cheapest layer path with a penalty of 400 for each step."""
    return episodes.assign_by_path(_drifting_rows(spark, sf), _drifting_plan(spark, sf), 400.0).select("acq_id", "row_idx", "spot_id", "layer")


@query(_first(900, "layers", "pl", body=_PATH, recursive=True, emit=_EMIT, sums=_SUMS, best=_BEST, ends=_ENDS, phases=_PHASES))
def viterbi_max_points(spark, sf):
    """The same over the first rows of each acquisition, where all layers have one grid of positions."""
    return episodes.assign_by_path(acquisition_view(spark, sf), plan_view(spark, sf), 400.0, max_points=900).select("acq_id", "row_idx", "spot_id", "layer")


# Centres of delivered spots, every seventh of which is lost; the cheapest way along the plan, spot by spot.
_CENTRES = """
SELECT acq_id, CAST(row_number() OVER (PARTITION BY acq_id ORDER BY spot_id) - 1 AS BIGINT) AS i, b AS x, a AS y FROM spots WHERE spot_id % 7 <> 3"""
_PLACED = "SELECT acq_id, CAST(row_number() OVER (PARTITION BY acq_id ORDER BY spot_idx) - 1 AS BIGINT) AS j, spot_idx, x, y FROM plan"
_BAND = """
SELECT c.acq_id, c.i, p.j, (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) AS d2 FROM centres c JOIN placed p ON c.acq_id = p.acq_id AND p.j BETWEEN c.i - 80 AND c.i + 80"""
_WAYS = """
SELECT acq_id, i, j, d2 AS cost, CAST(0 AS BIGINT) AS came FROM band WHERE i = 0
UNION ALL
SELECT acq_id, i, j, d2 + best.c, best.k FROM (
  SELECT b.acq_id, b.i, b.j, b.d2, min({'c': w.cost + CASE WHEN w.j = b.j THEN 30.0 ELSE 0.0 END, 'k': w.j}) AS best
  FROM ways w JOIN band b ON b.acq_id = w.acq_id AND b.i = w.i + 1 AND w.j <= b.j AND w.j >= b.j - 80 AND w.j >= b.i - 80 GROUP BY ALL)"""
_BACK = """
SELECT acq_id, i, j, came FROM (SELECT w.*, row_number() OVER (PARTITION BY w.acq_id ORDER BY cost, j) AS k FROM ways w JOIN (SELECT acq_id, max(i) AS i FROM centres GROUP BY acq_id) USING (acq_id, i)) WHERE k = 1
UNION ALL
SELECT w.acq_id, w.i, w.j, w.came FROM back b JOIN ways w ON w.acq_id = b.acq_id AND w.i = b.i - 1 AND w.j = b.came"""


@query(sql(*SPOT, recursive=True, centres=_CENTRES, placed=_PLACED, band=_BAND, ways=_WAYS, back=_BACK, body="SELECT b.acq_id, b.i AS span_id, spot_idx FROM back b JOIN placed p USING (acq_id, j)"))
def plan_path(spark, sf):
    """The cheapest way of delivered spots along the plan, where some are missing."""
    spots_ = measured_spots(spark, sf).filter("spot_id % 7 <> 3")
    place = F.row_number().over(Window.partitionBy("acq_id").orderBy("spot_id")) - 1
    return episodes.plan_path(spots_.withColumn("span_id", place.cast("bigint")), plan_view(spark, sf), 80, 30.0)


_QUANTILES = {
    "heavy": "SELECT acq_id, row_idx, sum(CASE WHEN row_idx % 1000 < 400 THEN 0 ELSE channel END) OVER (PARTITION BY acq_id ORDER BY row_idx) AS c FROM acq",
    "wholes": "SELECT h.acq_id, max(c) AS total, count(*) AS n_rows, any_value(n) AS n FROM heavy h JOIN (SELECT acq_id, count(*) AS n FROM plan GROUP BY acq_id) p USING (acq_id) GROUP BY h.acq_id",
    "shares": "SELECT acq_id, total, n_rows, n, unnest(range(CAST(n AS BIGINT))) AS i FROM wholes",
    "counted": "SELECT s.acq_id, s.n_rows, s.n, s.i, count(h.c) FILTER (h.c <= s.total * s.i / s.n AND s.i > 0) AS at_ FROM shares s JOIN heavy h ON h.acq_id = s.acq_id GROUP BY ALL",
    "edges": "SELECT acq_id, i, n_rows, least(i + max(at_ - i) OVER (PARTITION BY acq_id ORDER BY i), n_rows - n + i) AS s FROM counted",
}


@query(sql("plan", "acq", **_QUANTILES, body="""
SELECT acq_id, i AS span_id, CAST(s AS BIGINT) AS row_start, CAST(coalesce(lead(s) OVER (PARTITION BY acq_id ORDER BY i), n_rows) AS BIGINT) AS row_end FROM edges"""))
def quantile_spans(spark, sf):
    """All rows in as many spans as spots, by weight, where 400 of every 1000 rows have none."""
    weight = F.when(F.col("row_idx") % 1000 < 400, 0.0).otherwise(F.col("channel"))
    return spots.quantile_spans(acquisition_view(spark, sf).withColumn("weight", weight), plan_view(spark, sf))


# Bursts between dead rows (here: every row whose number is a multiple of 7), and the slot of each by its first row.
_SEQ_ROWS = """
SELECT acq_id, row_idx, b AS x, a AS y, channel AS w, dead, row_number() OVER (PARTITION BY acq_id ORDER BY row_idx) - 1 AS n
FROM (SELECT *, row_idx % 7 = 0 AS dead FROM acq WHERE row_idx % 7 = 0 OR (a IS NOT NULL AND b IS NOT NULL))"""
_BURSTS = """
SELECT *, sum(CASE WHEN NOT dead AND d0 THEN 1 ELSE 0 END) OVER (PARTITION BY acq_id ORDER BY n) - 1 AS burst
FROM (SELECT *, coalesce(lag(dead) OVER (PARTITION BY acq_id ORDER BY n), true) AS d0 FROM seq)"""
_FIRSTS = """
SELECT acq_id, burst, min(n) AS n, CASE WHEN burst > 0 OR count(*) = 1 THEN first(x ORDER BY n) ELSE sum(x * w) FILTER (k < 2) / sum(w) FILTER (k < 2) END AS cx,
       CASE WHEN burst > 0 OR count(*) = 1 THEN first(y ORDER BY n) ELSE sum(y * w) FILTER (k < 2) / sum(w) FILTER (k < 2) END AS cy,
       burst > 0 OR count(*) > 1 AS decides, max(n) AS last
FROM (SELECT *, row_number() OVER (PARTITION BY acq_id, burst ORDER BY n) - 1 AS k FROM bursts WHERE NOT dead) GROUP BY acq_id, burst"""
_TURNS = """
SELECT acq_id, CAST(-1 AS BIGINT) AS burst, CAST(0 AS BIGINT) AS slot FROM (SELECT DISTINCT acq_id FROM firsts)
UNION ALL
SELECT t.acq_id, t.burst + 1, CASE WHEN f.decides AND n.x IS NOT NULL
         AND (f.cx - n.x) * (f.cx - n.x) + (f.cy - n.y) * (f.cy - n.y) + 4.0 < (f.cx - h.x) * (f.cx - h.x) + (f.cy - h.y) * (f.cy - h.y) THEN t.slot + 1 ELSE t.slot END
FROM turns t JOIN firsts f ON f.acq_id = t.acq_id AND f.burst = t.burst + 1 JOIN plan h ON h.acq_id = t.acq_id AND h.spot_idx = t.slot
LEFT JOIN plan n ON n.acq_id = t.acq_id AND n.spot_idx = t.slot + 1"""
_SEQ = """
SELECT b.acq_id, b.n AS row_idx, CASE WHEN b.burst = 0 AND b.n = f.n THEN 0 ELSE t.slot END AS spot_id, p.layer
FROM bursts b JOIN turns t USING (acq_id, burst) JOIN firsts f USING (acq_id, burst)
JOIN pl p ON p.acq_id = b.acq_id AND p.spot_idx = CASE WHEN b.burst = 0 AND b.n = f.n THEN 0 ELSE t.slot END WHERE NOT b.dead"""


@query(sql("plan", "acq", "layers", "pl", body=_SEQ, recursive=True, seq=_SEQ_ROWS, bursts=_BURSTS, firsts=_FIRSTS, turns=_TURNS))
def plan_sequential(spark, sf):
    """Plan order, where every seventh row is a dead one."""
    rows = acquisition_view(spark, sf).withColumn("fit_a", F.when(F.col("row_idx") % 7 != 0, F.col("fit_a")))
    return episodes.assign_auto(rows, plan_view(spark, sf), "plan_sequential").select("acq_id", "row_idx", "spot_id", "layer")


@query()
def auto_episodes(spark, sf):
    """Episodes of the signal; merging is a fold that tests compare with plain loops over all rows."""
    return episodes.assign_auto(acquisition_view(spark, sf), plan_view(spark, sf)).select("acq_id", "row_idx", "spot_id", "layer")


# Every row for every ratio; runs of rows above it; tiny runs joined with the next, short ones with the one before.
_SWEEP = {
    "grid": "SELECT CAST(i AS INTEGER) AS k, CASE WHEN i = 48 THEN CAST(0.85 AS DOUBLE) ELSE i * ((CAST(0.85 AS DOUBLE) - CAST(0.48 AS DOUBLE)) / 48) + CAST(0.48 AS DOUBLE) END AS r FROM range(49) t(i)",
    "sizes": "SELECT m.acq_id, greatest(1, least(20, round_even(count(*) / any_value(n_plan) * 0.03, 0))) AS least, any_value(n_plan) AS n_plan FROM metric m JOIN (SELECT acq_id, count(*) AS n_plan FROM plan GROUP BY acq_id) p USING (acq_id) GROUP BY m.acq_id",
    "marked": "SELECT acq_id, k, row_idx, row_idx - row_number() OVER (PARTITION BY acq_id, k ORDER BY row_idx) AS island FROM metric, grid WHERE metric > r",
    "runs": "SELECT acq_id, k, min(row_idx) AS s, max(row_idx) + 1 AS e, row_number() OVER (PARTITION BY acq_id, k ORDER BY min(row_idx)) AS i FROM marked GROUP BY acq_id, k, island",
    "pairs": "SELECT *, lead(e) OVER w AS e1, i - 1 - coalesce(max(CASE WHEN e - s > 2 THEN i END) OVER (PARTITION BY acq_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tiny_before FROM runs WINDOW w AS (PARTITION BY acq_id, k ORDER BY i)",
    "joined": "SELECT acq_id, k, s, CASE WHEN e - s <= 2 THEN coalesce(e1, e) ELSE e END AS e FROM pairs WHERE tiny_before % 2 = 0",
    "counts": """SELECT acq_id, k, count(*) FILTER (before IS NULL OR least <= 1 OR (before - s0 >= least AND e - s >= least)) AS n
      FROM (SELECT j.*, least, min(s) OVER (PARTITION BY acq_id, k) AS s0, lag(e) OVER (PARTITION BY acq_id, k ORDER BY s) AS before FROM joined j JOIN sizes USING (acq_id)) GROUP BY acq_id, k""",
    "fits": "SELECT z.acq_id, n_plan, least, g.k, r, coalesce(n, 0) AS n FROM sizes z CROSS JOIN grid g LEFT JOIN counts c ON c.acq_id = z.acq_id AND c.k = g.k",
    "ends": """SELECT acq_id, any_value(n_plan) AS np, any_value(least) AS least, arg_min(r, abs(n - n_plan) * 100 + k) AS best, min(abs(n - n_plan)) AS off, min(k) FILTER (n >= n_plan) AS ku, max(k) FILTER (n <= n_plan) AS kd,
      arg_min(n, k) FILTER (n >= n_plan) AS nu, arg_max(n, k) FILTER (n <= n_plan) AS nd, arg_min(r, k) FILTER (n >= n_plan) AS ru, arg_max(r, k) FILTER (n <= n_plan) AS rd FROM fits GROUP BY acq_id""",
}
_COMPLETE = "SELECT * REPLACE (row_number() OVER (PARTITION BY acq_id ORDER BY row_idx) - 1 AS row_idx) FROM acq0 WHERE a IS NOT NULL AND b IS NOT NULL"


def _sweep_sql() -> str:
    from .base import WITH

    body = "SELECT acq_id, round(CASE WHEN off > 0 AND ku > kd AND nu <> nd THEN rd + (np - nd) / (nu - nd) * (ru - rd) ELSE best END, 9) AS dead_ratio, CAST(least AS INTEGER) AS min_rows FROM ends"
    return sql(body=body, **({"plan": WITH["plan"], "acq0": WITH["acq"], "acq": _COMPLETE, "metric": WITH["metric"]} | _SWEEP))


@query(_sweep_sql())
def dead_ratio(spark, sf):
    """The calibrated ratio and the least rows of an episode."""
    plan = plan_view(spark, sf)
    got = episodes.calibrated_ratio(episodes.prepare_auto(acquisition_view(spark, sf), plan), plan)
    return got.select("acq_id", rounded("dead_ratio", 9).alias("dead_ratio"), "min_rows")


_FIT = "SELECT *, CASE WHEN channel > 0 THEN channel ELSE 1.0 END AS w FROM acq WHERE a IS NOT NULL AND b IS NOT NULL"
_PARAMETERS = """
SELECT acq_id, min_on_weight, min_rows, penalty, radius_mm2, gap_s, CAST(3.0 AS DOUBLE) AS jump_mm, 2 AS tiny_rows FROM
(SELECT acq_id, round(least(greatest(1e-12, 0.05 * quantile_cont(w, 0.01), 0.002 * quantile_cont(w, 0.5)), 0.02 * quantile_cont(w, 0.5)), 9) AS min_on_weight, count(*) AS n FROM fit GROUP BY acq_id)
JOIN (SELECT acq_id, count(*) AS np, round(power(greatest(3.0, 1.6 * quantile_cont(d, 0.5)), 2), 6) AS radius_mm2
      FROM (SELECT acq_id, nullif(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS d FROM plan WINDOW w AS (PARTITION BY acq_id ORDER BY spot_idx)) GROUP BY acq_id) USING (acq_id)
JOIN (SELECT acq_id, coalesce(greatest(400.0, least(2000.0, greatest(50.0, 1.25 * quantile_cont(d2, 0.5)))), 400.0) AS penalty
      FROM (SELECT acq_id, nullif((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2, 0) AS d2 FROM (SELECT acq_id, layer, avg(x) AS cx, avg(y) AS cy FROM pl GROUP BY ALL)
            WINDOW w AS (PARTITION BY acq_id ORDER BY layer)) GROUP BY acq_id) USING (acq_id),
LATERAL (SELECT CAST(greatest(1, least(20, round_even(n / np * 0.03, 0))) AS INTEGER) AS min_rows)
JOIN (SELECT acq_id AS g, round(greatest(0.005, least(5.0, CASE WHEN p90 - p10 < greatest(0.05 * p50, 1e-9) THEN 2.5 * p50 ELSE least(knee, span / (spots - 1) / 2, greatest(1.35 * p90, 3 * p50)) END, 8 * p50)), 6) AS gap_s
      FROM (SELECT acq_id, quantile_cont(dt, 0.5) AS p50, quantile_cont(dt, 0.1) AS p10, quantile_cont(dt, 0.9) AS p90 FROM st GROUP BY acq_id)
      JOIN (SELECT acq_id, (dt + was) / 2 AS knee FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY dt / greatest(was, 1e-12) DESC, dt) AS k
            FROM (SELECT acq_id, dt, lag(dt) OVER (PARTITION BY acq_id ORDER BY dt) AS was FROM st) WHERE was IS NOT NULL) WHERE k = 1) USING (acq_id)
      JOIN (SELECT acq_id, max(t) - min(t) AS span FROM fit GROUP BY acq_id) USING (acq_id) JOIN (SELECT acq_id, count(*) AS spots FROM plan GROUP BY acq_id) USING (acq_id)) ON g = acq_id"""
_STEPS = """
SELECT acq_id, dt
FROM (SELECT acq_id, t - lag(t) OVER (PARTITION BY acq_id ORDER BY row_idx) AS dt
FROM fit)
WHERE dt > 0"""


@query(sql("plan", "acq", "layers", "pl", body=_PARAMETERS, fit=_FIT, st=_STEPS))
def auto_parameters(spark, sf):
    """The parameters that auto mode infers, but for the dead ratio."""
    plan = plan_view(spark, sf)
    got = episodes.auto_parameters(episodes.prepare_auto(acquisition_view(spark, sf), plan), plan)
    return got.select("acq_id", rounded("min_on_weight", 9).alias("min_on_weight"), "min_rows", "penalty", rounded("radius_mm2").alias("radius_mm2"), rounded("gap_s").alias("gap_s"), "jump_mm", "tiny_rows")


# Positions that a known map brings to the plan: turned by theta, shifted, in coarse fits also mirrored or swapped.
_KNOWN_FINE = {"theta": "0.4 * ({a} % 5) - 0.8", "tx": "0.1 * ({a} % 3)", "ty": "-0.05 * ({a} % 4)"}


def _known(spark, sf, plan: DataFrame, theta: str, tx: str, ty: str) -> DataFrame:
    c, s = F.cos(F.radians(F.expr(theta))), F.sin(F.radians(F.expr(theta)))
    x, y = F.col("x") - F.expr(tx), F.col("y") - F.expr(ty)
    at = layers.with_layers(plan).select("acq_id", F.col("spot_idx").alias("row_idx"), F.col("spot_idx").alias("spot_id"), F.col("layer").cast("double").alias("layer"), (x * c + y * s).alias("mx"), (y * c - x * s).alias("my"))
    return R.with_detector_axes(at.withColumn("weight", F.lit(1.0)))


_FINE_SQL = f"SELECT acq_id, spot_idx AS spot_id, round(x, 2) + 0.0 AS mx, round(y, 2) + 0.0 AS my, round({_KNOWN_FINE['theta'].format(a='acq_id')}, 2) + 0.0 AS theta_deg FROM plan"


@query(sql("plan", body=_FINE_SQL))
def fine_align(spark, sf):
    """Each acquisition turned and shifted by its own known map, which its fit has to find."""
    plan = plan_view(spark, sf)
    rows = _known(spark, sf, plan, *[v.format(a="acq_id") for v in _KNOWN_FINE.values()])
    out, fits = alignment.fine_align(rows, plan, scale=False)
    theta = fits.select("acq_id", rounded("theta_deg", 2).alias("theta_deg"))
    return out.join(theta, "acq_id", "left").select("acq_id", "spot_id", rounded("mx", 2).alias("mx"), rounded("my", 2).alias("my"), F.coalesce("theta_deg", F.lit(0.0)).alias("theta_deg"))


@query(sql("plan", body="""
SELECT acq_id, CAST(90 * (acq_id % 4) AS DOUBLE) AS theta_deg, acq_id % 2 = 1 AS mirrored, count(*) AS n_close FROM plan GROUP BY acq_id"""))
def coarse_align(spark, sf):
    """Each acquisition turned about its centre by 90 degrees times its number and a little more, shifted and, by turns, mirrored:
    the rotation (to 10 degrees) and mirroring that the fit finds, and how many positions it brings within 0.3 mm of their spots."""
    plan = _drifting_plan(spark, sf).withColumn("y", F.col("y") + 0.4 * F.floor(F.col("spot_idx") / _PER_LAYER))  # no mirror image of itself
    centre = plan.groupBy("acq_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    turn = F.radians(90.0 * (F.col("acq_id") % 4) + 0.2)
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    mx, my = x * F.cos(turn) + y * F.sin(turn) + F.col("cx") + 0.1, y * F.cos(turn) - x * F.sin(turn) + F.col("cy") - 0.1
    mirrored = F.when(F.col("acq_id") % 2 == 1, -mx).otherwise(mx)
    rows = plan.join(centre, "acq_id").select("acq_id", F.col("spot_idx").alias("row_idx"), "x", "y", mirrored.alias("mx"), my.alias("my"))
    fits = landed(alignment.coarse_align(rows, plan))
    near = F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y")) < 0.3
    counts = alignment.apply(R.with_detector_axes(rows), fits).groupBy("acq_id").agg(F.count_if(near).alias("n_close"))
    theta = F.degrees(F.atan2(-F.col("m12"), F.col("m22")))  # a mirror before the turn changes the first column only
    mirrored = F.col("m11") * F.col("m22") < F.col("m12") * F.col("m21")
    return fits.join(counts, "acq_id").select("acq_id", (F.pmod(F.round(theta / 10) * 10, F.lit(360.0)) + 0.0).alias("theta_deg"), mirrored.alias("mirrored"), "n_close")


# Samples close to their spots, of acquisitions that a known map turned (by up to 270 degrees and a little more), shifted by
# a millimetre or two and, by turns, mirrored. No layer is a mirror image of the plan, so only the inverse map brings them back.
_TURN = {"theta": "(90 * ({a} % 4) + 3 * ({a} % 3) - 2)", "tx": "({a} % 5 - 2)", "ty": "({a} % 3)", "mirror": "(CASE WHEN {a} % 2 = 1 THEN -1 ELSE 1 END)"}


def _tilted_plan(spark, sf) -> DataFrame:
    return _drifting_plan(spark, sf).withColumn("y", F.col("y") + 0.4 * F.floor(F.col("spot_idx") / _PER_LAYER))


def _turned_rows(spark, sf) -> DataFrame:
    k = F.floor(F.col("spot") / _PER_LAYER).cast("double")
    own = lambda c, place: F.col(c) - place  # noqa: E731  how far a sample is from its spot
    x0, y0 = F.col("spot") % 5 * 5.0 - 10, F.floor(F.col("spot") % 25 / 5) * 5.0 - 10
    rows = acquisition_view(spark, sf).filter("a is not null and b is not null")
    x, y = x0 + _shift("spot") + 0.1 * own("b", x0), y0 + 0.4 * k + 0.1 * own("a", y0)
    known = {name: F.expr(text.format(a="acq_id")).cast("double") for name, text in _TURN.items()}
    c, s = F.cos(F.radians(known["theta"])), F.sin(F.radians(known["theta"]))
    u, v = x - known["tx"], y - known["ty"]
    return R.with_detector_axes(rows.withColumns({"mx": known["mirror"] * (u * c + v * s), "my": v * c - u * s})).drop("mx", "my")


@query(sql("acq", body="""
SELECT acq_id, count(DISTINCT spot) AS n_pass, CAST(0 AS BIGINT) AS n_warn, CAST(0 AS BIGINT) AS n_fail, count(DISTINCT spot) AS n
FROM acq WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY acq_id"""))
def aligned_run(spark, sf):
    """Position quality of a whole run with coarse and fine alignment: all spots of the turned samples come back to theirs."""
    config = Config(coarse=True, fine_shift=True, fine_rotation=True)
    return pipeline.run(_turned_rows(spark, sf), _tilted_plan(spark, sf), config).position_counts(config)


@query(sql("plan", body="SELECT acq_id, spot_idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM plan"))
def rigid_inverse(spark, sf):
    """A rigid map with both mirrors and a swap, and back."""
    turn = alignment.Rigid(33.0, 2.0, -7.0, swap=True, flip_x=True, flip_y=True)
    x, y = turn.columns(F.col("x"), F.col("y"))
    there = plan_view(spark, sf).withColumns({"u": x, "v": y})
    bx, by = turn.inverse(F.col("u"), F.col("v"))
    return there.select("acq_id", "spot_idx", rounded(bx).alias("x"), rounded(by).alias("y"))


_FULL_ROWS = """
SELECT * EXCLUDE (ex, ey) FROM (SELECT r.*, p.x AS ex, p.y AS ey, row_number() OVER (PARTITION BY r.acq_id, r.row_idx ORDER BY (p.x - r.mx) * (p.x - r.mx) + (p.y - r.my) * (p.y - r.my), p.spot_idx) AS k
  FROM whole r JOIN pl p ON r.acq_id = p.acq_id AND r.layer = p.layer)
WHERE k = 1 AND sqrt(((mx - ex) / coalesce(sigma_b, 0.35)) ** 2 + ((my - ey) / sigma_a) ** 2) <= 3.0"""
EXPORT = """
SELECT d.acq_id, CAST(row_number() OVER (PARTITION BY d.acq_id ORDER BY first_row) AS INTEGER) AS spot_index, 'yes' AS aggregated, CAST(d.layer AS INTEGER) AS layer_index,
  l.energy AS nominal_energy_mev, round(a + 1e-10, 6) AS measured_fit_a_mm, round(b + 1e-10, 6) AS measured_fit_b_mm, round(weight + 1e-10, 6) AS spot_weight, CAST(partial AS INTEGER) AS partial_code,
  round(sigma_a + 1e-10, 6) AS sigma_a_mm, round(sigma_b + 1e-10, 6) AS sigma_b_mm, ex AS expected_plan_x_mm, ey AS expected_plan_y_mm, ee AS expected_plan_energy_mev, emu AS expected_plan_mu,
  round(distance + 1e-10, 6) AS plan_xy_distance_mm, round(pf * 100 + 1e-10, 6) AS plan_dose_fraction_pct, round(mf * 100 + 1e-10, 6) AS meas_dose_fraction_pct, round(abs(mf - pf) * 100 + 1e-10, 6) AS dose_deviation_pp,
  'no' AS positions_aligned_to_plan
FROM dose d JOIN layers l ON d.acq_id = l.acq_id AND d.layer = l.layer"""


def rounded_export(out: DataFrame) -> DataFrame:
    """Doubles to six decimals; a little is added so that both engines round exact halves up."""
    kinds = dict(out.dtypes)
    return out.select(*[rounded(F.col(c) + 1e-10).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


@query(sql(*_WHOLE, "rows", "spots", "spothit", "dose", body=EXPORT, rows=_FULL_ROWS.replace("SELECT * EXCLUDE (ex, ey)", "SELECT * EXCLUDE (ex, ey, k)")))
def full_run(spark, sf):
    """A whole run by the gate counter with the flier filter, to the combined export."""
    config = Config(flier_sigma=3.0)
    return rounded_export(pipeline.export(pipeline.run(acquisition_view(spark, sf), plan_view(spark, sf), config), config))


@query(sql(*_WHOLE, "rows", "spots", "spothit", rows=_FULL_ROWS.replace("SELECT * EXCLUDE (ex, ey)", "SELECT * EXCLUDE (ex, ey, k)"), body="""
SELECT acq_id, 'missing' AS what, CAST(count(*) AS BIGINT) AS n FROM plan p ANTI JOIN rows r ON p.acq_id = r.acq_id AND p.spot_idx = r.spot_id GROUP BY acq_id
UNION ALL SELECT acq_id, 'delivered', count(DISTINCT r.spot_id) FROM rows r GROUP BY acq_id
UNION ALL SELECT acq_id, 'fail', count(*) FILTER (distance > 3) FROM spothit GROUP BY acq_id"""))
def run_summary(spark, sf):
    """Coverage and tiers of a whole run."""
    config = Config(flier_sigma=3.0)
    r = pipeline.run(acquisition_view(spark, sf), plan_view(spark, sf), config, keep=landed)
    part = lambda df, what, n: df.select("acq_id", F.lit(what).alias("what"), n.alias("n"))
    missing = r.missing.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    delivered = r.delivery.filter("delivery_t is not null").groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    return part(missing, "missing", F.col("n")).unionByName(part(delivered, "delivered", F.col("n"))).unionByName(part(r.position_counts(config), "fail", F.col("n_fail")))


@query(sql(*_WHOLE, body="""
SELECT acq_id, spot_id AS spot_idx, round(sum(weight * t) / sum(weight), 6) AS delivery_t
FROM whole
GROUP BY ALL"""))
def mode_delivery(spark, sf):
    """Delivery times of the gate counter's mode over all rows, delivered spots only."""
    got = assign.assign(acquisition_view(spark, sf), plan_view(spark, sf), "gate_counter")
    times = spots.delivery_times(plan_view(spark, sf), assign.with_plan_slot(got, plan_view(spark, sf), "gate_counter"))
    return times.filter("delivery_t is not null").select("acq_id", "spot_idx", rounded("delivery_t").alias("delivery_t"))


@query(_drifting("layers", "pl", "gated", body="""
SELECT acq_id, row_idx, CAST(first_slot + nl AS BIGINT) AS plan_idx FROM (
  SELECT r.acq_id, r.row_idx, p.local_idx AS nl, f.first_slot, row_number() OVER (PARTITION BY r.acq_id, r.row_idx ORDER BY (p.x - r.b) * (p.x - r.b) + (p.y - r.a) * (p.y - r.a), p.spot_idx) AS k
  FROM gated r JOIN pl l ON l.acq_id = r.acq_id AND l.spot_idx = r.spot_id JOIN pl p ON p.acq_id = r.acq_id AND p.layer = l.layer
  JOIN (SELECT acq_id, layer, min(spot_idx) AS first_slot FROM pl GROUP BY ALL) f ON f.acq_id = r.acq_id AND f.layer = l.layer
  WHERE r.a IS NOT NULL AND r.b IS NOT NULL) WHERE k = 1"""))
def plan_slot(spark, sf):
    """Slots of the nearest spots on each row's layer, whose number is cut off (here from layer + 0.9)."""
    plan = _drifting_plan(spark, sf)
    rows = R.with_plan_axes(layers.delivery_layers(gates.gate_spots(_drifting_rows(spark, sf)), layers.layer_table(plan))).filter(R.position_ok())
    return nearest.plan_slot(rows.withColumn("layer", F.col("layer") + 0.9), plan).select("acq_id", "row_idx", F.col("plan_idx").cast("bigint").alias("plan_idx"))


@query(_drifting("layers", "pl", "gated", body="""
SELECT acq_id, round(sqrt(avg(d2)), 6) AS rms, count(*) AS n FROM (SELECT r.acq_id, r.row_idx, min((p.x - r.b) * (p.x - r.b) + (p.y - r.a) * (p.y - r.a)) AS d2
  FROM acq r JOIN plan p ON r.acq_id = p.acq_id WHERE r.a IS NOT NULL AND r.b IS NOT NULL GROUP BY ALL) GROUP BY acq_id"""))
def flat_rms(spark, sf):
    """Distance of all rows to the flattened plan."""
    rows = R.with_plan_axes(_drifting_rows(spark, sf)).filter(R.position_ok())
    matched = nearest.match_on_plan(rows, _drifting_plan(spark, sf))
    return matched.groupBy("acq_id").agg(rounded(F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("rms"), F.count(F.lit(1)).alias("n"))


_SPAN = """
SELECT acq_id, spot_id AS span_id, min(row_idx) AS row_start, max(row_idx) + 1 AS row_end, round(sum(channel * a) FILTER (a IS NOT NULL) / sum(channel) FILTER (a IS NOT NULL), 6) AS a,
  round(sum(channel * b) FILTER (b IS NOT NULL) / sum(channel) FILTER (b IS NOT NULL), 6) AS b, round(sum(channel), 6) AS weight, round(sum(channel * sigma_a) / sum(channel), 6) AS sigma_a,
  round(sum(channel * sigma_b) FILTER (sigma_b IS NOT NULL) / sum(channel) FILTER (sigma_b IS NOT NULL), 6) AS sigma_b, round(sum(channel * channel) / sum(channel), 6) AS channel,
  round(sum(channel * t) / sum(channel), 6) AS t, max(CASE WHEN a IS NULL THEN 1 WHEN b IS NULL THEN 2 ELSE 0 END) AS partial, count(*) AS n_rows FROM gated GROUP BY acq_id, spot_id"""


def _gate_spans(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = R.with_plan_axes(acquisition_view(spark, sf)).withColumn("weight", F.col("channel"))
    spans = gates.gate_spots(rows).groupBy("acq_id", F.col("spot_id").alias("span_id")).agg(F.min("row_idx").alias("row_start"), (F.max("row_idx") + 1).alias("row_end"))
    return rows, spans


@query(sql("acq", "gated", body=_SPAN))
def span_stats(spark, sf):
    """Weighted statistics of spans of rows."""
    got = spots.span_stats(*_gate_spans(spark, sf))
    return got.select("acq_id", "span_id", "row_start", "row_end", *[rounded(c).alias(c) for c in ("a", "b", "weight", "sigma_a", "sigma_b", "channel", "t")], "partial", "n_rows")


@query(sql("acq", "gated", body="SELECT acq_id, spot_id AS span_id, round(sum(channel), 6) AS weight FROM gated GROUP BY ALL"))
def span_weights(spark, sf):
    rows, spans = _gate_spans(spark, sf)
    return spots.span_weights(rows, spans).select("acq_id", "span_id", rounded("weight").alias("weight"))


@query(sql("acq", "gated", body="""
SELECT acq_id, CAST(floor(spot_id / 2) AS BIGINT) AS pair, round(sum(channel * a) FILTER (a IS NOT NULL) / sum(channel) FILTER (a IS NOT NULL), 9) AS a
FROM gated WHERE a IS NOT NULL GROUP BY ALL"""))
def merged_means(spark, sf):
    """Means of two neighbouring spans merged from their own means."""
    rows, spans = _gate_spans(spark, sf)
    one = spots.span_stats(rows.filter("a is not null"), spans).withColumn("pair", F.floor(F.col("span_id") / 2).cast("bigint"))
    side = lambda odd: one.filter(F.col("span_id") % 2 == odd).select("acq_id", "pair", F.col("a").alias(f"a{odd}"), F.col("weight").alias(f"w{odd}"))
    both = side(0).join(side(1), ["acq_id", "pair"], "full")
    return both.select("acq_id", "pair", rounded(spots.merge_means(F.col("a0"), F.col("a1"), F.col("w0"), F.col("w1")), 9).alias("a"))


@query(sql("plan", "acq", "layers", "pl", "gated", "rows", body="""
SELECT acq_id, CAST(floor(spot_id / 40) AS BIGINT) AS spot_id, CAST(trunc(sum(weight * layer) / sum(weight)) AS INTEGER) AS layer FROM rows GROUP BY ALL"""))
def spot_layers_cut(spark, sf):
    """Layers of spots that span two of them, cut off to whole numbers."""
    from .base import complete_rows

    return spots.spot_layers_cut(complete_rows(spark, sf).withColumn("spot_id", F.floor(F.col("spot_id") / 40).cast("bigint")))


@query(sql("plan", "acq", "layers", "pl", "gated", "rows", "spots", body="SELECT acq_id, spot_id, layer, round(a, 6) AS a, round(weight, 6) AS weight FROM spots"))
def plan_slot_spots(spark, sf):
    """Spots by plan slot; rows of slots beyond the plan and without a layer of their own are handled."""
    from .base import complete_rows

    rows = complete_rows(spark, sf)
    beyond = rows.withColumn("spot_id", F.col("spot_id") + 100_000)
    bare = rows.withColumn("layer", F.lit(None).cast("int")).unionByName(beyond)
    return spots.plan_slot_spots(bare, plan_view(spark, sf)).select("acq_id", "spot_id", "layer", rounded("a").alias("a"), rounded("weight").alias("weight"))


@query(sql("plan", "acq", body="""
SELECT acq_id, row_idx, CASE WHEN row_idx % 3 = 0 THEN NULL ELSE a END AS a, (row_idx % 3 = 0) AS dead
FROM acq
WHERE row_idx % 3 = 0 OR (a IS NOT NULL AND b IS NOT NULL)"""))
def dead_positions(spark, sf):
    """Rows of plan-sequential mode: dead ones (without a fit) stay, without positions. Row numbers as they were."""
    from ..sources.acquisition import signal_rows

    rows = acquisition_view(spark, sf).withColumn("fit_a", F.when(F.col("row_idx") % 3 != 0, F.col("fit_a")))
    kept = R.with_plan_axes(signal_rows(rows, True)).filter(R.position_ok(False, True))
    return kept.select("acq_id", "row_idx", "a", R.is_dead().alias("dead"))


@query(sql("acq", "metric", body="""
SELECT acq_id, row_idx, round(greatest(channel, 1e-18) * CASE WHEN metric >= 0.45 THEN 1 ELSE 0 END, 6) AS weight
FROM metric"""))
def on_weights(spark, sf):
    got = signal.delivery_weights(acquisition_view(spark, sf).withColumn("weight", F.col("channel")))
    return got.select("acq_id", "row_idx", rounded("weight").alias("weight"))


@query(sql("plan", "acq", "layers", "pl", "gated", body="SELECT acq_id, spot_id, min(row_idx) AS row_start, max(row_idx) + 1 AS row_end FROM gated GROUP BY ALL"))
def slot_spans(spark, sf):
    """Runs of rows of one slot."""
    rows = gates.gate_spots(acquisition_view(spark, sf))
    return episodes.slot_spans(rows).select("acq_id", "spot_id", "row_start", "row_end")
