"""Queries over the plan and acquisition views, each with the same rows in SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config
from ..functions import colors, depth, rows as R, scene
from ..operators import alignment, display, gates, gaps, layers, nearest, quality, signal, spots
from ..sources.tables import acquisition_view, events, plan_view
from . import pipeline
from .base import DOSE as _DOSE
from .base import HIT as _HIT
from .base import QUERIES, query, sql
from .base import SPOT as _SPOT
from .base import complete_rows as _rows
from .base import measured_spots as _spots
from .base import rounded as _r


def _tiers(d: str) -> str:
    return f"count(*) FILTER ({d} <= 1) AS n_pass, count(*) FILTER ({d} > 1 AND {d} <= 3) AS n_warn, count(*) FILTER ({d} > 3) AS n_fail, count(*) AS n"


@query(sql(*_HIT[:4], "gated", "rows", "spots", "spothit", body=f"SELECT acq_id, CAST(layer AS INTEGER) AS layer, {_tiers('distance')} FROM spothit GROUP BY ALL"))
def position_qa_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Position tiers of measured spots by energy layer."""
    matched = nearest.match_on_layer(_spots(spark, sf), plan_view(spark, sf)).withColumn("layer", F.col("layer").cast("int"))
    return quality.position_counts(matched, keys=["acq_id", "layer"])


@query(sql("plan", "layers", "pl", body="""
SELECT l.acq_id, l.layer, l.energy, count(p.spot_idx) AS n_spots, min(p.spot_idx) AS first_slot, round(sum(p.mu), 4) AS total_mu
FROM layers l
LEFT JOIN pl p ON l.acq_id = p.acq_id AND l.layer = p.layer
GROUP BY ALL"""))
def plan_layers(spark, sf):
    return layers.layer_table(plan_view(spark, sf)).withColumn("total_mu", F.round("total_mu", 4))


@query(sql("plan", body="SELECT acq_id, max(energy) AS e_high, min(energy) AS e_low FROM plan GROUP BY ALL"))
def plan_energy_bounds(spark, sf):
    return layers.energy_bounds(plan_view(spark, sf))


@query(sql("acq", body="""
SELECT acq_id, CAST(CASE WHEN a IS NULL AND b IS NULL THEN -1 WHEN a IS NULL THEN 1 WHEN b IS NULL THEN 2 ELSE 0 END AS INTEGER) AS partial, count(*) AS n, round(sum(b), 4) AS sum_x, round(sum(a), 4) AS sum_y
FROM acq
GROUP BY ALL"""))
def axis_map_partial(spark, sf):
    return R.with_plan_axes(acquisition_view(spark, sf)).groupBy("acq_id", "partial").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("mx"), 4).alias("sum_x"), _r(F.sum("my"), 4).alias("sum_y"))


@query(sql("acq", body="SELECT acq_id, row_idx, gate FROM acq WHERE a IS NOT NULL AND b IS NOT NULL"))
def full_fit_filter(spark, sf):
    return R.with_plan_axes(acquisition_view(spark, sf)).filter(R.position_ok()).select("acq_id", "row_idx", "gate")


@query(sql("acq", body="""
SELECT acq_id, row_idx, greatest(coalesce(channel, 1.0), 1e-9) AS w_channel, greatest(fit_a, 1e-9) AS w_a, greatest(fit_b, 1e-9) AS w_b, CASE WHEN channel > 0 THEN channel ELSE 1.0 END AS w_auto
FROM acq"""))
def spot_weight_modes(spark, sf):
    return acquisition_view(spark, sf).select("acq_id", "row_idx", R.spot_weight("channel_sum").alias("w_channel"), R.spot_weight("fit_amplitude_a").alias("w_a"), R.spot_weight("fit_amplitude_b").alias("w_b"), R.spot_weight("channel_sum", auto=True).alias("w_auto"))


@query(sql("acq", "gated", body="SELECT acq_id, row_idx, spot_id FROM gated"))
def gate_spot_ids(spark, sf):
    return gates.gate_spots(acquisition_view(spark, sf)).select("acq_id", "row_idx", "spot_id")


@query(sql("acq", body="""
SELECT acq_id, row_idx, CAST(sum(CASE WHEN g0 % 2 = 1 AND (gate % 2 = 0 OR gate <> g0) THEN 1 ELSE 0 END) OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS phase_id
FROM (SELECT *, lag(gate) OVER (PARTITION BY acq_id ORDER BY row_idx) AS g0
FROM acq)"""))
def gate_phase_ids(spark, sf):
    return gates.gate_phase_spots(acquisition_view(spark, sf)).select("acq_id", "row_idx", "phase_id")


@query(sql("plan", "acq", "layers", "pl", "gated", body="""
SELECT g.acq_id, g.row_idx, g.spot_id, p.layer
FROM gated g
JOIN pl p ON g.acq_id = p.acq_id AND g.spot_id = p.spot_idx"""))
def delivery_layer_lookup(spark, sf):
    table = layers.layer_table(plan_view(spark, sf))
    return layers.delivery_layers(gates.gate_spots(acquisition_view(spark, sf)), table).select("acq_id", "row_idx", "spot_id", "layer")


_GAP = """
SELECT acq_id, row_idx, CAST(sum(new) OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS spot_id
FROM (SELECT *, CASE WHEN t - lag(t) OVER w >= 0.2 AND NOT sqrt((b - lag(b) OVER w) * (b - lag(b) OVER w) + (a - lag(a) OVER w) * (a - lag(a) OVER w)) <= 3.0 THEN 1 ELSE 0 END AS new
FROM acq
WHERE a IS NOT NULL AND b IS NOT NULL
WINDOW w AS (PARTITION BY acq_id ORDER BY row_idx))"""


@query(sql("acq", body=_GAP))
def time_gap_spots(spark, sf):
    fit = R.with_plan_axes(acquisition_view(spark, sf)).filter(R.position_ok())
    return gaps.gap_spots(fit).select("acq_id", "row_idx", "spot_id")


@query(sql("ev", body="""
SELECT acq_id, row_idx, CAST(sum(CASE WHEN t - t0 >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY acq_id ORDER BY row_idx) AS BIGINT) AS spot_id
FROM (SELECT *, lag(t) OVER (PARTITION BY acq_id ORDER BY row_idx) AS t0
FROM ev)"""))
def event_sessions(spark, sf):
    """Pauses of 600 s and more between events, as spots without positions."""
    from pyspark.sql import Window

    order = Window.partitionBy("acq_id").orderBy("event_id")
    ev = events(spark, sf).withColumns({"acq_id": F.col("user_id") % 10, "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "mx": F.lit(None).cast("double"), "my": F.lit(None).cast("double")})
    rows = ev.withColumn("row_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return gaps.gap_spots(rows, 600.0).select("acq_id", "row_idx", "spot_id")


@query(sql("acq", "metric", body="SELECT acq_id, row_idx, round(metric, 6) AS metric FROM metric"))
def rolling_delivery_metric(spark, sf):
    return signal.delivery_metric(acquisition_view(spark, sf)).select("acq_id", "row_idx", _r("metric").alias("metric"))


@query(sql("acq", "metric", body="""
SELECT acq_id, CAST(run - 1 AS BIGINT) AS span_id, min(row_idx) AS row_start, max(row_idx) + 1 AS row_end
FROM (SELECT *, sum(CASE WHEN NOT dead AND d0 THEN 1 ELSE 0 END) OVER (PARTITION BY acq_id ORDER BY row_idx) AS run
FROM (SELECT *, coalesce(lag(dead) OVER (PARTITION BY acq_id ORDER BY row_idx), true) AS d0
FROM (SELECT *, metric <= 0.6 AS dead
FROM metric)))
WHERE NOT dead
GROUP BY ALL"""))
def deadtime_islands(spark, sf):
    return signal.on_spans(signal.dead_rows(acquisition_view(spark, sf)))


@query(sql("acq", "metric", body="""
SELECT acq_id, count(*) AS n, round(sum(CASE WHEN metric >= 0.45 THEN channel ELSE 0 END), 4) AS weight
FROM metric
GROUP BY ALL"""))
def delivery_row_weights(spark, sf):
    weighted = signal.delivery_weights(acquisition_view(spark, sf).withColumn("weight", F.col("channel")))
    return weighted.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("weight"), 4).alias("weight"))


_SPREAD = """
SELECT s.acq_id, s.span_id, p.layer FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY acq_id) AS n
  FROM (SELECT acq_id, CAST(floor(spot_id / 3) AS BIGINT) AS span_id, min(row_idx) AS start FROM gated GROUP BY ALL)) s JOIN (SELECT *, count(*) OVER (PARTITION BY acq_id) AS total FROM pl) p
ON p.acq_id = s.acq_id AND p.spot_idx = CAST(floor((2 * s.i + 1) * p.total / (2 * s.n)) AS BIGINT)"""


@query(sql("plan", "acq", "layers", "pl", "gated", body=_SPREAD))
def episode_layer_spread(spark, sf):
    """Spans of three spots each, spread over all layers by their order in time."""
    g = gates.gate_spots(acquisition_view(spark, sf))
    spans = g.groupBy("acq_id", F.floor(F.col("spot_id") / 3).cast("bigint").alias("span_id")).agg(F.min("row_idx").alias("row_start"))
    return layers.spread_layers(spans, layers.layer_table(plan_view(spark, sf))).select("acq_id", "span_id", "layer")


@query(sql(*_HIT, body="SELECT acq_id, row_idx, nn AS nn_spot_idx, round(distance, 6) AS distance, emu AS expected_mu FROM hit"))
def layer_nn_match(spark, sf):
    return nearest.match_on_layer(_rows(spark, sf), plan_view(spark, sf)).select("acq_id", "row_idx", "nn_spot_idx", _r("distance").alias("distance"), "expected_mu")


_FLAT = """
SELECT acq_id, spot_id, nn_spot_idx, round(sqrt(d2), 6) AS distance
FROM (SELECT s.acq_id, s.spot_id, p.spot_idx AS nn_spot_idx, (p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a) AS d2, row_number() OVER (PARTITION BY s.acq_id, s.spot_id ORDER BY (p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a), p.spot_idx) AS k
FROM spots s
JOIN plan p ON s.acq_id = p.acq_id)
WHERE k = 1"""


@query(sql(*_SPOT, body=_FLAT))
def flat_nn_match(spark, sf):
    return nearest.match_on_plan(_spots(spark, sf), plan_view(spark, sf)).select("acq_id", "spot_id", "nn_spot_idx", _r("distance").alias("distance"))


@query(sql(*_SPOT, body="""
SELECT s.acq_id, s.first_row AS row_idx, p.layer, round(min((p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a)), 6) AS d2
FROM spots s
JOIN pl p ON s.acq_id = p.acq_id
GROUP BY ALL"""))
def emit_matrix_long(spark, sf):
    return nearest.distances_long(_spots(spark, sf), plan_view(spark, sf)).select("acq_id", "row_idx", "layer", _r("d2").alias("d2"))


_IMPUTE = """
SELECT acq_id, row_idx, x AS mx, y AS my
FROM (SELECT a.acq_id, a.row_idx, p.x, p.y, row_number() OVER (PARTITION BY a.acq_id, a.row_idx ORDER BY CASE WHEN a.b IS NOT NULL THEN abs(p.x - a.b) ELSE abs(p.y - a.a) END, p.spot_idx) AS k
FROM acq a
JOIN plan p ON a.acq_id = p.acq_id WHERE (a.a IS NULL) <> (a.b IS NULL))
WHERE k = 1"""


@query(sql("plan", "acq", body=_IMPUTE))
def impute_nearest_axis(spark, sf):
    one = R.with_plan_axes(acquisition_view(spark, sf)).filter("partial in (1, 2)")
    return nearest.impute_axes(one, plan_view(spark, sf)).select("acq_id", "row_idx", "mx", "my")


@query(sql(*_HIT, body="""
SELECT acq_id, row_idx
FROM hit
WHERE sqrt(((mx - ex) / coalesce(sigma_b, 0.35)) * ((mx - ex) / coalesce(sigma_b, 0.35)) + ((my - ey) / sigma_a) * ((my - ey) / sigma_a)) <= 1.5"""))
def sigma_flier_filter(spark, sf):
    return nearest.filter_fliers(_rows(spark, sf), plan_view(spark, sf), 1.5).select("acq_id", "row_idx")


@query(sql(*_SPOT, body="""
SELECT acq_id, spot_id, round(a, 6) AS a, round(b, 6) AS b, layer, round(weight, 6) AS weight, round(sigma_a, 6) AS sigma_a, round(sigma_b, 6) AS sigma_b, round(channel, 6) AS channel, round(t, 6) AS t, first_row, n_rows
FROM spots"""))
def spot_weighted_mean(spark, sf):
    return spots.weighted_spots(_rows(spark, sf)).select("acq_id", "spot_id", *[_r(c).alias(c) for c in ("a", "b", "layer", "weight", "sigma_a", "sigma_b", "channel", "t")], "first_row", "n_rows")


_SECOND = "SELECT acq_id, CAST(spot_idx + 100000 * f AS BIGINT) AS spot_idx, energy FROM plan, range(0, 2) r(f)"


@query(sql(*_SPOT[:6], twice=_SECOND, body="""
SELECT p.acq_id, p.spot_idx, p.energy
FROM twice p
ANTI JOIN rows r ON p.acq_id = r.acq_id AND p.spot_idx = r.spot_id"""))
def plan_coverage_missing(spark, sf):
    """Spots without any row; each plan has a second field, which was not delivered."""
    plan = plan_view(spark, sf)
    twice = plan.unionByName(plan.withColumn("spot_idx", F.col("spot_idx") + 100_000))
    return spots.uncovered(twice, _rows(spark, sf).withColumn("plan_idx", F.col("spot_id"))).select("acq_id", F.col("spot_idx").cast("bigint").alias("spot_idx"), "energy")


@query(sql(*_SPOT[:6], body="""
SELECT p.acq_id, p.spot_idx, round(sum(r.weight * r.t) / sum(r.weight), 6) AS delivery_t
FROM plan p
LEFT JOIN rows r ON p.acq_id = r.acq_id AND p.spot_idx = r.spot_id
GROUP BY ALL"""))
def plan_delivery_time(spark, sf):
    rows = _rows(spark, sf).withColumn("plan_idx", F.col("spot_id"))
    return spots.delivery_times(plan_view(spark, sf), rows).select("acq_id", "spot_idx", _r("delivery_t").alias("delivery_t"))


@query(sql(*_HIT, body=f"SELECT acq_id, {_tiers('distance')} FROM hit GROUP BY ALL"))
def position_qa_counts(spark, sf):
    return quality.position_counts(nearest.match_on_layer(_rows(spark, sf), plan_view(spark, sf)))


@query(sql(*_DOSE, body="""
SELECT acq_id, spot_id, round(pf, 8) AS plan_fraction, round(mf, 8) AS measured_fraction, round(abs(mf - pf) * 100, 6) AS deviation_pp
FROM dose"""))
def dose_qa_fractions(spark, sf):
    d = quality.dose_fractions(_spots(spark, sf), plan_view(spark, sf))
    return d.select("acq_id", "spot_id", _r("plan_fraction", 8).alias("plan_fraction"), _r("measured_fraction", 8).alias("measured_fraction"), _r("deviation_pp").alias("deviation_pp"))


@query(sql(*_DOSE, body="""
SELECT acq_id, count(*) FILTER (abs(d) <= 0.3) AS n_pass, count(*) FILTER (d > 0.3 AND d <= 1) AS n_over_warn, count(*) FILTER (d > 1) AS n_over_fail, count(*) FILTER (d < -0.3 AND d >= -1) AS n_under_warn, count(*) FILTER (d < -1) AS n_under_fail, count(*) AS n
FROM (SELECT *, (mf - pf) * 100 AS d
FROM dose)
GROUP BY ALL"""))
def dose_qa_tiers(spark, sf):
    return quality.dose_counts(quality.dose_fractions(_spots(spark, sf), plan_view(spark, sf)), 0.3, 1.0)


_EXPORT = """SELECT d.acq_id, CAST(row_number() OVER (PARTITION BY d.acq_id ORDER BY first_row) AS INTEGER) AS spot_index, 'yes' AS aggregated, CAST(d.layer AS INTEGER) AS layer_index, l.energy AS nominal_energy_mev,
 round(a, 6) AS measured_fit_a_mm, round(b, 6) AS measured_fit_b_mm, round(weight, 6) AS spot_weight, 0 AS partial_code, round(sigma_a, 6) AS sigma_a_mm, round(sigma_b, 6) AS sigma_b_mm, ex AS expected_plan_x_mm, ey AS expected_plan_y_mm,
 ee AS expected_plan_energy_mev, emu AS expected_plan_mu, round(distance, 6) AS plan_xy_distance_mm, round(pf * 100, 6) AS plan_dose_fraction_pct, round(mf * 100, 6) AS meas_dose_fraction_pct, round(abs(mf - pf) * 100, 6) AS dose_deviation_pp, 'no' AS positions_aligned_to_plan
 FROM dose d JOIN layers l ON d.acq_id = l.acq_id AND d.layer = l.layer"""


@query(sql(*_DOSE, body=_EXPORT))
def combined_export(spark, sf):
    plan, config = plan_view(spark, sf), Config()
    m = _spots(spark, sf)
    result = pipeline.Result(plan, m, m, m, m, m, "gate_counter", None, None)
    out = pipeline.export(result, config)
    kinds = dict(out.dtypes)
    return out.select(*[_r(c).alias(c) if kinds[c] == "double" else F.col(c) for c in out.columns])


@query(sql("acq", body="""
SELECT acq_id, round(least(greatest(1e-12, 0.05 * p1, 0.002 * p50), 0.02 * p50), 9) AS min_on_weight
FROM (SELECT acq_id, quantile_cont(channel, 0.01) AS p1, quantile_cont(channel, 0.5) AS p50
FROM acq
WHERE channel > 0
GROUP BY acq_id)"""))
def min_on_spot_weight(spark, sf):
    return signal.min_on_weight(acquisition_view(spark, sf).withColumn("weight", F.col("channel"))).withColumn("min_on_weight", _r("min_on_weight", 9))


_GAPFIT = """SELECT acq_id, round(greatest(0.005, least(5.0, CASE WHEN p90 - p10 < greatest(0.05 * p50, 1e-9) THEN 2.5 * p50 ELSE least(knee, span / (np - 1) / 2, greatest(1.35 * p90, 3 * p50)) END, 8 * p50)), 6) AS gap_s
FROM (SELECT acq_id, quantile_cont(dt, 0.5) AS p50, quantile_cont(dt, 0.1) AS p10, quantile_cont(dt, 0.9) AS p90 FROM st GROUP BY acq_id)
JOIN (SELECT acq_id, (dt + was) / 2 AS knee FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY dt / greatest(was, 1e-12) DESC, dt) AS k FROM (SELECT acq_id, dt, lag(dt) OVER (PARTITION BY acq_id ORDER BY dt) AS was FROM st) WHERE was IS NOT NULL) WHERE k = 1) USING (acq_id)
JOIN (SELECT acq_id, max(t) - min(t) AS span FROM ev GROUP BY acq_id) USING (acq_id) JOIN (SELECT acq_id, 100 AS np FROM ev GROUP BY acq_id) USING (acq_id)"""


@query(sql("ev", body="""
, st AS (SELECT acq_id, dt
FROM (SELECT acq_id, t - lag(t) OVER (PARTITION BY acq_id ORDER BY row_idx) AS dt
FROM ev)
WHERE dt > 0) """ + _GAPFIT))
def episode_gap_inference(spark, sf):
    from pyspark.sql import Window

    ev = events(spark, sf).withColumns({"acq_id": F.col("user_id") % 10, "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    rows = ev.withColumn("row_idx", (F.row_number().over(Window.partitionBy("acq_id").orderBy("event_id")) - 1).cast("bigint"))
    plan = rows.select("acq_id").distinct().withColumn("spot_idx", F.explode(F.sequence(F.lit(0), F.lit(99))))
    return signal.episode_gap(rows, plan).withColumn("gap_s", _r("gap_s"))


@query(sql("plan", "layers", "pl", body="""
SELECT acq_id, coalesce(greatest(400.0, least(2000.0, greatest(50.0, 1.25 * quantile_cont(d2, 0.5)))), 400.0) AS penalty
FROM (SELECT acq_id, nullif((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w), 0) AS d2
FROM (SELECT acq_id, layer, avg(x) AS cx, avg(y) AS cy
FROM pl
GROUP BY ALL)
WINDOW w AS (PARTITION BY acq_id ORDER BY layer))
GROUP BY acq_id"""))
def viterbi_penalty(spark, sf):
    return signal.advance_penalty(plan_view(spark, sf))


@query(sql("plan", "acq", body="""
SELECT acq_id, CAST(greatest(1, least(20, round_even(count(*) / any_value(m) * 0.03, 0))) AS INTEGER) AS min_rows
FROM acq
JOIN (SELECT acq_id, count(*) AS m
FROM plan
GROUP BY acq_id) USING (acq_id)
GROUP BY acq_id"""))
def min_episode_rows(spark, sf):
    return signal.min_episode_rows(acquisition_view(spark, sf), plan_view(spark, sf))


@query(sql("plan", body="""
SELECT acq_id, round(power(greatest(3.0, 1.6 * quantile_cont(d, 0.5)), 2), 6) AS radius_mm2
FROM (SELECT acq_id, nullif(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS d
FROM plan
WINDOW w AS (PARTITION BY acq_id ORDER BY spot_idx))
GROUP BY acq_id"""))
def cluster_radius(spark, sf):
    return signal.cluster_radius(plan_view(spark, sf)).withColumn("radius_mm2", _r("radius_mm2"))


_KABSCH = """SELECT acq_id, n, round(degrees(th), 6) AS theta_deg, round(px - (cos(th) * mx - sin(th) * my), 6) AS tx, round(py - (sin(th) * mx + cos(th) * my), 6) AS ty, round(sqrt(greatest(sq - 2 * sqrt(d * d + c * c), 0) / n), 6) AS rms
FROM (SELECT *, atan2(c, d) AS th FROM (SELECT h.acq_id, count(*) AS n, any_value(g.mx) AS mx, any_value(g.my) AS my, any_value(g.px) AS px, any_value(g.py) AS py, sum((h.mx - g.mx) * (ex - px) + (h.my - g.my) * (ey - py)) AS d, sum((h.mx - g.mx) * (ey - py) - (h.my - g.my) * (ex - px)) AS c,
 sum((h.mx - g.mx) * (h.mx - g.mx) + (h.my - g.my) * (h.my - g.my) + (ex - px) * (ex - px) + (ey - py) * (ey - py)) AS sq
 FROM hit h JOIN (SELECT acq_id, avg(mx) AS mx, avg(my) AS my, avg(ex) AS px, avg(ey) AS py FROM hit GROUP BY acq_id) g ON h.acq_id = g.acq_id GROUP BY h.acq_id))"""


@query(sql(*_HIT, body=_KABSCH))
def kabsch_params(spark, sf):
    pairs = nearest.align_pairs(nearest.match_on_layer(_rows(spark, sf), plan_view(spark, sf)))
    fit = alignment.rigid_sums(pairs)
    return fit.select("acq_id", "n", *[_r(c).alias(c) for c in ("theta_deg", "tx", "ty", "rms")])


@query(sql(*_SPOT, body="""
SELECT acq_id, spot_id, round(cos(radians(12.5)) * -b - sin(radians(12.5)) * a + 1.5, 6) AS mx, round(sin(radians(12.5)) * -b + cos(radians(12.5)) * a - 0.75, 6) AS my
FROM spots"""))
def rigid_apply(spark, sf):
    moved = alignment.apply(_spots(spark, sf), alignment.Rigid(12.5, 1.5, -0.75, flip_x=True))
    return moved.select("acq_id", "spot_id", _r("mx").alias("mx"), _r("my").alias("my"))


@query(sql(*_HIT, body="SELECT acq_id, round(sqrt(sum(weight * distance * distance) / sum(weight)), 6) AS rms FROM hit GROUP BY ALL"))
def residual_rms(spark, sf):
    return alignment.residual(_rows(spark, sf), plan_view(spark, sf)).withColumn("rms", _r("rms"))


_TABLE = ", ".join(map(str, K.RANGE_MM))
_CSDA = f"""
(SELECT *, greatest(0, least(67, CAST(floor((energy - 10) / 5) AS INTEGER))) AS i, CAST([{_TABLE}] AS DOUBLE[]) AS tab
FROM plan)"""


@query(sql("plan", body=f"""
SELECT acq_id, spot_idx, round(r, 6) AS csda, round(greatest(0, 0.975 * r - 0.56), 6) AS r90, round(greatest(0, 0.910 * r - 1.14), 6) AS r80
FROM (SELECT *, tab[i + 1] + (tab[i + 2] - tab[i + 1]) * (energy - (10 + i * 5)) / 5 AS r
FROM {_CSDA})"""))
def water_depth(spark, sf):
    e = F.col("energy")
    return plan_view(spark, sf).select("acq_id", "spot_idx", *[_r(depth.water_depth_mm(e, m)).alias(m) for m in depth.METRICS])


@query(sql("plan", body="""
SELECT p.acq_id, spot_idx, hi + lo - energy AS scene_z
FROM plan p
JOIN (SELECT acq_id, max(energy) AS hi, min(energy) AS lo
FROM plan
GROUP BY acq_id) b ON p.acq_id = b.acq_id"""))
def scene_z(spark, sf):
    plan = plan_view(spark, sf)
    return display.with_scene_z(plan, plan).select("acq_id", "spot_idx", "scene_z")


@query(sql(*_SPOT[:6], body="""
SELECT acq_id, row_idx, l.energy AS nominal_energy
FROM rows r
JOIN layers l USING (acq_id, layer)
WHERE l.energy BETWEEN 180 AND 200"""))
def energy_slice(spark, sf):
    cloud = display.measured_cloud(_rows(spark, sf), plan_view(spark, sf))
    return cloud.filter(display.energy_slice(F.col("nominal_energy"), 200.0, 180.0)).select("acq_id", "row_idx", "nominal_energy")


@query(sql("plan", "layers", body="""
SELECT acq_id, min(energy) AS band_low, max(energy) AS band_high
FROM layers
WHERE abs(layer - 3) <= 2
GROUP BY acq_id"""))
def layer_energy_band(spark, sf):
    return layers.energy_band(layers.layer_table(plan_view(spark, sf)), 3)


@query(sql("acq", body="SELECT acq_id, row_idx, t FROM acq WHERE t BETWEEN 20.0 AND 45.5"))
def time_slice(spark, sf):
    return acquisition_view(spark, sf).filter(display.time_slice(F.col("t"), 20.0, 25.5)).select("acq_id", "row_idx", "t")


@query(sql(*_SPOT, body="""
SELECT acq_id, CAST(floor(min(t) * 1000) AS BIGINT) AS from_ms, CAST(floor(max(t) * 1000) AS BIGINT) AS to_ms
FROM (SELECT acq_id, t
FROM acq
UNION ALL SELECT acq_id, t + 1
FROM acq)
GROUP BY acq_id"""))
def time_slice_range(spark, sf):
    a = acquisition_view(spark, sf)
    return display.timeline_range(a, a.withColumn("t", F.col("t") + 1))


@query(sql(*_HIT, body="SELECT acq_id, row_idx FROM hit WHERE distance > 1"))
def hide_pass_spots(spark, sf):
    return display.hide_passed(nearest.match_on_layer(_rows(spark, sf), plan_view(spark, sf))).select("acq_id", "row_idx")


@query(sql(*_SPOT, "spothit", body="""
SELECT acq_id, spot_id, CASE WHEN distance <= 1 THEN 34 WHEN distance > 3 THEN 239 ELSE 234 END AS red, CASE WHEN distance <= 1 THEN 197 WHEN distance > 3 THEN 68 ELSE 179 END AS green, CASE WHEN distance <= 1 THEN 94 WHEN distance > 3 THEN 68 ELSE 8 END AS blue, 255 AS alpha
FROM spothit"""))
def qa_rgba(spark, sf):
    m = nearest.match_on_layer(_spots(spark, sf), plan_view(spark, sf))
    return colors.by_position(m).select("acq_id", "spot_id", "red", "green", "blue", "alpha")


@query(sql("acq", body="""
SELECT acq_id, row_idx
FROM (SELECT *, count(*) OVER (PARTITION BY acq_id) AS n
FROM acq)
WHERE row_idx % CAST(ceil(n / 3000.0) AS BIGINT) = 0"""))
def stride_sample(spark, sf):
    return alignment.strided(acquisition_view(spark, sf), 3000).select("acq_id", "row_idx")


@query(sql(*_HIT, body="""
SELECT acq_id, row_idx, mx AS x0, my AS y0, ex AS x1, ey AS y1, round(distance, 6) AS distance
FROM hit
WHERE distance > 1"""))
def error_lines(spark, sf):
    lines = nearest.error_lines(nearest.match_on_layer(_rows(spark, sf), plan_view(spark, sf)))
    return lines.withColumn("distance", _r("distance"))


@query(sql("plan", body="""
SELECT acq_id, axis, CAST(k * 5 AS DOUBLE) AS tick
FROM (SELECT acq_id, 'x' AS axis, floor(min(x) / 5) AS a, ceil(max(x) / 5) AS b
FROM plan
GROUP BY acq_id
UNION ALL SELECT acq_id, 'y', floor(min(y) / 5), ceil(max(y) / 5)
FROM plan
GROUP BY acq_id), generate_series(-10, 10) s(k)
WHERE k BETWEEN a AND b AND k <> 0"""))
def tick_grid(spark, sf):
    plan = plan_view(spark, sf)
    return scene.grid_lines(scene.plan_bounds(display.with_scene_z(plan, plan)), 5.0)


@query(sql("plan", body="""
SELECT p.acq_id, spot_idx, round(CASE WHEN fwhm_x > 0 THEN fwhm_x ELSE coalesce(mx, 4.0) END / 2, 6) AS half_x, round(CASE WHEN fwhm_y > 0 THEN fwhm_y ELSE coalesce(my, 4.0) END / 2, 6) AS half_y
FROM plan p
JOIN (SELECT acq_id, quantile_cont(fwhm_x, 0.5) AS mx, quantile_cont(fwhm_y, 0.5) AS my
FROM plan
GROUP BY acq_id) m ON p.acq_id = m.acq_id"""))
def glyph_sizes(spark, sf):
    return display.glyph_sizes(plan_view(spark, sf)).select("acq_id", "spot_idx", _r("half_x").alias("half_x"), _r("half_y").alias("half_y"))


from . import assignments, details, files  # noqa: E402, F401  they add their queries

__all__ = ["QUERIES"]
