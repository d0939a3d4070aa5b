"""Queries over depth, colours, display data, captions and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from .. import constants as K
from ..functions import captions, colors, depth, scene
from ..functions import rows as R
from ..operators import alignment, display, layers, nearest, quality
from ..session import ship
from ..sources import names, plans
from ..sources.tables import acquisition_view, plan_view
from .base import DOSE, HIT, SPOT, complete_rows, measured_spots, query, rounded, sql

_TABLE = ", ".join(map(str, K.RANGE_MM))


def _range(e: str) -> str:
    """SQL for the range in water at an energy of the table."""
    i = f"greatest(0, least(67, CAST(floor(({e} - 10) / 5) AS INTEGER)))"
    return f"(tab[{i} + 1] + (tab[{i} + 2] - tab[{i} + 1]) * ({e} - (10 + {i} * 5)) / 5)"


_R80 = "greatest(0, greatest(0, 0.910 * {r} - 1.14) - 12.5)"
_WATER = f"""
SELECT acq_id, spot_idx, round(hi + lo - d, 6) AS scene_z, round(hi, 6) AS top FROM (
  SELECT p.acq_id, spot_idx, {_R80.format(r=_range('energy'))} AS d, {_R80.format(r=_range('e1'))} AS hi, {_R80.format(r=_range('e0'))} AS lo
  FROM plan p JOIN (SELECT acq_id, max(energy) AS e1, min(energy) AS e0 FROM plan GROUP BY acq_id) b USING (acq_id), (SELECT CAST([{_TABLE}] AS DOUBLE[]) AS tab))"""


@query(sql("plan", body=_WATER))
def scene_z_water(spark, sf):
    """Scene heights by R80 in water behind a shifter of 12.5 mm, and the depth of the highest energy."""
    plan = plan_view(spark, sf)
    z = display.with_scene_z(plan, plan, water=True, metric="r80", wet_mm=12.5)
    top = layers.energy_bounds(plan).select("acq_id", rounded(depth.shifted_depth_mm(F.col("e_high"), "r80", 12.5)).alias("top"))
    return z.join(top, "acq_id").select("acq_id", "spot_idx", rounded("scene_z").alias("scene_z"), "top")


@query(sql("plan", body=f"""
SELECT acq_id, spot_idx, round(CASE WHEN hi <> lo THEN 100 + 50 * least(greatest((energy - lo) / (hi - lo), 0), 1) END, 6) AS label
FROM plan
JOIN (SELECT acq_id, max(energy) - 30 AS hi, min(energy) AS lo
FROM plan
GROUP BY acq_id) USING (acq_id)"""))
def axis_labels(spark, sf):
    """Axis labels at heights, held within the axis."""
    plan = plan_view(spark, sf).join(layers.energy_bounds(plan_view(spark, sf)), "acq_id")
    label = depth.label_at(F.col("energy"), F.col("e_low"), F.col("e_high") - 30, F.lit(100.0), F.lit(150.0))
    return plan.select("acq_id", "spot_idx", rounded(label).alias("label"))


@query(sql("plan", "layers", body="""
SELECT acq_id, spot_idx, layer AS nearest_layer FROM (SELECT p.acq_id, p.spot_idx, l.layer, row_number() OVER (PARTITION BY p.acq_id, p.spot_idx ORDER BY abs(l.energy - (p.energy + 2.5)), l.layer) AS k
FROM plan p JOIN layers l ON p.acq_id = l.acq_id) WHERE k = 1"""))
def nearest_layer(spark, sf):
    """The layer with the energy closest to one that lies between two."""
    plan = plan_view(spark, sf)
    rows = plan.withColumn("energy", F.col("energy") + 2.5)
    return layers.nearest_layer_by_energy(rows, layers.layer_table(plan)).select("acq_id", "spot_idx", "nearest_layer")


@query(sql(*SPOT, body="""
SELECT s.acq_id, s.spot_id, round(min(sqrt((p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a))), 6) AS d
FROM spots s
JOIN plan p ON s.acq_id = p.acq_id AND p.energy = 222.5
GROUP BY ALL"""))
def energy_distance(spark, sf):
    """Distance of spots to the spots of one nominal energy."""
    found = nearest.distance_to_energy(measured_spots(spark, sf), plan_view(spark, sf), 222.5)
    return found.filter(F.col("distance_to_energy") != float("inf")).select("acq_id", "spot_id", rounded("distance_to_energy").alias("d"))


_DOSE_TIER = "CASE WHEN abs(d) <= 1 THEN 'pass' WHEN d > 3 THEN 'over_fail' WHEN d > 1 THEN 'over_warn' WHEN d < -3 THEN 'under_fail' WHEN d < -1 THEN 'under_warn' END"
_PAINT = {"pass": (34, 197, 94), "over_warn": (234, 179, 8), "over_fail": (239, 68, 68), "under_warn": (56, 189, 248), "under_fail": (168, 85, 247)}


def _paint(tier: str, part: int) -> str:
    return f"CASE {tier} {' '.join(f'WHEN {chr(39)}{t}{chr(39)} THEN {c[part]}' for t, c in _PAINT.items())} ELSE 0 END"


@query(sql(*DOSE, body=f"""
SELECT acq_id, spot_id, {', '.join(f'{_paint(_DOSE_TIER, k)} AS {n}' for k, n in enumerate(('red', 'green', 'blue')))}, 255 AS alpha
FROM (SELECT *, (mf - pf) * 100 AS d
FROM dose)"""))
def dose_rgba(spark, sf):
    d = quality.dose_fractions(measured_spots(spark, sf), plan_view(spark, sf))
    return colors.by_dose(d).select("acq_id", "spot_id", "red", "green", "blue", "alpha")


@query(sql("acq", body="""
SELECT acq_id, row_idx, alpha, CASE WHEN part > 0 THEN 218 ELSE 214 END AS red, CASE WHEN part > 0 THEN 165 ELSE 39 END AS green, CASE WHEN part > 0 THEN 32 ELSE 40 END AS blue FROM (
  SELECT a.acq_id, row_idx, CASE WHEN a.a IS NULL AND a.b IS NULL THEN -1 WHEN a.a IS NULL THEN 1 WHEN a.b IS NULL THEN 2 ELSE 0 END AS part,
    CAST(floor(255.0 * (0.1 + (0.95 - 0.1) * power(CASE WHEN p96 <= p4 * 1.001 THEN 1.0 ELSE greatest(0.0, least(1.0, (greatest(channel, 1e-18) - p4) / (p96 - p4))) END, 0.5))) AS INTEGER) AS alpha
  FROM acq a JOIN (SELECT acq_id, quantile_cont(channel, 0.04) AS p4, quantile_cont(channel, 0.96) AS p96 FROM acq GROUP BY acq_id) p ON a.acq_id = p.acq_id)"""))
def weight_alpha_rgba(spark, sf):
    """Colours by weight, gold for one-axis rows."""
    rows = R.with_plan_axes(acquisition_view(spark, sf)).withColumn("weight", F.col("channel"))
    return colors.by_weight(rows).select("acq_id", "row_idx", "alpha", "red", "green", "blue")


@query(sql("plan", body="""
SELECT acq_id, spot_idx, 31 AS red, 119 AS green, 180 AS blue, CASE WHEN mu > 950 THEN 115 ELSE 0 END AS alpha
FROM plan"""))
def plan_rgba(spark, sf):
    return colors.plan_visibility(plan_view(spark, sf), F.col("mu") > 950).select("acq_id", "spot_idx", "red", "green", "blue", "alpha")


_HEIGHT = "JOIN (SELECT acq_id, max(energy) + min(energy) AS turn FROM plan GROUP BY acq_id) USING (acq_id)"
_SIGMA = """
JOIN (SELECT acq_id, quantile_cont(sigma_b, 0.5) AS qb, quantile_cont(sigma_a, 0.5) AS qa FROM shown GROUP BY acq_id) USING (acq_id)"""
_SIZES = """
round(greatest(0.02, least(50, 0.5 * coalesce(CASE WHEN sigma_b > 0 THEN sigma_b END, qb, 0.35))), 6) AS half_x, round(greatest(0.02, least(50, 0.5 * coalesce(CASE WHEN sigma_a > 0 THEN sigma_a END, qa, 0.35))), 6) AS half_y"""
_POINTS = f"""
SELECT acq_id, row_idx, turn - l.energy AS scene_z, {_SIZES}, {{red}} AS red
FROM shown
JOIN layers l USING (acq_id, layer) {_HEIGHT} {_SIGMA}"""


@query(sql(*HIT, shown="SELECT * FROM hit WHERE distance > 1", body=_POINTS.format(red="CASE WHEN distance > 3 THEN 239 ELSE 234 END")))
def display_position(spark, sf):
    """Measured points of the position view, passed ones hidden."""
    m = nearest.match_on_layer(complete_rows(spark, sf), plan_view(spark, sf))
    return _points(display.display_measured(m, plan_view(spark, sf), hide=True))


def _points(df: DataFrame, key: str = "row_idx") -> DataFrame:
    return df.select("acq_id", key, "scene_z", rounded("half_x").alias("half_x"), rounded("half_y").alias("half_y"), "red")


@query(sql(*DOSE, shown="SELECT *, first_row AS row_idx FROM dose WHERE abs(mf - pf) * 100 > 1", body=_POINTS.format(red="CASE WHEN (mf - pf) * 100 > 3 THEN 239 WHEN (mf - pf) * 100 > 0 THEN 234 WHEN (mf - pf) * 100 < -3 THEN 168 ELSE 56 END")))
def display_dose(spark, sf):
    """Measured spots of the dose view, passed ones hidden."""
    d = quality.dose_fractions(measured_spots(spark, sf), plan_view(spark, sf))
    return _points(display.display_measured(d, plan_view(spark, sf), hide=True, colour="dose"))


@query(sql(*SPOT, shown="SELECT *, first_row AS row_idx FROM spots", body=_POINTS.format(red="214")))
def display_weight(spark, sf):
    """Measured spots of the view coloured by weight."""
    return _points(display.display_measured(measured_spots(spark, sf), plan_view(spark, sf), colour="weight"))


@query(sql(*HIT, body=f"""
SELECT acq_id, row_idx, mx AS x0, my AS y0, turn - l.energy AS z0, ex AS x1, ey AS y1, turn - ee AS z1 FROM hit JOIN layers l USING (acq_id, layer) {_HEIGHT} WHERE distance > 1"""))
def error_segments(spark, sf):
    return display.error_segments(nearest.match_on_layer(complete_rows(spark, sf), plan_view(spark, sf)), plan_view(spark, sf))


_GONE = """
SELECT p.*
FROM plan p ANTI JOIN (SELECT *
FROM rows
WHERE sigma_b IS NOT NULL) r ON p.acq_id = r.acq_id AND p.spot_idx = r.spot_id AND p.spot_idx % 5 <> 0"""


def _gone(spark, sf) -> DataFrame:
    from ..operators.spots import uncovered

    rows = complete_rows(spark, sf).filter("sigma_b is not null and spot_id % 5 <> 0").withColumn("plan_idx", F.col("spot_id"))
    return uncovered(plan_view(spark, sf), rows)


@query(sql(*SPOT[:6], gone=_GONE, body=f"""
SELECT acq_id, spot_idx, turn - energy AS scene_z, g.spot_idx IS NOT NULL AS missing FROM plan LEFT JOIN gone g USING (acq_id, spot_idx) {_HEIGHT}""".replace("turn - energy", "turn - plan.energy")))
def display_plan(spark, sf):
    """Plan points of the view, and whether nothing was delivered to them (every fifth spot counts as missed)."""
    return display.display_plan(plan_view(spark, sf), _gone(spark, sf)).select("acq_id", "spot_idx", "scene_z", "missing")


@query(sql(*SPOT[:6], gone=_GONE, body="""
SELECT acq_id, spot_idx, x - 1 AS x0, y + 0.0 AS y0, x + 1 AS x1, y + 0.0 AS y1 FROM gone UNION ALL SELECT acq_id, spot_idx, x + 0.0, y - 1, x + 0.0, y + 1 FROM gone"""))
def missing_crosses(spark, sf):
    plus = lambda c: (F.col(c) + F.lit(0.0)).alias(c)
    return display.crosses(_gone(spark, sf)).select("acq_id", "spot_idx", *map(plus, ("x0", "y0", "x1", "y1")))


@query(sql(*SPOT[:6], body="""
SELECT acq_id, row_idx, l.energy AS nominal_energy, t
FROM rows
JOIN layers l USING (acq_id, layer)
WHERE l.energy BETWEEN 150 AND 215 AND t BETWEEN 20.0 AND 80.0"""))
def energy_and_time_slice(spark, sf):
    cloud = display.measured_cloud(complete_rows(spark, sf), plan_view(spark, sf))
    return display.sliced(cloud, (215.0, 150.0), 20.0, 60.0).select("acq_id", "row_idx", "nominal_energy", "t")


@query(sql("acq", body="SELECT acq_id, row_idx, t FROM acq WHERE t BETWEEN 3.0 AND 60.0"))
def cumulative_time_slice(spark, sf):
    """A window of -1: everything from the first time to the chosen one."""
    return display.sliced(acquisition_view(spark, sf), None, 60.0, -1, t_min=3.0).select("acq_id", "row_idx", "t")


@query(sql(*SPOT, body="""
SELECT acq_id, row_idx
FROM (SELECT *, row_number() OVER (PARTITION BY acq_id ORDER BY row_idx) AS n
FROM rows)
WHERE n <= 1000"""))
def first_points(spark, sf):
    """The display's limit of measured points."""
    return display.measured_cloud(complete_rows(spark, sf), plan_view(spark, sf), most=1000).select("acq_id", "row_idx")


@query(sql("acq", body="""
SELECT acq_id, row_idx, printf('%d:%04.1f', CAST(floor(round(t, 1) / 60) AS BIGINT), round(t, 1) - 60 * floor(round(t, 1) / 60)) AS clock
FROM acq"""))
def timeline_clock(spark, sf):
    return acquisition_view(spark, sf).select("acq_id", "row_idx", captions.timeline_column(F.round("t", 1)).alias("clock"))


_RECORD = """
SELECT acq_id, spot_id AS spot, u.place, u.label, u.value FROM (SELECT acq_id, spot_id, unnest([
  {'place': 0, 'label': 'Fit A', 'value': format('{:.3f} mm', a)}, {'place': 1, 'label': 'Fit B', 'value': format('{:.3f} mm', b)}, {'place': 2, 'label': 'Layer index', 'value': format('{:.0f}', layer)},
  {'place': 3, 'label': 'Spot weight', 'value': format('{:.4g}', weight)}, {'place': 4, 'label': 'Partial code', 'value': '0'}, {'place': 5, 'label': 'σ A', 'value': format('{:.3g} mm', sigma_a)},
  {'place': 6, 'label': 'σ B', 'value': coalesce(format('{:.3g} mm', sigma_b), '— mm')}, {'place': 7, 'label': 'Delivery time', 'value': format('{:.3f} s', t)}]) AS u
FROM spots_)"""


@query(sql(*SPOT, spots_="SELECT acq_id, spot_id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, layer, weight, round(sigma_a, 6) AS sigma_a, round(sigma_b, 6) AS sigma_b, round(t, 6) AS t FROM spots", body=_RECORD))
def spot_record(spark, sf):
    """Records of measured spots as they are shown (of values rounded to six decimals)."""
    plain = measured_spots(spark, sf)
    plain = plain.select("acq_id", "spot_id", *[rounded(c).alias(c) if c in ("a", "b", "sigma_a", "sigma_b", "t") else F.col(c) for c in ("a", "b", "layer", "weight", "partial", "sigma_a", "sigma_b", "t")])
    return captions.spot_details(plain)


@query(sql("plan", body="""
SELECT acq_id, spot_idx AS spot, u.place, u.label, u.value FROM (SELECT acq_id, spot_idx, unnest([
  {'place': 0, 'label': 'X', 'value': format('{:.3f} mm', x)}, {'place': 1, 'label': 'Y', 'value': format('{:.3f} mm', y)}, {'place': 2, 'label': 'Nominal energy', 'value': format('{:.3f} MeV', energy)},
  {'place': 3, 'label': 'Plan MU', 'value': format('{:.4g}', CAST(mu AS DOUBLE))}, {'place': 4, 'label': 'FWHM X', 'value': coalesce(format('{:.3g} mm', fwhm_x), '— mm')}]) AS u FROM plan)"""))
def plan_record(spark, sf):
    """Records of plan spots as they are shown."""
    return captions.spot_details(plan_view(spark, sf).drop("fwhm_y"), "plan")


@query(sql("plan", body="""
SELECT acq_id, axis, floor(lo / 7) * 7 AS low, ceil(hi / 7) * 7 AS high FROM (
  SELECT acq_id, 'x' AS axis, min(x) AS lo, max(x) AS hi FROM plan GROUP BY acq_id UNION ALL SELECT acq_id, 'y', min(y), max(y) FROM plan GROUP BY acq_id)"""))
def grid_extent(spark, sf):
    """Bounds of plans moved out to multiples of 7 mm."""
    b = scene.plan_bounds(display.with_scene_z(plan_view(spark, sf), plan_view(spark, sf)))
    x, y = scene.grown_columns(F.col("x_min"), F.col("x_max"), 7.0), scene.grown_columns(F.col("y_min"), F.col("y_max"), 7.0)
    side = lambda axis, c: b.select("acq_id", F.lit(axis).alias("axis"), c[0].alias("low"), c[1].alias("high"))
    return side("x", x).unionByName(side("y", y))


def _examples(spark: SparkSession, items: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in items.items()], "what string, value string")


def _expected(items: dict[str, str]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in items.items()) + ") t(what, value)"


_INPUTS = {
    "gap 0.2": "0.2", "gap 0": "None", "gap 3600": "None", "gap 1,5": "1.5", "gap x": "None", "tolerance 3": "3.0", "tolerance 1000": "None", "on weight 0": "0.0", "on weight -1": "None", "rows 2": "2",
    "rows 2.5": "None", "rows 0": "None", "rows 10000": "10000", "penalty 0": "0.0", "penalty 1e8": "100000000.0", "penalty 2e8": "None", "wet 500": "500.0", "wet 501": "None", "sigma 0.5": "0.5",
    "sigma 20": "20.0", "sigma 0.4": "None", "typing 0.": "True", "typing 1": "False", "typing -": "True", "typing thresholds": "True", "thresholds 1 3": "(1.0, 3.0)", "thresholds 3 1": "None",
    "thresholds 1 501": "None", "weight Fit-A": "fit_amplitude_a", "saved weight what": "channel_sum", "layer AUTO": "auto", "chosen time_gap": "gate_counter", "chosen sequential": "('auto', 'plan_sequential', True)",
    "resolved without gate": "time_gap", "resolved without plan": "time_gap", "resolved unknown": "gate_counter",
}


@query(_expected(_INPUTS))
def input_rules(spark, sf):
    """What typed settings become, by example."""
    p = config.parse
    got = {
        "gap 0.2": p("layer_gap_s", "0.2"), "gap 0": p("layer_gap_s", "0"), "gap 3600": p("layer_gap_s", "3600"), "gap 1,5": p("layer_gap_s", "1,5"), "gap x": p("layer_gap_s", "x"),
        "tolerance 3": p("refill_tolerance_mm", "3"), "tolerance 1000": p("refill_tolerance_mm", "1000"), "on weight 0": p("min_on_weight_na", "0"), "on weight -1": p("min_on_weight_na", "-1"),
        "rows 2": p("min_episode_rows", "2"), "rows 2.5": p("min_episode_rows", "2.5"), "rows 0": p("min_episode_rows", "0"), "rows 10000": p("min_episode_rows", "10000"),
        "penalty 0": p("penalty_mm2", "0"), "penalty 1e8": p("penalty_mm2", "1e8"), "penalty 2e8": p("penalty_mm2", "2e8"), "wet 500": p("wet_mm", "500"), "wet 501": p("wet_mm", "501"),
        "sigma 0.5": p("flier_sigma", "0.5"), "sigma 20": p("flier_sigma", "20"), "sigma 0.4": p("flier_sigma", "0.4"), "typing 0.": config.in_progress("0."), "typing 1": config.in_progress("1"),
        "typing -": config.in_progress("-"), "typing thresholds": config.thresholds_in_progress("1", "3."), "thresholds 1 3": config.parse_thresholds("1", "3"),
        "thresholds 3 1": config.parse_thresholds("3", "1"), "thresholds 1 501": config.parse_thresholds("1", "501"), "weight Fit-A": config.weight_mode("Fit-A"), "saved weight what": config.saved_weight_mode("what"),
        "layer AUTO": config.layer_mode("AUTO"), "chosen time_gap": config.chosen_mode("time_gap"), "chosen sequential": config.chosen_assignment("plan_sequential"),
        "resolved without gate": config.resolved_mode("gate_counter", False, True), "resolved without plan": config.resolved_mode("auto", True, False), "resolved unknown": config.resolved_mode("?", True, True),
    }
    return _examples(spark, got)


_TEXTS = {
    "weight": "Fit amplitude A (nA)", "counts": "pass 5 / warn 2 / fail 1", "clock 75.25": "1:15.2", "clock none": "—", "number": "1235", "number none": "—", "replay": "150", "replay back": "0",
    "metric R90": "r90", "metric ?": "csda", "labels 0 100 5": "11", "labels flat": "5", "ends": "(0.0, 6.0)", "axis": "('Water depth (mm)', 0.0, 10.0, 40.0, 90.0, 11)", "label": "-12",
    "beyond": "(0.0, -4.0, 0.0)", "moved": "(1.0, 2.5, 0.0)", "grown": "(-10, 30)", "ticks": "(-20.0, -10.0, 10.0, 20.0)", "perimeter": "4", "perimeter labels": "8", "zero axes": "((0.0, -10.0, 0), (0.0, 10.0, 0))",
    "grid": "(2, 10, 24)", "colour": "(34, 197, 94)", "colour ?": "(214, 39, 40)", "seeds 200000": "(0, 90, 180, 270)", "seeds 60000": "8", "seeds 20000": "12", "seeds 9": "24", "orientations": "8",
    "stem": "run.1", "stem gz": "run", "acquisition gz": "True", "acquisition txt": "False", "tag": "T0G10_5kHz", "plan label": "T0G10", "cube": "P1", "export": "run-spots-agg.csv", "plan header": "True",
    "other header": "False", "column": "X_POSITION", "ion plan": "True", "tag text": "a_b.c-d",
}


@query(_expected(_TEXTS))
def text_rules(spark, sf):
    """Captions, axes, grids and file names, by example."""
    frame = scene.Frame(-7, 23, -4, 9, 0, 10)
    grid, axis = scene.plan_grid(frame), depth.axis_spec([(0.0, 40.0), (10.0, 90.0)], True)
    got = {
        "weight": captions.weight_caption("fit_amplitude_a"), "counts": captions.counts_label(5, 2, 1), "clock 75.25": captions.timeline(75.25), "clock none": captions.timeline(float("nan")),
        "number": captions.number(1234.5678), "number none": captions.number(None), "replay": captions.playback_start(0, 100, 2.0, 0, 150), "replay back": captions.playback_start(0, 100, -2.0, 0, 150),
        "metric R90": depth.metric("R90 "), "metric ?": depth.metric("?"), "labels 0 100 5": depth.axis_label_count(0, 100, 5), "labels flat": depth.axis_label_count(0, 1, 0),
        "ends": depth.end_labels([(0, 1), (0, 2), (10, 4)], -10, 20), "axis": (axis["title"], axis["z_min"], axis["z_max"], axis["label_at_min"], axis["label_at_max"], axis["n_labels"]),
        "label": scene.label(-12.4), "beyond": tuple(map(float, scene.beyond((0, 0, 0), (0, 10, 0), 4))), "moved": tuple(map(float, scene.moved((1, 2, 0), dy=0.5))), "grown": scene.grown(-7, 23, 10),
        "ticks": scene.ticks(-25, 25, 10), "perimeter": len(scene.perimeter(frame)), "perimeter labels": len(scene.perimeter_labels(frame)), "zero axes": scene.zero_axes(frame)[0],
        "grid": (len(grid.major), len(grid.minor), len(grid.labels)), "colour": colors.rgb("#22c55e"), "colour ?": colors.rgb("xyz"), "seeds 200000": alignment.seed_degrees(200_000),
        "seeds 60000": len(alignment.seed_degrees(60_000)), "seeds 20000": len(alignment.seed_degrees(20_000)), "seeds 9": len(alignment.seed_degrees(9)), "orientations": len(set(alignment.ORIENTATIONS)),
        "stem": names.acquisition_stem("/x/run.1.csv"), "stem gz": names.acquisition_stem("run.CSV.GZ"), "acquisition gz": names.is_acquisition("a.csv.gz"), "acquisition txt": names.is_acquisition("a.txt"),
        "tag": names.plan_tag("15186535_T0G10_5kHz_01"), "plan label": names.plan_label("15186535_T0G10_5kHz_01"), "cube": names.csv_plan_label("P1_cube_2"), "export": names.default_export_name("run.csv", True),
        "plan header": plans.plan_columns("#ENERGY(MeV),X_POSITION(mm),Y_POSITION(mm)") is not None, "other header": plans.plan_columns("ENERGY,X_POSITION") is not None, "column": plans.plan_column("# X_Position (mm)"),
        "ion plan": plans.is_ion_plan("p.DCM"), "tag text": plans.export_tag("a b.c-d"),
    }
    return _examples(spark, got)


_CAPTIONS = """
SELECT acq_id, format('Position QA: {} pass ({:.1f} %, up to 1 mm), {} warn ({:.1f} %, up to 3 mm), {} fail ({:.1f} %)', p, 100.0 * p / n, w, 100.0 * w / n, f, 100.0 * f / n) AS caption
FROM (SELECT acq_id, count(*) FILTER (distance <= 1) AS p, count(*) FILTER (distance > 1 AND distance <= 3) AS w, count(*) FILTER (distance > 3) AS f, count(*) AS n FROM hit GROUP BY acq_id)"""


@query(sql(*HIT, body=_CAPTIONS))
def position_captions(spark, sf):
    """Captions of position quality; counts are a row for each acquisition."""
    ship(spark)
    c = quality.position_counts(nearest.match_on_layer(complete_rows(spark, sf), plan_view(spark, sf)))
    return c.select("acq_id", captions.position_captions("n_pass", "n_warn", "n_fail").alias("caption"))


@query(sql(*DOSE, body="""
SELECT acq_id, count(*) FILTER (abs(d) <= 0.3) AS n_pass, count(*) FILTER (abs(d) > 0.3 AND abs(d) <= 1) AS n_warn, count(*) FILTER (abs(d) > 1) AS n_fail FROM (SELECT *, (mf - pf) * 100 AS d FROM dose) GROUP BY ALL"""))
def dose_qa_merged(spark, sf):
    """Dose tiers, too much and too little together."""
    return quality.merged_dose_counts(quality.dose_fractions(measured_spots(spark, sf), plan_view(spark, sf)), 0.3, 1.0)

