"""Queries through files: each writes the views in a file format and reads them back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config
from ..sources import acquisition, export, names, plans
from ..sources.partitions import partitions
from ..sources.tables import acquisition_view, plan_view
from ..sources.workspace import workspace
from . import pipeline
from .base import DOSE, measured_spots, query, rounded, sql

_CELLS = {K.TIME: "t", K.POSITION_A: "a", K.POSITION_B: "b", K.CHANNEL_SUM: "channel", K.FIT_AMPLITUDE_A: "fit_a", K.FIT_AMPLITUDE_B: "fit_b", K.SIGMA_A: "sigma_a", K.SIGMA_B: "sigma_b", K.GATE_COUNTER: "gate"}


def _acquisition_file(spark, sf) -> str:
    """All rows of the view as one gzipped acquisition, large ones in several files; missing cells are empty, blank or words."""
    path = f"{workspace(spark)}/run 7.csv.gz"
    rows = acquisition_view(spark, sf)
    blank = F.when(F.col("row_idx") % 3 == 0, "  ").when(F.col("row_idx") % 3 == 1, "none")
    cells = [F.coalesce(F.col(c).cast("string"), blank).alias(name) for name, c in _CELLS.items()]
    n = partitions(rows)
    dealt = rows.repartitionByRange(n, "acq_id", "row_idx") if n else rows.repartition(1)
    dealt.sortWithinPartitions("acq_id", "row_idx").select(*cells).write.option("header", True).option("compression", "gzip").csv(path)
    return path


_ONE = "SELECT *, row_number() OVER (ORDER BY acq_id, row_idx) - 1 AS n FROM acq"


@query(sql("acq", one=_ONE, body="""
SELECT 'run 7' AS acq_id, CAST(n AS BIGINT) AS row_idx, round(t, 6) AS t, round(a, 6) AS a, round(b, 6) AS b, channel, round(fit_a, 6) AS fit_a, round(sigma_b, 6) AS sigma_b, gate
FROM one"""))
def acquisition_csv(spark, sf):
    """A gzipped acquisition file, read back; its name gives the acquisition."""
    path = _acquisition_file(spark, sf)
    text = acquisition.read_text(spark, path)
    acquisition.check_columns(text.columns, "fit_amplitude_b", auto=True)
    if not acquisition.has_gate_counter(text.columns):
        raise ValueError("the gate counter is lost")
    got = acquisition.read_acquisition(spark, path)
    return got.select("acq_id", "row_idx", *[rounded(c).alias(c) for c in ("t", "a", "b")], "channel", rounded("fit_a").alias("fit_a"), rounded("sigma_b").alias("sigma_b"), "gate")


@query(sql("acq", one=_ONE, body="""
SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS row_idx, round(a, 6) AS a, round(b, 6) AS b
FROM one
WHERE n < 5000 AND n % 4 <> 0"""))
def auto_columns_csv(spark, sf):
    """Rows of auto mode from a file: those with a fit (here three of four) of the first 5000, numbered again."""
    rows = acquisition.first_rows(acquisition.read_acquisition(spark, _acquisition_file(spark, sf)), 5000)
    lacking = rows.withColumn("fit_a", F.when(F.col("row_idx") % 4 != 0, F.col("fit_a")))
    return acquisition.numbered(acquisition.signal_rows(lacking)).select("row_idx", rounded("a").alias("a"), rounded("b").alias("b"))


@query(sql("acq", body="""
SELECT acq_id, row_idx, round(t, 6) AS t, round(a, 6) AS a, round(b, 6) AS b, channel, gate FROM acq"""))
def acquisition_files(spark, sf):
    """A file for each acquisition, written in parallel, and all of them read at once with their lines' numbers."""
    path = f"{workspace(spark)}/acquisitions"
    cells = [F.col(c).cast("string").alias(name) for name, c in _CELLS.items()]
    rows = acquisition_view(spark, sf).repartition("acq_id").sortWithinPartitions("acq_id", "row_idx").select("acq_id", *cells)
    rows.write.partitionBy("acq_id").option("header", True).csv(path)
    got = acquisition.read_acquisitions(spark, path, F.regexp_extract("_file", "acq_id=([0-9]+)/", 1).cast("bigint"))
    return got.select("acq_id", "row_idx", *[rounded(c).alias(c) for c in ("t", "a", "b")], "channel", "gate")


_PLAN_ONE = "SELECT *, row_number() OVER (ORDER BY acq_id, spot_idx) - 1 AS n FROM plan"


@query(sql("plan", one=_PLAN_ONE, body="""
SELECT 'P9_cube' AS plan_id, CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS spot_idx, x, y, energy, CAST(mu AS DOUBLE) AS mu, round(fwhm_x, 6) AS fwhm
FROM one
WHERE n % 11 <> 0"""))
def plan_csv(spark, sf):
    """A plan file with units and a mark in its header; slots without a charge (every eleventh) are left out."""
    path = f"{workspace(spark)}/P9_cube.csv"
    p = plan_view(spark, sf)
    n = F.col("acq_id") * 500 + F.col("spot_idx")
    first = p.agg(F.min(n)).first()[0] or 0
    cells = [F.col("energy").alias("#ENERGY(MeV)"), F.col("x").alias("X_POSITION (mm)"), F.col("y").alias("Y_POSITION (mm)"), F.when((n - first) % 11 != 0, F.col("mu")).otherwise(0).alias("CHARGE_REQ"), F.col("fwhm_x").alias("beam_size")]
    p.repartition(1).sortWithinPartitions("acq_id", "spot_idx").select(*cells).write.option("header", True).csv(path)
    if not (plans.is_supported(spark, path) and plans.label_of(spark, path) == "P9"):
        raise ValueError("the plan file is not known as one")
    return plans.read_plan(spark, path).select("plan_id", "spot_idx", "x", "y", "energy", "mu", rounded("fwhm_x").alias("fwhm"))


def _nested(spark, sf) -> DataFrame:
    """The plan view as nested ion plans through JSON: one beam, a control point for each run of 25 spots."""
    path = f"{workspace(spark)}/nested"
    spots = plan_view(spark, sf).withColumn("point", F.floor(F.col("spot_idx") / 25))
    ordered = spots.groupBy(F.col("acq_id").cast("string").alias("plan_id"), "point").agg(F.sort_array(F.collect_list(F.struct("spot_idx", "x", "y", "energy", "mu"))).alias("s"))
    point = F.struct(
        F.size("s").alias("n"), F.col("s")[0]["energy"].alias("energy"), F.flatten(F.transform("s", lambda v: F.array(v["x"], v["y"]))).alias("xy"),
        F.transform("s", lambda v: F.when(v["spot_idx"] % 9 != 0, v["mu"].cast("double")).otherwise(0.0)).alias("weights"), F.array(F.lit(7.0), F.when(F.col("point") % 2 == 0, 600.0).otherwise(8.0)).alias("size"),
    )
    beams = ordered.groupBy("plan_id").agg(F.array(F.transform(F.sort_array(F.collect_list(F.struct("point", point.alias("p")))), lambda v: v["p"])).alias("beams"))
    beams.write.json(path)
    return spark.read.schema(plans.NESTED).json(path)


@query(sql("plan", body="""
SELECT CAST(acq_id AS VARCHAR) AS plan_id, CAST(row_number() OVER (PARTITION BY acq_id ORDER BY spot_idx) - 1 AS BIGINT) AS spot_idx, x, y, energy, CAST(mu AS DOUBLE) AS mu,
       CAST(CASE WHEN floor(spot_idx / 25) % 2 = 1 THEN 7 END AS DOUBLE) AS fwhm_x, CAST(CASE WHEN floor(spot_idx / 25) % 2 = 1 THEN 8 END AS DOUBLE) AS fwhm_y FROM plan WHERE spot_idx % 9 <> 0"""))
def plan_nested(spark, sf):
    """Slots of nested plans: control points with sizes in and out of range, slots without weight."""
    return plans.kept_slots(plans.nested_slots(_nested(spark, sf)), weightless=True)


@query(sql("plan", body="""
SELECT CAST(acq_id AS VARCHAR) AS plan_id, count(*) AS n_raw, count(*) FILTER (spot_idx % 9 <> 0) AS n_kept
FROM plan
GROUP BY acq_id"""))
def plan_slot_counts(spark, sf):
    return plans.slot_counts(plans.nested_slots(_nested(spark, sf)), weightless=True)


_NAMES = """
SELECT p_partkey, stem, label, plan_path FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'run' || p_partkey ELSE '15186535_T0G' || (p_partkey % 12) || CASE WHEN p_partkey % 2 = 0 THEN '_5kHz' ELSE '' END || '_' || p_partkey END AS stem FROM part) n
LEFT JOIN (SELECT 'T0G' || g AS label, '/plans/T0G' || g || '_a.dcm' AS plan_path FROM range(0, 8) r(g)) p ON p.label = upper(nullif(regexp_extract(regexp_extract(n.stem, '^15186535_(T0G\\d+(?:_\\d+kHz)?)_', 1), 'T0G\\d+', 0), ''))"""


@query(_NAMES.replace("SELECT p_partkey, stem, label, plan_path", "SELECT p_partkey, stem, upper(nullif(regexp_extract(regexp_extract(n.stem, '^15186535_(T0G\\d+(?:_\\d+kHz)?)_', 1), 'T0G\\d+', 0), '')) AS label, plan_path"))
def files_to_plans(spark, sf):
    """Acquisition file names, the plan labels in them, and the first plan file of each label."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    k = F.col("p_partkey")
    tagged = F.concat(F.lit("15186535_T0G"), (k % 12).cast("string"), F.when(k % 2 == 0, "_5kHz").otherwise(""), F.lit("_"), k.cast("string"))
    stem = F.when(k % 3 == 0, F.concat(F.lit("run"), k.cast("string"))).otherwise(tagged)
    path = F.concat(F.lit("/in/"), stem, F.when(k % 2 == 0, ".csv").otherwise(".CSV.gz"))
    files = part.withColumn("path", path).withColumn("stem", names.acquisition_stem_column(F.col("path")))
    listed = spark.range(8).select(F.concat(F.lit("T0G"), "id").alias("label"), F.explode(F.array(*[F.concat(F.lit("/plans/T0G"), F.col("id").cast("string"), F.lit(f"_{v}.dcm")) for v in "ba"])).alias("path"))
    return names.match_plans(files, listed).select("p_partkey", "stem", "label", "plan_path")


@query(sql(*DOSE, body="""
SELECT CAST(row_number() OVER (PARTITION BY d.acq_id ORDER BY first_row) AS INTEGER) AS spot_index, CAST(d.layer AS INTEGER) AS layer_index, l.energy AS nominal_energy_mev, round(a, 9) AS measured_fit_a_mm,
       round(weight, 9) AS spot_weight, 0 AS partial_code, round(sigma_b, 9) AS sigma_b_mm, 'no' AS positions_aligned_to_plan FROM dose d JOIN layers l ON d.acq_id = l.acq_id AND d.layer = l.layer"""))
def export_csv(spark, sf):
    """The combined export as CSV files, read back."""
    path, m = f"{workspace(spark)}/export", measured_spots(spark, sf)
    table = pipeline.export(pipeline.Result(plan_view(spark, sf), m, m, m, m, m, "gate_counter", None, None), Config())
    export.write_export(table, path)
    back = spark.read.option("header", True).csv(path)
    if tuple(back.columns) != K.EXPORT_COLUMNS:
        raise ValueError("the export's columns are others")
    number = lambda c, kind="double": F.col(c).cast(kind)
    return back.select(
        number("spot_index", "int").alias("spot_index"), number("layer_index", "int").alias("layer_index"), number("nominal_energy_mev").alias("nominal_energy_mev"), rounded(number("measured_fit_a_mm"), 9).alias("measured_fit_a_mm"),
        rounded(number("spot_weight"), 9).alias("spot_weight"), number("partial_code", "int").alias("partial_code"), rounded(number("sigma_b_mm"), 9).alias("sigma_b_mm"), "positions_aligned_to_plan",
    )


@query("SELECT true AS fresh")
def file_modification(spark, sf):
    """Whether a file that has just been written was modified within a day."""
    path = f"{workspace(spark)}/one"
    spark.range(1).repartition(1).write.csv(path)
    return names.file_times(spark, path).filter("path like '%part-%'").select((F.col("modified") > F.current_timestamp() - F.expr("interval 1 day")).alias("fresh"))
