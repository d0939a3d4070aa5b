"""The jobs as registered queries: each runs its job twice into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom.plans.assignments import rounded_export
from beamloom.plans.base import rounded, sql
from beamloom.plans.registry import QUERIES as ENGINE
from jobs import combined_export, delivered_spots
from jobs.common import new_folder

_SPOTS = """
SELECT acq_id, spot AS spot_id, sum(channel * a) / sum(channel) AS a, sum(channel * b) / sum(channel) AS b, sum(channel) AS weight, count(*) AS n_rows,
       sum(channel * sigma_b) FILTER (sigma_b IS NOT NULL) / sum(channel) FILTER (sigma_b IS NOT NULL) AS sigma_b
FROM acq WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY acq_id, spot"""
_LEDGER = """
SELECT acq_id, spot_id, layer, round(a + 1e-10, 6) AS a, round(b + 1e-10, 6) AS b, round(sigma_b + 1e-10, 6) AS sigma_b, round(weight, 6) AS weight, n_rows,
       ex AS expected_x, ey AS expected_y, round(sqrt(d2) + 1e-10, 6) AS distance, CASE WHEN sqrt(d2) <= 1 THEN 'pass' WHEN sqrt(d2) > 3 THEN 'fail' ELSE 'warn' END AS tier
FROM (SELECT s.*, o.layer, p.x AS ex, p.y AS ey, (p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a) AS d2,
             row_number() OVER (PARTITION BY s.acq_id, s.spot_id ORDER BY (p.x - s.b) * (p.x - s.b) + (p.y - s.a) * (p.y - s.a), p.spot_idx) AS k
      FROM measured s JOIN pl o ON o.acq_id = s.acq_id AND o.spot_idx = s.spot_id JOIN pl p ON p.acq_id = s.acq_id AND p.layer = o.layer) WHERE k = 1
UNION ALL
SELECT p.acq_id, p.spot_idx, p.layer, NULL, NULL, NULL, NULL, 0, p.x, p.y, NULL, 'missing'
FROM pl p WHERE p.acq_id IN (SELECT acq_id FROM measured) AND NOT EXISTS (FROM measured s WHERE s.acq_id = p.acq_id AND s.spot_id = p.spot_idx)"""
_TABLES = ("plan", "acq", "layers", "pl")


def job1_delivered_spots(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the incremental job over all samples; the second finds no new file."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        delivered_spots.run(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet", f"{folder}/out", f"{folder}/checkpoint")
    back = spark.read.parquet(f"{folder}/out/spots")
    near = lambda c: rounded(F.col(c) + 1e-10).alias(c)
    return back.select("acq_id", "spot_id", "layer", near("a"), near("b"), near("sigma_b"), rounded("weight").alias("weight"), "n_rows", "expected_x", "expected_y", near("distance"), "tier")


def job2_combined_export(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the export over all acquisitions."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        combined_export.run(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet", f"{folder}/out", combined_export.Settings(flier_sigma=3.0))
    kinds = {"spot_index": "int", "layer_index": "int", "partial_code": "int", "aggregated": "string", "positions_aligned_to_plan": "string"}
    back = spark.read.option("header", True).csv(f"{folder}/out/export")
    return rounded_export(back.select(F.col("acq_id").cast("bigint").alias("acq_id"), *[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in back.columns if c != "acq_id"]))


QUERIES = {
    "job1_delivered_spots": (job1_delivered_spots, sql(*_TABLES, measured=_SPOTS, body=_LEDGER)),
    "job2_combined_export": (job2_combined_export, ENGINE["full_run"][1]),
}
