"""The combined export of many acquisitions, and one line on the quality of each.

    python -m jobs.combined_export --samples PATH --plan PATH --out DIR [--config FILE]

Runs the whole dataflow (assignment of samples to spots, flier filter, aggregation, match to the plan) over all
acquisitions, or those from ``first`` to ``last``, and writes

    out/spots/acq_id=N      measured spots with their doses (Parquet)
    out/export/acq_id=N     the export table of 19 columns (CSV with a header), made from the written spots
    out/summary/acq_id=N    tiers of position and dose, spots without samples (Parquet)

by dynamic partition overwrite: a rerun, or a run over some acquisitions, replaces theirs and leaves the others alone.
An acquisition without a measured spot gets no export, and its older one, if any, stays; its summary has n_spots 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom import constants as K
from beamloom.config import Config
from beamloom.operators import quality
from beamloom.plans import pipeline
from beamloom.sources.tables import acquisitions_of, plans_of
from beamloom.sources.workspace import landed
from jobs.common import command_line, log, settings


@dataclass(frozen=True)
class Settings:
    """Settings of a run, and the first and last acquisition to take (both included; none: no bound)."""

    layer_mode: str = "gate_counter"
    weight_mode: str = "channel_sum"
    flier_sigma: float | None = None
    pass_mm: float = K.PASS_MM
    warn_mm: float = K.WARN_MM
    pass_pp: float = K.PASS_PP
    warn_pp: float = K.WARN_PP
    first: int | None = None
    last: int | None = None

    def config(self) -> Config:
        quality.check_thresholds(self.pass_mm, self.warn_mm)
        quality.check_thresholds(self.pass_pp, self.warn_pp)
        return Config(layer_mode=self.layer_mode, weight_mode=self.weight_mode, flier_sigma=self.flier_sigma, pass_mm=self.pass_mm, warn_mm=self.warn_mm, pass_pp=self.pass_pp, warn_pp=self.warn_pp)


def _write(table: DataFrame, path: str, kind: str, **options) -> None:
    """Rows of an acquisition lie together; a very large one is spread over several files."""
    near = table.hint("rebalance", "acq_id")
    near.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy("acq_id").format(kind).save(path)


def summary(doses: DataFrame, plan: DataFrame, missing: DataFrame, config: Config) -> DataFrame:
    """(acq_id, n_planned, n_missing, n_spots, n_pass, n_warn, n_fail, n_dose_pass, n_dose_warn, n_dose_fail)."""
    tier = quality.position_tier(F.col("distance"), config.pass_mm, config.warn_mm)
    counts = doses.withColumn("_tier", tier).groupBy("acq_id").agg(F.count(F.lit(1)).alias("n_spots"), *[F.count_if(F.col("_tier") == t).alias(f"n_{t}") for t in ("pass", "warn", "fail")])
    dose = quality.merged_dose_counts(doses, config.pass_pp, config.warn_pp).select("acq_id", *[F.col(f"n_{t}").alias(f"n_dose_{t}") for t in ("pass", "warn", "fail")])
    planned = plan.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n_planned")).join(missing.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n_missing")), "acq_id", "left")
    return planned.join(counts, "acq_id", "left").join(dose, "acq_id", "left").fillna(0)


def run(spark: SparkSession, samples: str, plan: str, out: str, s: Settings = Settings()) -> int:
    """Write spots, export and summary; the number of exported spots."""
    config, inside = s.config(), F.lit(True)
    if s.first is not None:
        inside &= F.col("acq_id") >= s.first
    if s.last is not None:
        inside &= F.col("acq_id") <= s.last
    rows, planned = acquisitions_of(spark.read.parquet(samples)).filter(inside), plans_of(spark.read.parquet(plan)).filter(inside)
    result = pipeline.run(rows, planned, config, keep=landed)
    acquisition = dict(rows.dtypes)["acq_id"]
    _write(result.measured, f"{out}/spots", "parquet")
    measured = spark.read.parquet(f"{out}/spots").withColumn("acq_id", F.col("acq_id").cast(acquisition)).filter(inside)
    result = replace(result, measured=measured)
    table = pipeline.export(result, config)
    _write(table, f"{out}/export", "csv", header=True)
    lines = summary(quality.dose_fractions(measured, planned), planned, result.missing, config)
    _write(lines, f"{out}/summary", "parquet")
    there = spark.read.parquet(f"{out}/summary").filter(inside).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("n_planned", "n_missing", "n_spots", "n_fail", "n_dose_fail")]).first()
    log.info("read %s: %d acquisitions, %d planned spots", samples, there["n"], there["n_planned"] or 0)
    log.info("wrote %s: %d spots, %d beyond the position threshold, %d beyond the dose threshold, %d missing", out, *[there[c] or 0 for c in ("n_spots", "n_fail", "n_dose_fail", "n_missing")])
    return there["n_spots"] or 0


def main() -> None:
    paths = {"samples": "Parquet table of samples", "plan": "Parquet table of planned spots", "out": "folder to write to"}
    spark, given = command_line("combined_export", __doc__.split("\n", 1)[0], paths)
    try:
        config = settings(spark, given.pop("config"), Settings)
        run(spark, **given, s=config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
