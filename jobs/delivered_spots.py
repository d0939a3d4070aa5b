"""Delivered spots, kept up to date while files of samples arrive.

    python -m jobs.delivered_spots --samples PATH --plan PATH --out DIR --checkpoint DIR [--config FILE]

Each run takes the files of samples that no run has taken before (a file stream with its checkpoint, until all that is
there is read), whatever acquisitions they are of. Samples with both positions become sums by acquisition and spot, which
are all that is kept of them: an acquisition may be spread over any number of files and runs. From the sums come the
measured spots, the nearest planned spot of their layer, and a tier of position quality; planned spots without samples
have the tier "missing". Only groups of acquisitions that new samples belong to are written again.

    out/sums/acq_group=G/batch=B     sums of one batch of new files
    out/spots/acq_group=G            one row for each spot: measured, or planned and missing

Both are written by dynamic partition overwrite. A batch that is run again, after a failure, has the same files and so
writes the same partitions again; a run without new files writes nothing. Floating sums may differ in their last places.

The number of the spot is that of the gate counter, which is 2 k + 1 while spot k is delivered; samples between spots
(even numbers), without a counter, or without both positions are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamloom import constants as K
from beamloom.functions import rows as R
from beamloom.operators import layers, nearest, quality, spots
from beamloom.sources.tables import plans_of, samples_of
from jobs.common import command_line, log, settings, written


@dataclass(frozen=True)
class Settings:
    """``groups``: into how many partitions acquisitions are dealt; ``files_at_once``: most new files in a batch, 0 for all."""

    weight_mode: str = "channel_sum"
    a_is_x: bool = False
    pass_mm: float = K.PASS_MM
    warn_mm: float = K.WARN_MM
    groups: int = 16
    files_at_once: int = 0

    def __post_init__(self):
        quality.check_thresholds(self.pass_mm, self.warn_mm)
        if self.weight_mode not in R.WEIGHT_MODES or self.groups < 1 or self.files_at_once < 0:
            raise ValueError("the weight mode is unknown, or a number is out of its range")


def group_of(groups: int):
    return F.pmod(F.xxhash64("acq_id"), F.lit(groups)).cast("int")


def sums_of(samples: DataFrame, s: Settings) -> DataFrame:
    """Sums of the samples of odd gates that have both positions."""
    gated = samples.filter(F.pmod("gate", F.lit(2)) == 1).withColumn("spot_id", ((F.col("gate") - 1) / 2).cast("bigint"))
    rows = R.with_plan_axes(gated, s.a_is_x).filter(R.position_ok())
    return spots.spot_sums(rows.withColumn("weight", R.spot_weight(s.weight_mode)))


def ledger(sums: DataFrame, plan: DataFrame, s: Settings) -> DataFrame:
    """The spots of the acquisitions in ``sums``: measured ones with their tier, planned ones without samples as missing."""
    table = layers.layer_table(plan)
    measured = R.with_plan_axes(spots.summed_spots(sums).drop("partial"), s.a_is_x)
    matched = nearest.match_on_layer(layers.delivery_layers(measured, table), plan)
    tier = quality.position_tier(F.col("distance"), s.pass_mm, s.warn_mm)
    found = matched.select("acq_id", "spot_id", "layer", "a", "b", "sigma_a", "sigma_b", "weight", "n_rows", "expected_x", "expected_y", "distance", tier.alias("tier"))
    planned = plan.join(sums.select("acq_id").distinct(), "acq_id", "left_semi")
    slots = spots.uncovered(planned, found, "spot_id").select("acq_id", F.col("spot_idx").cast("bigint").alias("spot_id"), F.col("x").alias("expected_x"), F.col("y").alias("expected_y"))
    missing = layers.delivery_layers(slots, table).withColumn("n_rows", F.lit(0).cast("bigint")).withColumn("tier", F.lit("missing"))
    return found.unionByName(missing, allowMissingColumns=True)


def _write(table: DataFrame, path: str, *by: str) -> None:
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def as_pattern(path: str) -> str:
    """A pattern that only ``path`` matches: file streams take folders and patterns, not the path of one file."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, samples: str, plan: str, out: str, checkpoint: str, s: Settings = Settings()) -> int:
    """Take the files of samples that are new; the number of samples in them."""
    planned = plans_of(spark.read.parquet(plan)).withColumn("acq_group", group_of(s.groups))
    reader = spark.readStream.schema(spark.read.parquet(samples).schema)
    if s.files_at_once:
        reader = reader.option("maxFilesPerTrigger", s.files_at_once)

    taken: list[int] = []

    def absorb(batch: DataFrame, number: int) -> None:
        taken.append(batch.count())  # of Parquet files, from their footers
        sums = sums_of(batch, s).withColumns({"acq_group": group_of(s.groups), "batch": F.lit(number).cast("bigint")})
        _write(sums, f"{out}/sums", "acq_group", "batch")
        kept = spark.read.schema(sums.schema).parquet(f"{out}/sums")
        touched = [r["acq_group"] for r in kept.filter(F.col("batch") == number).select("acq_group").distinct().collect()]  # at most s.groups
        log.info("batch %d: %d samples, %d groups of acquisitions", number, taken[-1], len(touched))
        if not touched:  # no new sample counts
            return
        here = F.col("acq_group").isin(touched)
        made = ledger(kept.filter(here).drop("acq_group", "batch"), planned.filter(here).drop("acq_group"), s)
        _write(made.withColumn("acq_group", group_of(s.groups)), f"{out}/spots", "acq_group")
        written(spark.read.parquet(f"{out}/spots").filter(here), f"{out}/spots", "tier")

    writer = samples_of(reader.parquet(as_pattern(samples))).writeStream.foreachBatch(absorb)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d new samples", samples, sum(taken))
    return sum(taken)


def main() -> None:
    paths = {"samples": "Parquet files of samples: a folder, a pattern or one file", "plan": "Parquet table of planned spots", "out": "folder to write to", "checkpoint": "folder of the stream's checkpoint"}
    spark, given = command_line("delivered_spots", __doc__.split("\n", 1)[0], paths)
    try:
        config = settings(spark, given.pop("config"), Settings)
        run(spark, **given, s=config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
