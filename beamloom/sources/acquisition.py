"""Acquisition files: CSV, plain or gzipped, one header row, cells as text.

A frame has one row for each line, in the file's order (``row_idx``), with acq_id, t, a, b, weight inputs (channel,
fit_a, fit_b), sigma_a, sigma_b and gate. Columns that a file lacks are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R
from .names import acquisition_stem, acquisition_stem_column, is_acquisition


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All cells of one file (or of all files of a folder that have one header) as text, with the line's number (``_row``).

    The files of a folder follow each other by their names, and large plain ones are read in pieces, so an acquisition in
    several files doesn't go through one task. A gzipped file can't be read in pieces."""
    if not is_acquisition(path):
        raise ValueError(f"not an acquisition file: {path}")
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    names = [c.lstrip("\ufeff").strip() for c in raw.columns]
    at = [F.col("_metadata.file_path").alias("_part"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")]
    return _counted(raw.select("*", *at).toDF(*names, "_part", "_block", "_place")).drop("_part")


def _counted(text: DataFrame) -> DataFrame:
    """Adds _row, the line's number, in the order of the names of files and of their pieces: of the pieces before a line's own
    only the counts are gathered."""
    pieces = text.groupBy("_part", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = text.join(F.broadcast(pieces), ["_part", "_block"])
    return met.withColumn("_row", F.col("_place") - F.col("_first") + F.col("_before")).drop("_block", "_first", "_before")


def read_texts(spark: SparkSession, path: str, acq_id: Column | None = None) -> DataFrame:
    """All cells of many files with one header, as text, with acq_id (``acq_id`` of the column ``_file``, by default the
    file's stem) and the line's number in its file (``_row``).

    Large files are read in several pieces. A line's number is its place within its piece plus the lines of the pieces before
    it, of which only the counts are gathered; so no file has to go through one task.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)
    cells = [F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in raw.columns]
    text = raw.select(*cells, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    pieces = text.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = acquisition_stem_column(F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))) if acq_id is None else acq_id
    return text.join(pieces, ["_file", "_block"]).withColumn("_row", F.col("_place") - F.col("_first") + F.col("_before")).withColumn("acq_id", own).drop("_block", "_first", "_before")


def has_gate_counter(columns: list[str]) -> bool:
    return K.GATE_COUNTER in [c.lstrip("﻿").strip() for c in columns]


def check_columns(columns: list[str], mode: str = "channel_sum", auto: bool = False) -> None:
    """Raises where columns that the weight mode needs are missing; an empty header passes."""
    names = [c for c in columns if not c.startswith("_")]
    if not names:
        return
    need = [K.FIT_AMPLITUDE_A]
    if auto:
        need += [K.POSITION_A, K.POSITION_B]
    need += {"channel_sum": [K.CHANNEL_SUM], "fit_amplitude_a": [], "fit_amplitude_b": [K.FIT_AMPLITUDE_B]}[mode]
    if missing := [c for c in need if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def typed(raw: DataFrame, acq_id: str | None = None, strict: bool = False) -> DataFrame:
    """Typed rows of a text frame of one acquisition, or of ``read_texts``. With ``strict``, a malformed number raises;
    otherwise it is missing."""
    names = raw.columns
    have = lambda c: c in names
    number = lambda c: (R.cell(c) if not strict else R.finite(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double"))) if have(c) else F.lit(None).cast("double")
    time = K.TIME if have(K.TIME) else names[0]
    order = Window.partitionBy("acq_id").orderBy("_place")
    placed = raw if have("_file") else raw.withColumn("acq_id", F.lit(acq_id))
    placed = placed if have("_row") else placed.withColumn("_row", F.row_number().over(order) - 1)
    out = placed.select(
        "acq_id",
        F.col("_row").cast("bigint").alias("row_idx"),
        number(time).alias("t"),
        number(K.POSITION_A).alias("a"),
        number(K.POSITION_B).alias("b"),
        number(K.CHANNEL_SUM).alias("channel"),
        number(K.FIT_AMPLITUDE_A).alias("fit_a"),
        number(K.FIT_AMPLITUDE_B).alias("fit_b"),
        number(K.SIGMA_A).alias("sigma_a"),
        number(K.SIGMA_B).alias("sigma_b"),
        (R.gate(F.col(f"`{K.GATE_COUNTER}`")) if have(K.GATE_COUNTER) else F.lit(None).cast("int")).alias("gate"),
    )
    return out


def read_acquisition(spark: SparkSession, path: str, acq_id: str | None = None, strict: bool = False) -> DataFrame:
    return typed(read_text(spark, path), acq_id or acquisition_stem(path), strict)


def read_acquisitions(spark: SparkSession, path: str, acq_id: Column | None = None, strict: bool = False) -> DataFrame:
    """Typed rows of many files, each of which is an acquisition (see ``read_texts``)."""
    return typed(read_texts(spark, path, acq_id), strict=strict)


def signal_rows(df: DataFrame, with_dead: bool = False) -> DataFrame:
    """Rows with a fit; dead rows too if asked for, then without positions and fit values."""
    if not with_dead:
        return df.filter(F.col("fit_a").isNotNull())
    alive = F.col("fit_a").isNotNull()
    return df.withColumns({c: F.when(alive, F.col(c)) for c in ("a", "b", "sigma_a", "sigma_b")})


def numbered(df: DataFrame) -> DataFrame:
    """row_idx again from 0 without gaps, in each acquisition."""
    return df.withColumn("row_idx", (F.row_number().over(Window.partitionBy("acq_id").orderBy("row_idx")) - 1).cast("bigint"))


def first_rows(df: DataFrame, most: int | None) -> DataFrame:
    """The first rows of each acquisition that are kept so far (``row_idx`` counts them)."""
    return df if most is None else df.filter(F.col("row_idx") < most)


def first_points(df: DataFrame, most: int | None) -> DataFrame:
    """The first rows of each acquisition among those that are left, in their order."""
    if most is None:
        return df
    place = F.row_number().over(Window.partitionBy("acq_id").orderBy("row_idx"))
    return df.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
