"""File names and what they say."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags in file names.
CSV_TAG = r"(?i)^15186535_(T0G\d+(?:_\d+kHz)?)_"
PLAN_TAG = r"(?i)T0G\d+"


def file_name(path: str) -> str:
    return PurePosixPath(str(path).replace("\\", "/")).name


def is_acquisition(path: str) -> bool:
    return file_name(path).lower().endswith((".csv", ".csv.gz"))


def acquisition_stem(path: str) -> str:
    """File name without .csv.gz or its last suffix."""
    name = file_name(path)
    return name[:-7] if name.lower().endswith(".csv.gz") else PurePosixPath(name).stem


def acquisition_stem_column(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)(\.csv\.gz|\.[^.]*)$", "")


def plan_tag(stem: str) -> str | None:
    found = re.match(CSV_TAG, stem)
    return found[1] if found else None


def plan_tag_column(stem: Column) -> Column:
    return F.nullif(F.regexp_extract(stem, CSV_TAG, 1), F.lit(""))


def plan_label(stem: str) -> str | None:
    """Label of the plan that an acquisition belongs to."""
    tag = plan_tag(stem)
    found = re.match(PLAN_TAG, tag) if tag else None
    return found[0].upper() if found else None


def plan_label_column(stem: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(plan_tag_column(stem), PLAN_TAG, 0), F.lit("")))


def csv_plan_label(stem: str) -> str:
    """Label of a plan file: what stands before _cube."""
    found = re.match(r"(?i)(.+?)_cube", stem)
    return found[1] if found else stem


def match_plans(acquisitions: DataFrame, plans: DataFrame) -> DataFrame:
    """Acquisition files (path, stem) with the first plan file (path, label) of their label."""
    first = plans.groupBy("label").agg(F.min("path").alias("plan_path"))
    return acquisitions.withColumn("label", plan_label_column(F.col("stem"))).join(first, "label", "left")


def default_export_name(path: str, aggregated: bool) -> str:
    return f"{acquisition_stem(path)}-spots{'-agg' if aggregated else ''}.csv"


def file_times(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified): the modification time of each file below a path; no rows where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))
