"""Plans: CSV plan files, nested ion plans, and files in general.

A plan frame has plan_id, spot_idx (delivery order from 0), x, y, energy, mu, fwhm_x, fwhm_y.
"""

from __future__ import annotations

import csv
import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rows as R
from .names import csv_plan_label, file_name

REQUIRED, OPTIONAL = {"ENERGY", "X_POSITION", "Y_POSITION"}, {"CHARGE_REQ", "BEAM_SIZE"}


class PlanError(ValueError):
    """A plan that cannot be used."""


def plan_column(name: str) -> str:
    """Header cell without byte order mark, leading # and unit, in upper case."""
    return name.replace("﻿", "").strip().lstrip("#").upper().split("(")[0].strip()


def plan_columns(header: str) -> frozenset[str] | None:
    """Column names of a plan header line, or None if it isn't one."""
    names = frozenset(plan_column(c) for c in next(csv.reader([header]), []))
    return names if names >= REQUIRED else None


def is_csv_plan(spark: SparkSession, path: str) -> bool:
    if not file_name(path).lower().endswith(".csv"):
        return False
    head = spark.read.text(path).head(1)
    return bool(head) and plan_columns(head[0][0]) is not None


def csv_slots(spark: SparkSession, path: str, plan_id: str | None = None) -> DataFrame:
    """All slots with finite position and energy, kept or not, in the file's order."""
    raw = spark.read.option("header", True).csv(path)
    names = [plan_column(c) for c in raw.columns]
    if not REQUIRED <= set(names):
        raise PlanError(f"not a plan file: {path}")
    raw = raw.toDF(*names).withColumn("_place", F.monotonically_increasing_id())
    number = lambda c: R.cell(c) if c in names else F.lit(None).cast("double")
    size = F.when(number("BEAM_SIZE") > 0, number("BEAM_SIZE"))
    slots = raw.select(F.lit(plan_id or PurePosixPath(file_name(path)).stem).alias("plan_id"), "_place", number("X_POSITION").alias("x"), number("Y_POSITION").alias("y"), number("ENERGY").alias("energy"), number("CHARGE_REQ").alias("mu"), size.alias("fwhm_x"), size.alias("fwhm_y"))
    return slots.dropna(subset=["x", "y", "energy"])


def kept_slots(slots: DataFrame, weightless: bool = False) -> DataFrame:
    """Slots with a positive weight (``weightless``: those of plans without weights too), numbered in order."""
    keep = (F.col("mu") > 0) | (F.col("mu").isNull() & F.lit(weightless))
    order = Window.partitionBy("plan_id").orderBy("_place")
    return slots.filter(keep).withColumn("spot_idx", (F.row_number().over(order) - 1).cast("bigint")).select("plan_id", "spot_idx", "x", "y", "energy", "mu", "fwhm_x", "fwhm_y")


def slot_counts(slots: DataFrame, weightless: bool = False) -> DataFrame:
    """One row for each plan: slots in the file, and slots kept."""
    keep = (F.col("mu") > 0) | (F.col("mu").isNull() & F.lit(weightless))
    return slots.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(keep).alias("n_kept"))


NESTED = "plan_id string, beams array<array<struct<n: int, energy: double, xy: array<double>, weights: array<double>, size: array<double>>>>"


def nested_slots(plans: DataFrame) -> DataFrame:
    """Slots of nested ion plans (``NESTED``): one for each position pair of each control point of each beam.

    A control point has min(pairs, n) slots. A slot whose weight is given and not positive is marked by weight 0, so
    that it counts as raw; slots of control points without weights keep a NULL weight. Sizes count within (0, 500).
    """
    points = plans.select("plan_id", F.posexplode_outer("beams").alias("beam", "points")).select("plan_id", "beam", F.posexplode_outer("points").alias("point", "p")).filter("p is not null")
    n = F.least(F.coalesce(F.col("p.n"), F.lit(0)), F.floor(F.coalesce(F.size("p.xy"), F.lit(0)) / 2).cast("int"))
    spots = points.withColumn("n", n).filter("n > 0").select("plan_id", "beam", "point", "p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    width = lambda k: F.when((F.col("p.size")[0] > 0) & (F.col("p.size")[0] < 500) & (F.col("p.size")[1] > 0) & (F.col("p.size")[1] < 500), F.col("p.size")[k])
    weight = F.when((F.col("p.weights").isNotNull()) & (F.col("i") < F.size("p.weights")), F.greatest(F.coalesce(R.finite(F.get(F.col("p.weights"), F.col("i"))), F.lit(0.0)), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("beam", "point", "i")).cast("bigint")
    return spots.select("plan_id", place.alias("_place"), F.get(F.col("p.xy"), 2 * F.col("i")).alias("x"), F.get(F.col("p.xy"), 2 * F.col("i") + 1).alias("y"), F.col("p.energy").alias("energy"), weight.alias("mu"), width(0).alias("fwhm_x"), width(1).alias("fwhm_y"))


def _nested_file(path: str) -> dict:
    """An ion plan file as one nested record; needs the optional reader for such files."""
    try:
        import pydicom
    except ImportError as e:
        raise PlanError("reading ion plan files needs pydicom") from e
    data = pydicom.dcmread(path)
    listed = lambda v: None if v is None else [float(x) for x in (v if hasattr(v, "__iter__") else [v])]
    beams = []
    for beam in getattr(data, "IonBeamSequence", None) or []:
        points = []
        for p in getattr(beam, "IonControlPointSequence", None) or []:
            points.append({"n": int(getattr(p, "NumberOfScanSpotPositions", 0) or 0), "energy": float(getattr(p, "NominalBeamEnergy", "nan")), "xy": listed(getattr(p, "ScanSpotPositionMap", None)) or [], "weights": listed(getattr(p, "ScanSpotMetersetWeights", None)), "size": listed(getattr(p, "ScanningSpotSize", None))})
        beams.append(points)
    return {"plan_id": str(getattr(data, "RTPlanLabel", "") or PurePosixPath(file_name(path)).stem), "beams": beams}


def is_ion_plan(path: str) -> bool:
    return file_name(path).lower().endswith(".dcm")


def is_supported(spark: SparkSession, path: str) -> bool:
    return is_ion_plan(path) or is_csv_plan(spark, path)


def label_of(spark: SparkSession, path: str) -> str:
    return _nested_file(path)["plan_id"] if is_ion_plan(path) else csv_plan_label(PurePosixPath(file_name(path)).stem)


def read_plan(spark: SparkSession, path: str, plan_id: str | None = None) -> DataFrame:
    """Any supported plan file; a plan of which no slot is kept is an error."""
    if is_ion_plan(path):
        record = _nested_file(path)
        plan = kept_slots(nested_slots(spark.createDataFrame([(plan_id or record["plan_id"], [[tuple(p.values()) for p in b] for b in record["beams"]])], NESTED)), weightless=True)
    elif is_csv_plan(spark, path):
        plan = kept_slots(csv_slots(spark, path, plan_id))
    else:
        raise PlanError(f"not a supported plan file: {path}")
    if not plan.head(1):
        raise PlanError(f"no slot of the plan is kept: {path}")
    return plan


def export_tag(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z_.-]+", "_", text)
