"""Spots and layers by pauses in time.

A row that comes ``gap_s`` or more after the row before begins a new spot, unless its position is that of the row before
within ``tolerance_mm`` (a refill). Spot ids are pure windows. At each new spot the layer advances if that is plausible:
the position is far from the layer's spots, or not clearly farther from the next layer's. That choice depends on the
layer so far, so the few new spots of an acquisition are folded in order, by a grouped map that has its plan once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R
from ..session import ship
from ..sources.acquisition import first_points
from .grid import layer_distances
from .layers import last_layers, with_layers
from .nearest import impute_axes, impute_on_layer


def _rows() -> WindowSpec:
    return Window.partitionBy("acq_id").orderBy("row_idx")


def gap_spots(rows: DataFrame, gap_s: float = K.LAYER_GAP_S, tolerance_mm: float = K.REFILL_TOLERANCE_MM) -> DataFrame:
    """Adds spot_id to rows with t, mx and my; a row without a position is no refill."""
    before = lambda c: F.lag(c).over(_rows())
    dx, dy = F.col("mx") - before("mx"), F.col("my") - before("my")
    new = (F.col("t") - before("t") >= gap_s) & ~F.coalesce(F.sqrt(dx * dx + dy * dy) <= tolerance_mm, F.lit(False))
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    return marked.withColumn("spot_id", F.sum("_new").over(_rows()).cast("bigint"))


def advance_plausible(stay: float, step: float, trust_mm: float = K.REFILL_TRUST_MM) -> bool:
    """Whether the next layer is plausible, from the distances to this layer's and the next one's spots."""
    return stay > trust_mm or not (step > stay + K.REFILL_EXTRA_MM or step > K.REFILL_RATIO * max(stay, 1.0))


def gap_layers(spots: DataFrame, plan: DataFrame, trust_mm: float = K.REFILL_TRUST_MM) -> DataFrame:
    """Adds layer to rows of ``gap_spots``: 0 first, one more at each new spot for which that is plausible."""
    ship(spots.sparkSession)
    first = spots.filter("_new = 1").select("acq_id", "spot_id", "mx", "my")
    planned = with_layers(plan).join(last_layers(plan), "acq_id").select(F.col("acq_id").alias("of"), "layer", "x", "y", "_last")

    def fold(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame(columns=["acq_id", "spot_id", "layer"])
        p, last = p.sort_values("spot_id"), int(q["_last"].iloc[0])
        d = np.sqrt(layer_distances(p[["mx", "my"]].to_numpy(float), q[["x", "y"]].to_numpy(float), q["layer"].to_numpy(), last + 1))
        path, layer = [], 0
        for row in d:
            layer += layer < last and advance_plausible(row[layer], row[layer + 1], trust_mm)
            path.append(layer)
        return pd.DataFrame({"acq_id": p["acq_id"], "spot_id": p["spot_id"], "layer": path})

    path = first.groupBy("acq_id").cogroup(planned.groupBy("of")).applyInPandas(fold, f"acq_id {dict(spots.dtypes)['acq_id']}, spot_id bigint, layer int")
    return spots.join(path, ["acq_id", "spot_id"], "left").withColumn("layer", F.coalesce("layer", F.lit(0)))


def assign_by_gap(rows: DataFrame, plan: DataFrame | None, gap_s: float = K.LAYER_GAP_S, tolerance_mm: float = K.REFILL_TOLERANCE_MM, trust_mm: float = K.REFILL_TRUST_MM, weight_mode: str = "channel_sum", a_is_x: bool = False, heal: bool = False, max_points: int | None = None) -> DataFrame:
    """Assigned rows by pauses, the first ``max_points`` of each acquisition. Without a plan the layer is the spot.

    One-axis rows (``heal``) are completed from the whole plan before spots are told apart, and from their layer's spots
    after that.
    """
    if gap_s <= 0 or tolerance_mm <= 0:
        raise ValueError("gap and tolerance must be positive")
    fit = R.with_plan_axes(rows.filter("fit_a is not null and t is not null"), a_is_x).filter(R.position_ok(heal))
    fit = first_points(fit, max_points).withColumn("weight", R.spot_weight(weight_mode))
    if plan is None:
        spots = gap_spots(fit.fillna(0.0, ["mx", "my"]), gap_s, tolerance_mm)
        return R.with_detector_axes(spots.withColumn("layer", F.col("spot_id").cast("int")), a_is_x).drop("_new")
    if heal:
        fit = impute_axes(fit.withColumns({"_x": F.col("mx"), "_y": F.col("my")}), plan)
    out = gap_layers(gap_spots(fit, gap_s, tolerance_mm), plan, trust_mm).drop("_new")
    if heal:
        out = impute_on_layer(out.withColumns({"mx": F.col("_x"), "my": F.col("_y")}).drop("_x", "_y"), plan)
    return R.with_detector_axes(out, a_is_x)
