"""Spots by the gate counter: odd values are spots, even ones the pauses between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import rows as R
from ..functions.rows import spot_weight
from ..sources.acquisition import first_points
from .layers import delivery_layers, layer_table
from .nearest import impute_on_layer


def _rows() -> WindowSpec:
    return Window.partitionBy("acq_id").orderBy("row_idx")


def gate_spots(rows: DataFrame) -> DataFrame:
    """Rows of odd gates with spot_id: each new odd value begins a spot. Rows without a gate don't count at all."""
    seen = rows.filter("gate is not null")
    new = ~F.lag("gate").over(_rows()).eqNullSafe(F.col("gate")) & (F.pmod("gate", F.lit(2)) == 1)
    marked = seen.withColumn("_new", new.cast("int"))
    return marked.withColumn("spot_id", F.sum("_new").over(_rows()) - 1).drop("_new").filter(F.pmod("gate", F.lit(2)) == 1)


def gate_phase_spots(rows: DataFrame) -> DataFrame:
    """Adds phase_id: odd gates are numbered by the pauses and changes before them; all other rows are -1.

    Rows without a gate (missing or negative) are -1 and don't separate spots.
    """
    counted = rows.withColumn("_g", F.when(F.col("gate") >= 0, F.col("gate")))
    before = F.last("_g", ignorenulls=True).over(_rows().rowsBetween(Window.unboundedPreceding, -1))
    odd, was_odd = F.pmod("_g", F.lit(2)) == 1, F.pmod(before, F.lit(2)) == 1
    step = F.when(F.col("_g").isNotNull() & was_odd & (~odd | (F.col("_g") != before)), 1).otherwise(0)
    marked = counted.withColumn("_step", step)
    return marked.withColumn("phase_id", F.when(odd, F.sum("_step").over(_rows())).otherwise(-1).cast("bigint")).drop("_g", "_step")


def assign_by_gate(rows: DataFrame, plan: DataFrame, weight_mode: str = "channel_sum", a_is_x: bool = False, max_points: int | None = None, keep_own: bool = False) -> DataFrame:
    """Assigned rows: spot_id by the gate counter, layer by the spot's place in the plan, one-axis rows completed on it.

    ``keep_own`` adds own, each row's spot of its layer, for the flier filter."""
    table = layer_table(plan)
    spots = delivery_layers(R.with_plan_axes(gate_spots(rows), a_is_x), table)
    fit = spots.filter(F.col("fit_a").isNotNull() & (F.col("partial") >= 0))
    done = R.with_detector_axes(impute_on_layer(fit, plan, keep_own), a_is_x).withColumn("weight", spot_weight(weight_mode))
    return first_points(done, max_points)
