"""Row rules: cells, axes, partial fits, weights.

Missing numbers are NULL everywhere; NaN and infinities become NULL on the way in, so comparisons and aggregates need
no special cases. ``partial`` is 0 with both axes, 1 without A, 2 without B, -1 without both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

TINY = 1e-18


def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def cell(c: Column | str) -> Column:
    """A number from a text cell; blank and malformed cells are missing."""
    text = F.trim(F.col(f"`{c}`") if isinstance(c, str) else c)
    plain = text.rlike(r"^[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?$")
    return finite(F.when(plain, F.replace(text, F.lit("_"), F.lit("")).try_cast("double")))


def partial_code(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), -1).when(a.isNull(), 1).when(b.isNull(), 2).otherwise(0)


def with_plan_axes(df: DataFrame, a_is_x: bool = False) -> DataFrame:
    """Adds mx, my (plan axes of the measured position, missing ones NULL) and partial."""
    a, b = F.col("a"), F.col("b")
    return df.withColumns({"mx": a if a_is_x else b, "my": b if a_is_x else a, "partial": partial_code(a, b)})


def with_detector_axes(df: DataFrame, a_is_x: bool = False) -> DataFrame:
    """a and b again from mx and my."""
    x, y = F.col("mx"), F.col("my")
    return df.withColumns({"a": x if a_is_x else y, "b": y if a_is_x else x})


def position_ok(heal: bool = False, with_dead: bool = False) -> Column:
    """Rows to keep by their partial code: complete ones, one-axis ones to be healed, and dead ones if asked for."""
    p = F.col("partial")
    return (p == 0) | (F.lit(heal) & p.isin(1, 2)) | (F.lit(with_dead) & (p == -1))


def is_dead() -> Column:
    return F.col("mx").isNull() & F.col("my").isNull()


def channel_sum(c: Column) -> Column:
    """Missing counts as 1, and nothing is below 1e-9."""
    return F.when(c.isNull(), 1.0).otherwise(F.greatest(c, F.lit(1e-9)))


WEIGHT_MODES = {"channel_sum": "channel", "fit_amplitude_a": "fit_a", "fit_amplitude_b": "fit_b"}


def spot_weight(mode: str, auto: bool = False) -> Column:
    """Weight of a row. Values that are not positive count as 1e-9, in auto mode as 1."""
    c = F.col(WEIGHT_MODES[mode])
    if auto:
        return F.when(c > 0, c).otherwise(1.0)
    return channel_sum(c) if mode == "channel_sum" else F.when(c.isNull(), channel_sum(F.col("channel"))).otherwise(F.greatest(c, F.lit(1e-9)))


def charge(weight: Column, channel: Column) -> Column:
    """Measured charge: the weight if it is positive, else the channel sum, else almost nothing."""
    return F.when(weight > 0, weight).when(channel > 0, channel).otherwise(TINY)


def align_weight(weight: Column) -> Column:
    return F.when(weight > 0, weight).otherwise(1.0)


def gate(c: Column) -> Column:
    """Gate counter cell as a whole number, cut off towards zero."""
    return cell(c).cast("int")


def sigma_xy(df: DataFrame, a_is_x: bool = False, fallback: float = K.SIGMA_FALLBACK_MM) -> DataFrame:
    """Adds sx, sy: fit widths on the plan axes, with a fallback where they are missing or not positive."""
    good = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(fallback)
    return df.withColumns({"sx": good("sigma_a" if a_is_x else "sigma_b"), "sy": good("sigma_b" if a_is_x else "sigma_a")})
