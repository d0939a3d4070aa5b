"""Colours of measured and planned spots, as red, green, blue and alpha columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.quality import dose_tier, position_tier


def rgb(code: str) -> tuple[int, int, int]:
    """Parts of a #rrggbb code; the measured colour for anything else."""
    digits = code.strip().lstrip("#")
    if len(digits) != 6:
        return 214, 39, 40
    return tuple(int(digits[i : i + 2], 16) for i in (0, 2, 4))


def _coloured(df: DataFrame, tier: Column, colours: dict[str, str], other: str | None, alpha: Column) -> DataFrame:
    parts = {}
    for k, name in enumerate(("red", "green", "blue")):
        c = F.lit(rgb(other)[k] if other else 0)
        for t, code in colours.items():
            c = F.when(tier == t, rgb(code)[k]).otherwise(c)
        parts[name] = c.cast("int")
    return df.withColumns(parts | {"alpha": alpha.cast("int")})


def weight_alpha(df: DataFrame, weight: str = "weight", gamma: float = 0.5, low: float = 0.1, high: float = 0.95) -> DataFrame:
    """Adds alpha (0 to 255): weights between their 4th and 96th percentile in the acquisition, to the power gamma."""
    w = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-18))
    p = df.groupBy("acq_id").agg(F.percentile(w, F.lit(0.04)).alias("_p4"), F.percentile(w, F.lit(0.96)).alias("_p96"))
    share = F.when(F.col("_p96") <= F.col("_p4") * 1.001, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (w - F.col("_p4")) / (F.col("_p96") - F.col("_p4")))))
    return df.join(p, "acq_id").withColumn("alpha", F.floor(255.0 * (low + (high - low) * F.pow(share, F.lit(gamma)))).cast("int")).drop("_p4", "_p96")


def by_weight(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Measured colour, gold for one-axis rows; faint where the weight is low."""
    shaded = weight_alpha(df, weight)
    return _coloured(shaded, F.when(F.col("partial") > 0, "partial").otherwise("measured"), {k: K.COLOURS[k] for k in ("partial", "measured")}, None, F.col("alpha"))


def by_position(df: DataFrame, pass_mm: float = K.PASS_MM, warn_mm: float = K.WARN_MM) -> DataFrame:
    from ..operators.quality import check_thresholds

    check_thresholds(pass_mm, warn_mm)
    return _coloured(df, position_tier(F.col("distance"), pass_mm, warn_mm), {k: K.COLOURS[k] for k in ("pass", "warn", "fail")}, None, F.lit(255))


def by_dose(df: DataFrame, pass_pp: float = K.PASS_PP, warn_pp: float = K.WARN_PP) -> DataFrame:
    from ..operators.quality import check_thresholds

    check_thresholds(pass_pp, warn_pp)
    colours = {"pass": "pass", "over_warn": "warn", "over_fail": "fail", "under_warn": "under_warn", "under_fail": "under_fail"}
    return _coloured(df, dose_tier(F.col("signed_pp"), pass_pp, warn_pp), {t: K.COLOURS[c] for t, c in colours.items()}, None, F.lit(255))


def plan_visibility(df: DataFrame, visible: Column) -> DataFrame:
    """Plan colour, half clear where visible and clear elsewhere."""
    return _coloured(df, F.lit("plan"), {"plan": K.COLOURS["plan"]}, None, F.when(visible, 115).otherwise(0))


