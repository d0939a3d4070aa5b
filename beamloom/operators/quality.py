"""Position and dose quality: tiers and their counts, dose fractions by layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.rows import charge
from .layers import last_layers, layer_of_row, with_layers
from .nearest import match_on_layer


def check_thresholds(low: float, high: float) -> None:
    if not 0 <= low < high:
        raise ValueError("thresholds must satisfy 0 <= pass < warn")


def position_tier(distance: Column, pass_mm: float = K.PASS_MM, warn_mm: float = K.WARN_MM) -> Column:
    """pass, warn or fail; a missing distance is a warning."""
    return F.when(distance <= pass_mm, "pass").when(distance > warn_mm, "fail").otherwise("warn")


def dose_tier(deviation: Column, pass_pp: float = K.PASS_PP, warn_pp: float = K.WARN_PP) -> Column:
    """pass, over_warn, over_fail, under_warn, under_fail; NULL without a deviation."""
    d = deviation
    return F.when(F.abs(d) <= pass_pp, "pass").when(d > warn_pp, "over_fail").when(d > pass_pp, "over_warn").when(d < -warn_pp, "under_fail").when(d < -pass_pp, "under_warn")


def _counts(df: DataFrame, tier: Column, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    return df.withColumn("_tier", tier).groupBy(*keys).agg(*[F.count_if(F.col("_tier") == n).alias(f"n_{n}") for n in names], F.count(F.lit(1)).alias("n"))


def position_counts(matched: DataFrame, pass_mm: float = K.PASS_MM, warn_mm: float = K.WARN_MM, keys: list[str] | None = None) -> DataFrame:
    check_thresholds(pass_mm, warn_mm)
    return _counts(matched, position_tier(F.col("distance"), pass_mm, warn_mm), ("pass", "warn", "fail"), keys or ["acq_id"])


def dose_counts(doses: DataFrame, pass_pp: float = K.PASS_PP, warn_pp: float = K.WARN_PP, keys: list[str] | None = None) -> DataFrame:
    check_thresholds(pass_pp, warn_pp)
    return _counts(doses, dose_tier(F.col("signed_pp"), pass_pp, warn_pp), ("pass", "over_warn", "over_fail", "under_warn", "under_fail"), keys or ["acq_id"])


def merged_dose_counts(doses: DataFrame, pass_pp: float = K.PASS_PP, warn_pp: float = K.WARN_PP) -> DataFrame:
    """Dose tiers as pass, warn and fail: too much and too little together."""
    return dose_counts(doses, pass_pp, warn_pp).select("acq_id", "n_pass", (F.col("n_over_warn") + F.col("n_under_warn")).alias("n_warn"), (F.col("n_over_fail") + F.col("n_under_fail")).alias("n_fail"))


def dose_fractions(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Matched rows with plan_fraction, measured_fraction, deviation_pp and signed_pp of their nearest spot.

    Fractions are of the layer: planned weight by the layer's total, measured charge of the spot by the layer's total.
    They are missing where a weight is missing or a total isn't positive. Rows are shuffled once, by layer; the sums are
    windows over a layer of an acquisition.
    """
    m = match_on_layer(rows, plan).join(last_layers(plan), "acq_id", "left")
    m = m.withColumns({"_layer": layer_of_row(F.col("layer"), F.col("_last")), "_hit": F.col("nn_local_idx") >= 0}).drop("_last")
    q = F.when(F.col("_hit"), charge(F.col("weight"), F.col("channel")))
    layer = Window.partitionBy("acq_id", "_layer")
    planned = with_layers(plan).groupBy("acq_id", F.col("layer").alias("_layer")).agg(F.sum("mu").alias("_layer_mu"))
    sums = {"_layer_q": F.sum(q).over(layer), "_spot_q": F.when(F.col("_hit"), F.sum(q).over(Window.partitionBy("acq_id", "_layer", "nn_local_idx")))}
    out = m.withColumns(sums).join(planned, ["acq_id", "_layer"], "left")
    out = out.withColumn("plan_fraction", F.when(F.col("_layer_mu") > 0, F.col("expected_mu") / F.col("_layer_mu"))).withColumn("measured_fraction", F.when(F.col("_layer_q") > 0, F.col("_spot_q") / F.col("_layer_q")))
    signed = (F.col("measured_fraction") - F.col("plan_fraction")) * 100
    return out.withColumns({"signed_pp": signed, "deviation_pp": F.abs(signed)}).drop("_layer", "_hit", "_spot_q", "_layer_q", "_layer_mu")


def weighted_rms(distance: Column, weight: Column) -> Column:
    """Aggregate: root of the weighted mean square of finite distances with positive weights."""
    ok = distance.isNotNull() & (F.abs(distance) != float("inf")) & (weight > 0)
    return F.sqrt(F.sum(F.when(ok, weight * distance * distance)) / F.sum(F.when(ok, weight)))
