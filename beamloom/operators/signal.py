"""Delivery signal: rolling baselines, dead time, on-spans, and parameters inferred from them.

Everything is windows and aggregates within an acquisition. Percentiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K
from .layers import layer_energies, with_layers


def _rows() -> WindowSpec:
    return Window.partitionBy("acq_id").orderBy("row_idx")


def _all() -> WindowSpec:
    return Window.partitionBy("acq_id")


def rolling_mean(value: Column, window: int = K.ROLLING_WINDOW) -> Column:
    """Centred mean over ``window`` rows; rows beyond the ends count as 0. For acquisitions of window rows or more."""
    after = (window - 1) // 2
    return F.sum(F.coalesce(value, F.lit(0.0))).over(_rows().rowsBetween(after - window + 1, after)) / window


def delivery_metric(rows: DataFrame, window: int = K.ROLLING_WINDOW) -> DataFrame:
    """Adds metric: the geometric mean of channel sum and fit amplitude, each by its rolling mean.

    Shorter acquisitions than the window use their own length.
    """
    sized = rows.withColumns({"_n": F.count(F.lit(1)).over(_all()), "_i": F.row_number().over(_rows()) - 1})
    whole = _rows().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def mean(c: str) -> Column:
        if window <= 1:
            return F.coalesce(F.col(c), F.lit(0.0))
        few = F.collect_list(F.when(F.col("_n") < window, F.coalesce(F.col(c), F.lit(0.0)))).over(whole)  # at most window values
        after = F.floor((F.col("_n") - 1) / 2)
        low, high = F.greatest(F.lit(0), F.col("_i") + after - F.col("_n") + 1).cast("int"), F.least(F.col("_n") - 1, F.col("_i") + after).cast("int")
        short = F.aggregate(F.slice(few, low + 1, high - low + 1), F.lit(0.0), lambda x, y: x + y) / F.col("_n")
        return F.when(F.col("_n") >= window, rolling_mean(F.col(c), window)).otherwise(short)

    share = lambda c: F.greatest(F.col(c) / F.greatest(mean(c), F.lit(1e-12)), F.lit(1e-12))
    return sized.withColumn("metric", F.sqrt(share("channel") * share("fit_a"))).drop("_n", "_i")


def dead_rows(rows: DataFrame, dead_ratio: float = K.DEAD_RATIO) -> DataFrame:
    """Adds dead: the metric is not above the ratio."""
    return delivery_metric(rows).withColumn("dead", F.col("metric") <= dead_ratio)


def delivery_weights(rows: DataFrame, on_fraction: float = K.ON_FRACTION) -> DataFrame:
    """Weights of rows whose signal is off become 0."""
    measured = delivery_metric(rows)
    return measured.withColumn("weight", F.greatest("weight", F.lit(1e-18)) * (F.col("metric") >= on_fraction).cast("double")).drop("metric")


def on_spans(rows: DataFrame, dead: str = "dead", keys: tuple[str, ...] = ("acq_id",)) -> DataFrame:
    """(keys, span_id, row_start, row_end) of the longest runs of rows that are not dead."""
    order = Window.partitionBy(*keys).orderBy("row_idx")
    begins = ~F.col(dead) & F.coalesce(F.lag(dead).over(order), F.lit(True))
    marked = rows.withColumn("_run", F.sum(begins.cast("int")).over(order)).filter(~F.col(dead))
    spans = marked.groupBy(*keys, (F.col("_run") - 1).alias("span_id")).agg(F.min("row_idx").alias("row_start"), (F.max("row_idx") + 1).alias("row_end"))
    return spans


def _percentile(value: str | Column, p: float) -> Column:
    return F.percentile(value, F.lit(p))


def _ranked(rows: DataFrame, c: str) -> DataFrame:
    """Adds the place from 0 and the number of an acquisition's values, sorted; missing ones have no place."""
    place = F.when(F.col(c).isNotNull(), F.row_number().over(Window.partitionBy("acq_id").orderBy(F.col(c).asc_nulls_last())) - 1)
    return rows.withColumns({f"{c}_at": place, f"{c}_n": F.count(c).over(_all())})


def _percentiles(c: str, names: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates of ranked values, and the percentiles made of them: those at the places around, by their distances."""
    place = lambda p: p * (F.col(f"{c}_n") - 1)
    found = [F.max(F.when(F.col(f"{c}_at") == f(place(p)), F.col(c))).alias(f"{name}_{f.__name__}") for name, p in names.items() for f in (F.floor, F.ceil)]
    share = lambda p: place(p) - F.floor(place(p))
    made = [(F.col(f"{name}_floor") * (1 - share(p)) + F.col(f"{name}_ceil") * share(p)).alias(name) for name, p in names.items()]
    return [*found, F.first(f"{c}_n").alias(f"{c}_n")], made


def row_statistics(rows: DataFrame) -> DataFrame:
    """What the inference needs of an acquisition's rows, in one row each: n, percentiles of positive weights (w1, w50) and
    of the steps between times (dt10, dt50, dt90), the number of steps, the knee (the middle of the largest rise of the
    steps in order), and the time from first to last. Rows are shuffled once, by acquisition; nothing is gathered."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(None).cast("double")
    before = F.last("t", ignorenulls=True).over(_rows().rowsBetween(Window.unboundedPreceding, -1))
    step = F.col("t") - before
    stepped = rows.select("acq_id", "row_idx", "t", F.when(weight > 0, weight).alias("_w"), F.when(step > 0, step).alias("_dt"))
    lower = F.lag("_dt").over(Window.partitionBy("acq_id").orderBy(F.col("_dt").asc_nulls_last()))
    sorted_ = _ranked(_ranked(stepped.withColumn("_low", lower), "_dt"), "_w")
    rise = F.struct((F.col("_dt") / F.greatest(F.col("_low"), F.lit(1e-12))).alias("r"), (-F.col("_dt")).alias("d"), ((F.col("_low") + F.col("_dt")) / 2).alias("knee"))
    timed = F.when(F.col("t").isNotNull(), F.col("row_idx"))
    (dt_sums, dts), (w_sums, ws) = _percentiles("_dt", {"dt10": 0.1, "dt50": 0.5, "dt90": 0.9}), _percentiles("_w", {"w1": 0.01, "w50": 0.5})
    found = sorted_.groupBy("acq_id").agg(
        F.count(F.lit(1)).alias("n"), *dt_sums, *w_sums, F.max(F.when(F.col("_low").isNotNull() & F.col("_dt").isNotNull(), rise))["knee"].alias("knee"), (F.max_by("t", timed) - F.min_by("t", timed)).alias("span")
    )
    return found.select("acq_id", "n", *ws, *dts, F.col("_dt_n").alias("steps"), "knee", "span")


def min_on_weight_of() -> Column:
    """A small share of the weights' 1st and 50th percentiles."""
    found = F.least(F.greatest(F.lit(1e-12), 0.05 * F.col("w1"), 0.002 * F.col("w50")), 0.02 * F.col("w50"))
    return F.coalesce(F.when(F.col("w50").isNotNull(), found), F.lit(K.MIN_WEIGHT_NA))


def gap_of() -> Column:
    """The pause that separates spots, from the steps between the times of consecutive rows: in the middle of the largest
    rise of the steps in order, held within bounds by their percentiles and the time of a plan spot (``n_plan``)."""
    knee = F.coalesce("knee", 1.5 * F.col("dt50"))
    between = F.when(F.col("n_plan") > 1, F.col("span") / (F.col("n_plan") - 1)).otherwise(F.col("span"))
    even = F.col("dt90") - F.col("dt10") < F.greatest(0.05 * F.col("dt50"), F.lit(1e-9))
    gap = F.when(even, 2.5 * F.col("dt50")).otherwise(F.least(knee, between / 2, F.greatest(1.35 * F.col("dt90"), 3 * F.col("dt50"))))
    return F.when(F.col("steps") > 0, F.greatest(F.lit(0.005), F.least(F.lit(5.0), gap, 8 * F.col("dt50")))).otherwise(K.LAYER_GAP_S)


def min_rows_of() -> Column:
    """3 % of the rows of a spot, from 1 to 20, by the numbers of rows (n) and of plan spots (n_plan)."""
    rows = F.rint(F.col("n") / F.col("n_plan") * 0.03).cast("int")
    return F.when(F.col("n_plan") > 0, F.greatest(F.lit(1), F.least(F.lit(20), rows))).otherwise(1)


def plan_sizes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n_plan"))


def min_on_weight(rows: DataFrame) -> DataFrame:
    """(acq_id, min_on_weight)."""
    return row_statistics(rows).select("acq_id", min_on_weight_of().alias("min_on_weight"))


def episode_gap(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, gap_s)."""
    return row_statistics(rows).join(plan_sizes(plan), "acq_id", "left").select("acq_id", gap_of().alias("gap_s"))


def min_episode_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, min_rows)."""
    n = rows.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n")).join(plan_sizes(plan), "acq_id", "left")
    return n.select("acq_id", min_rows_of().alias("min_rows"))


def advance_penalty(plan: DataFrame) -> DataFrame:
    """(acq_id, penalty): from the median squared step between the centres of the layers, at least the default."""
    centres = with_layers(plan).groupBy("acq_id", "layer").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    order = Window.partitionBy("acq_id").orderBy("layer")
    dx, dy = F.col("cx") - F.lag("cx").over(order), F.col("cy") - F.lag("cy").over(order)
    median = centres.withColumn("d2", dx * dx + dy * dy).filter("d2 > 0").groupBy("acq_id").agg(_percentile("d2", 0.5).alias("m"))
    found = F.greatest(F.lit(K.ADVANCE_PENALTY_MM2), F.greatest(F.lit(50.0), F.least(F.lit(2000.0), 1.25 * F.col("m"))))
    return layer_energies(plan).select("acq_id").distinct().join(median, "acq_id", "left").select("acq_id", F.coalesce(F.when(F.col("m").isNotNull(), found), F.lit(K.ADVANCE_PENALTY_MM2)).alias("penalty"))


def cluster_radius(plan: DataFrame) -> DataFrame:
    """(acq_id, radius_mm2): square of 1.6 median steps between spots, of 3 mm at least."""
    order = Window.partitionBy("acq_id").orderBy("spot_idx")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    stepped = plan.withColumn("d", F.sqrt(dx * dx + dy * dy))
    found = stepped.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"), _percentile(F.when(F.col("d") > 1e-6, F.col("d")), 0.5).alias("m"))
    r = F.when(F.col("n") < 2, K.CLUSTER_RADIUS_MM).otherwise(F.greatest(F.lit(3.0), K.CLUSTER_SCALE * F.coalesce("m", F.lit(K.CLUSTER_RADIUS_MM))))
    return found.select("acq_id", (r * r).alias("radius_mm2"))
