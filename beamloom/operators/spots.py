"""Measured rows to measured spots: weighted means, sums, coverage, delivery times.

Aggregates are plain sums and maxima by (acq_id, spot_id), so they combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import TINY
from ..sources.partitions import sorted_beside
from .layers import delivery_layers, layer_table


def _mean(value: Column, weight: Column, valid: Column | None = None) -> Column:
    """Weighted mean over rows with a value (and valid ones, if that is given); NULL without any."""
    ok = value.isNotNull() if valid is None else valid
    return F.sum(F.when(ok, weight * value)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0.0))


def weighted_spots(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each spot: means weighted by max(weight, 1e-18), the sum of weights, the largest partial code.

    Widths, channel sum (if positive) and time are means over the rows that have them. Spots below 0 are left out.
    first_row is the place of the spot's first row, the order in which spots come.
    """
    keys = keys or ["acq_id", "spot_id"]
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(TINY))
    return rows.filter("spot_id >= 0").groupBy(*keys).agg(
        _mean(F.col("a"), w).alias("a"), _mean(F.col("b"), w).alias("b"), _mean(F.col("layer").cast("double"), w).alias("layer"), F.sum(w).alias("weight"), F.max("partial").alias("partial"),
        _mean(F.col("sigma_a"), w).alias("sigma_a"), _mean(F.col("sigma_b"), w).alias("sigma_b"), _mean(F.col("channel"), w, F.col("channel") > 0).alias("channel"), _mean(F.col("t"), w).alias("t"),
        F.min("row_idx").alias("first_row"), F.count(F.lit(1)).alias("n_rows"),
    )


_MEANS = ("a", "b", "sigma_a", "sigma_b", "channel")


def spot_sums(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of ``weighted_spots`` before the division, without layer, time and order: sums of parts of the rows add up.

    For each mean c, ``of_c`` is the sum of weighted values and ``by_c`` that of the weights of rows that have one.
    """
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(TINY))
    ok = {c: F.col(c) > 0 if c == "channel" else F.col(c).isNotNull() for c in _MEANS}
    sums = [F.sum(F.when(ok[c], x)).alias(f"{p}_{c}") for c in _MEANS for p, x in (("of", w * F.col(c)), ("by", w))]
    return rows.filter("spot_id >= 0").groupBy(*(keys or ["acq_id", "spot_id"])).agg(*sums, F.sum(w).alias("weight"), F.max("partial").alias("partial"), F.count(F.lit(1)).alias("n_rows"))


def summed_spots(sums: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Measured spots of any number of tables of ``spot_sums``, put together."""
    total = [F.sum(f"{p}_{c}").alias(f"{p}_{c}") for c in _MEANS for p in ("of", "by")]
    keys = keys or ["acq_id", "spot_id"]
    merged = sums.groupBy(*keys).agg(*total, F.sum("weight").alias("weight"), F.max("partial").alias("partial"), F.sum("n_rows").alias("n_rows"))
    return merged.select(*keys, *[(F.col(f"of_{c}") / F.nullif(F.col(f"by_{c}"), F.lit(0.0))).alias(c) for c in _MEANS], "weight", "partial", "n_rows")


def plan_slot_spots(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Weighted spots of plan-sequential rows: slots of the plan only, with both positions; layers fall back to delivery."""
    table = layer_table(plan)
    slots = table.groupBy("acq_id").agg(F.sum("n_spots").alias("_slots"))
    spots = weighted_spots(rows).join(slots, "acq_id", "left").filter("spot_id < _slots and a is not null and b is not null").drop("_slots")
    nominal = delivery_layers(spots.withColumn("_measured", F.col("layer")), table)
    return nominal.withColumn("layer", F.coalesce("_measured", F.col("layer").cast("double"))).drop("_measured")


def spot_layers_cut(rows: DataFrame) -> DataFrame:
    """Layer of each spot as the weighted mean of its rows' layers, cut off to a whole number."""
    return weighted_spots(rows).select("acq_id", "spot_id", F.col("layer").cast("int").alias("layer"))


def span_stats(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Weighted statistics of row spans (acq_id, span_id, row_start, row_end): spans are spread to rows and met by key."""
    listed = spans.filter("row_end > row_start").select("acq_id", "span_id", F.explode(F.sequence(F.col("row_start"), F.col("row_end") - 1)).alias("row_idx"))
    met = listed.join(rows, ["acq_id", "row_idx"])
    w = F.coalesce("weight", F.lit(0.0))
    mean = lambda c, ok=None: _mean(F.col(c), w, ok)
    plain = lambda c: F.coalesce(mean(c), F.avg(c))  # noqa: E731  without any weight, the mean of all rows counts
    return met.groupBy("acq_id", "span_id").agg(
        plain("a").alias("a"), plain("b").alias("b"), plain("mx").alias("mx"), plain("my").alias("my"), F.sum(w).alias("weight"), F.max("partial").alias("partial"),
        mean("sigma_a").alias("sigma_a"), mean("sigma_b").alias("sigma_b"), F.coalesce(mean("channel", F.col("channel") > 0), F.sum(w)).alias("channel"), mean("t").alias("t"),
        F.min("row_idx").alias("row_start"), (F.max("row_idx") + 1).alias("row_end"), F.count(F.lit(1)).alias("n_rows"),
    )


def span_weights(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Sum of weights of each span; spans without rows have 0."""
    return spans.join(span_stats(rows, spans).select("acq_id", "span_id", "weight"), ["acq_id", "span_id"], "left").fillna(0.0, ["weight"])


def quantile_spans(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, span_id, row_start, row_end): all rows (row_idx from 0, weight) in one span for each plan spot, of about equal
    weight and one row at least; without any weight, of about equal length. Acquisitions with fewer rows than spots have none.

    A row tells by its cumulated weight the first share that it lies within; rows are counted by that, and the counts summed
    up over the shares. Edges that would leave a span empty are raised by a running maximum, as far as the rows reach.
    """
    order = Window.partitionBy("acq_id").orderBy("row_idx")
    n_plan = plan.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.select("acq_id", "row_idx", F.sum(F.coalesce("weight", F.lit(0.0))).over(order).alias("c")).join(n_plan, "acq_id")
    whole = Window.partitionBy("acq_id")
    sized = sized.withColumns({"total": F.max("c").over(whole), "rows": F.count(F.lit(1)).over(whole)}).filter("rows >= n")
    within = lambda i: F.col("c") <= F.col("total") * i / F.col("n")
    guess = F.ceil(F.col("c") * F.col("n") / F.nullif(F.col("total"), F.lit(0.0))).cast("int")
    share = F.when(within(guess - 1), guess - 1).when(~within(guess), guess + 1).otherwise(guess)
    counts = sized.withColumn("i", F.greatest(share, F.lit(0))).groupBy("acq_id", "i").agg(F.count(F.lit(1)).alias("rows_in"))
    edges = sized.groupBy("acq_id").agg(*[F.first(c).alias(c) for c in ("n", "total", "rows")]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    by_share = Window.partitionBy("acq_id").orderBy("i")
    even = F.when(F.col("n") > 2, F.rint((F.col("i") - 1) * ((F.col("rows") - 2) / F.nullif(F.col("n") - 2, F.lit(0))) + 1)).otherwise(1)
    summed = edges.join(counts, ["acq_id", "i"], "left").withColumn("at", F.sum(F.coalesce("rows_in", F.lit(0))).over(by_share))
    at = F.when(F.col("i") == 0, 0).when(F.col("total") > 0, F.col("at")).otherwise(even).cast("bigint")
    edge = F.least(F.col("i") + F.max(at - F.col("i")).over(by_share), F.col("rows") - F.col("n") + F.col("i"))
    placed = summed.withColumn("row_start", edge)
    return placed.select("acq_id", F.col("i").cast("bigint").alias("span_id"), "row_start", F.coalesce(F.lead("row_start").over(by_share), "rows").alias("row_end"))


def merge_means(left: Column, right: Column, w_left: Column, w_right: Column) -> Column:
    """Weighted mean of two means; a missing side is passed over."""
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise((left * w_left + right * w_right) / (w_left + w_right))


def uncovered(plan: DataFrame, rows: DataFrame, slot: str = "plan_idx") -> DataFrame:
    """Plan spots to which no row was assigned."""
    seen = rows.filter(F.col(slot) >= 0).select("acq_id", F.col(slot).cast("bigint").alias("spot_idx")).distinct()
    return plan.join(sorted_beside(seen), ["acq_id", "spot_idx"], "left_anti")


def delivery_times(plan: DataFrame, rows: DataFrame, slot: str = "plan_idx") -> DataFrame:
    """Adds delivery_t to the plan: the weighted mean time of each spot's rows (bad weights count as 1), NULL without any."""
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    times = rows.filter((F.col(slot) >= 0) & F.col("t").isNotNull()).groupBy("acq_id", F.col(slot).cast("bigint").alias("spot_idx")).agg((F.sum(w * F.col("t")) / F.sum(w)).alias("delivery_t"))
    return plan.join(sorted_beside(times), ["acq_id", "spot_idx"], "left")
