"""Assignment by signal episodes, by plan order and by cheapest layer path.

The cheapest path is windows over an acquisition's rows. Episodes and plan order are folds over them, by grouped maps;
acquisitions are independent, so they are the unit of parallelism, and a task holds one of them (its plan's spots beside it).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R
from ..session import ship
from ..sources.acquisition import first_points, numbered, signal_rows
from ..sources.partitions import sorted_beside, spread
from . import kernels
from .layers import layer_energies, layer_table, spread_layers
from .nearest import impute_axes, impute_on_layer, layer_distances
from .signal import advance_penalty, cluster_radius, delivery_metric, delivery_weights, gap_of, min_on_weight_of, min_rows_of, plan_sizes, row_statistics

_SPANS = "acq_id {kind}, span_id bigint, row_start bigint, row_end bigint, count_ok boolean, n_raw bigint"


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["acq_id"]


def _xy(plan: pd.DataFrame) -> np.ndarray:
    return plan.sort_values("spot_idx")[["x", "y"]].to_numpy(float)


def dead_ratios() -> list[float]:
    return np.linspace(K.DEAD_RATIO_MIN, K.DEAD_RATIO_MAX, K.DEAD_RATIO_STEPS).tolist()


def _ratios_below(metric: Column, ratios: list[float]) -> Column:
    """How many of the (evenly spaced) ratios are below the metric: a guess by division, and one step where that rounds badly."""
    n, step = len(ratios), (ratios[-1] - ratios[0]) / (len(ratios) - 1)
    listed = F.array(*[F.lit(r) for r in ratios])
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((metric - ratios[0]) / step))).cast("int")
    less, more = (guess > 0) & (F.get(listed, guess - 1) >= metric), (guess < n) & (F.get(listed, guess) < metric)
    return F.when(less, guess - 1).when(more, guess + 1).otherwise(guess)


def on_edges(measured: DataFrame) -> DataFrame:
    """(acq_id, k, at, begins): where spans begin and end for each ratio k, of rows (acq_id, row_idx from 0, metric).

    A row is on for the ratios below its metric. So between two rows spans begin or end for just the ratios between their
    metrics, and rows that don't cross a ratio leave no trace. A row that crosses many ratios is shuffled as one row, by acquisition,
    and becomes as many edges in the task where the windows over them are.
    """
    order = Window.partitionBy("acq_id").orderBy("row_idx")
    below = measured.withColumn("_k", _ratios_below(F.col("metric"), dead_ratios()))
    sided = below.withColumns({"_was": F.coalesce(F.lag("_k").over(order), F.lit(0)), "_last": F.lead("row_idx").over(order).isNull()})
    event = lambda k, at, begins: F.struct(k.alias("k"), at.alias("at"), F.lit(begins).alias("begins"))
    between = lambda low, high, at, begins: F.when(low < high, F.transform(F.sequence(low, high - 1), lambda k: event(k, at, begins))).otherwise(F.array().cast("array<struct<k:int,at:bigint,begins:boolean>>"))
    here, was, row = F.col("_k"), F.col("_was"), F.col("row_idx").cast("bigint")
    found = F.concat(between(was, here, row, True), between(here, was, row, False), between(F.lit(0), F.when(F.col("_last"), here).otherwise(0), row + 1, False))
    crossing = spread(sided.filter((here != was) | F.col("_last")).select("acq_id", "row_idx", "_k", "_was", "_last"), "acq_id", times=4)
    return crossing.select("acq_id", F.explode(found).alias("e")).select("acq_id", "e.*")


def episode_counts(measured: DataFrame) -> DataFrame:
    """(acq_id, k, count): the number of episodes for each dead ratio that has any, of rows with metric and min_rows.

    Merging needs no fold. A span of at most two rows takes in the next one and is longer then, so of spans in a row a span
    is taken in if the number of tiny ones directly before it is odd. Spans shorter than min_rows go into the one before
    them. Only the first can stay short, until it has taken in enough: a later span counts if it is long enough itself and
    begins when the first one is.
    """
    keys = ["acq_id", "k"]
    least = measured.groupBy("acq_id").agg(F.max("min_rows").alias("least"))
    order = Window.partitionBy(*keys).orderBy("at")
    spans = on_edges(measured).withColumn("to", F.lead("at").over(order)).filter("begins")
    tiny = spans.withColumns({"_tiny": F.col("to") - F.col("at") <= K.TINY_MERGE_ROWS, "_i": F.row_number().over(order)})
    run = F.col("_i") - 1 - F.coalesce(F.max(F.when(~F.col("_tiny"), F.col("_i"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merged = tiny.withColumns({"_run": run, "_next": F.lead("to").over(order)}).filter(F.col("_run") % 2 == 0).withColumn("to", F.when(F.col("_tiny"), F.coalesce("_next", "to")).otherwise(F.col("to")))
    first = F.min("at").over(Window.partitionBy(*keys))
    sized = merged.join(least, "acq_id").withColumn("_settled", F.lag("to").over(order) - first >= F.col("least"))
    counts = F.col("_settled").isNull() | (F.col("least") <= 1) | (F.col("_settled") & (F.col("to") - F.col("at") >= F.col("least")))
    return sized.groupBy(*keys).agg(F.count_if(counts).alias("count"))


def calibrated_ratio(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, dead_ratio, min_rows): the ratio that makes about as many episodes as the plan has spots, the first of equal
    ones. If none fits and counts rise with the ratio around the plan's number, the ratio is interpolated.

    Each ratio of each acquisition is a key of its own.
    """
    ratios = dead_ratios()
    counted = delivery_metric(rows).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("acq_id"))).join(plan_sizes(plan), "acq_id", "left")
    place = F.row_number().over(Window.partitionBy("acq_id").orderBy("row_idx")) - 1
    measured = counted.select("acq_id", place.alias("row_idx"), "metric", "n", min_rows_of().alias("min_rows"), F.coalesce("n_plan", F.lit(0)).alias("n_plan"))
    known = measured.groupBy("acq_id").agg(F.max("n").alias("n"), F.max("n_plan").alias("n_plan"), F.max("min_rows").alias("min_rows"))
    every = known.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(ratios) - 1)))).join(episode_counts(measured), ["acq_id", "k"], "left")
    every = every.withColumn("count", F.coalesce("count", F.lit(0)))
    at = F.struct("k", "count")
    found = every.groupBy("acq_id").agg(
        *[F.first(c).alias(c) for c in ("n", "n_plan", "min_rows")], F.min(F.struct(F.abs(F.col("count") - F.col("n_plan")).alias("off"), "k")).alias("best"),
        F.min(F.when(F.col("count") >= F.col("n_plan"), at)).alias("up"), F.max(F.when(F.col("count") <= F.col("n_plan"), at)).alias("down"),
    )
    ratio = lambda k: F.get(F.array(*[F.lit(r) for r in ratios]), k)
    low, high = ratio(F.col("down.k")), ratio(F.col("up.k"))
    between = low + (F.col("n_plan") - F.col("down.count")) / (F.col("up.count") - F.col("down.count")) * (high - low)
    rising = (F.col("best.off") > 0) & (F.col("up.k") > F.col("down.k")) & (F.col("up.count") != F.col("down.count"))
    fit = F.when(F.coalesce(rising, F.lit(False)), between).otherwise(ratio(F.col("best.k")))
    held = F.greatest(F.lit(K.DEAD_RATIO_MIN), F.least(F.lit(K.DEAD_RATIO_MAX), fit))
    return found.select("acq_id", F.when((F.col("n_plan") > 0) & (F.col("n") >= 2), held).otherwise(K.DEAD_RATIO).alias("dead_ratio"), "min_rows")


def auto_parameters(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each acquisition with all parameters that auto mode infers."""
    known = row_statistics(rows).join(plan_sizes(plan), "acq_id", "left").select("acq_id", gap_of().alias("gap_s"), min_on_weight_of().alias("min_on_weight"))
    out = known.join(calibrated_ratio(rows, plan), "acq_id", "left").join(advance_penalty(plan), "acq_id", "left").join(cluster_radius(plan), "acq_id", "left")
    return out.withColumns({"jump_mm": F.lit(K.SPOT_JUMP_MM), "tiny_rows": F.lit(K.TINY_MERGE_ROWS)})


def episode_spans(rows: DataFrame, plan: DataFrame, parameters: DataFrame | None = None, tiny: int = K.TINY_MERGE_ROWS) -> DataFrame:
    """Spans of rows, one for each plan spot where that can be reached; with the raw number of episodes and the outcome.

    Rows need row_idx from 0 without gaps, t, a, b, mx, my, weight, channel and fit_a.
    """
    ship(rows.sparkSession)
    par = (parameters if parameters is not None else calibrated_ratio(rows, plan)).select("acq_id", "dead_ratio", "min_rows")
    w = F.greatest("weight", F.lit(1e-18)) * (F.col("metric") >= K.ON_FRACTION).cast("double")
    data = delivery_metric(rows).withColumn("w", w).join(par, "acq_id").select("acq_id", "row_idx", "t", "a", "b", "mx", "my", "weight", "w", "metric", "dead_ratio", "min_rows")

    def spans(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=["acq_id", "span_id", "row_start", "row_end", "count_ok", "n_raw"])
        p = p.sort_values("row_idx")
        c = {k: p[k].to_numpy(float) for k in ("t", "a", "b", "mx", "my", "weight", "w", "metric")}
        xy, n = _xy(q), len(q)
        s = kernels.Signal(c["t"], c["mx"], c["my"], c["w"])
        raw = kernels.segment(c["metric"] <= p["dead_ratio"].iloc[0], int(p["min_rows"].iloc[0]), tiny)
        if len(raw) >= 2 and n >= 2:
            k = min(len(raw), n)
            raw = np.concatenate([kernels.refine(s, raw[:k], xy[:k]), raw[k:]])
        sums = [np.r_[0.0, np.cumsum(v)] for v in (c["weight"], c["weight"] * np.nan_to_num(c["a"]), c["weight"] * np.nan_to_num(c["b"]))]
        total = np.maximum(sums[0][raw[:, 1]] - sums[0][raw[:, 0]], 1e-18)
        ab = np.column_stack([(x[raw[:, 1]] - x[raw[:, 0]]) / total for x in sums[1:]]) if len(raw) else np.zeros((0, 2))
        out, ok = kernels.fit_count(s, raw, ab, total, n, xy)
        return pd.DataFrame({"acq_id": p["acq_id"].iloc[0], "span_id": np.arange(len(out)), "row_start": out[:, 0], "row_end": out[:, 1], "count_ok": ok, "n_raw": len(raw)})

    return data.groupBy("acq_id").cogroup(plan.select(F.col("acq_id").alias("of"), "spot_idx", "x", "y").groupBy("of")).applyInPandas(spans, _SPANS.format(kind=_kind(rows)))


def plan_sequence(rows: DataFrame, plan: DataFrame, window: int = K.SEQUENTIAL_WINDOW, margin: float = K.SEQUENTIAL_MARGIN_MM2) -> DataFrame:
    """Adds spot_id, the plan slot of each row in plan order; -1 for dead rows (both positions missing)."""
    ship(rows.sparkSession)

    def slots(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row_idx")
        x, y = p["mx"].to_numpy(float), p["my"].to_numpy(float)
        dead = np.isnan(x) & np.isnan(y)
        got = kernels.sequential_slots(dead, np.nan_to_num(x), np.nan_to_num(y), p["weight"].fillna(0).to_numpy(float), _xy(q), window, margin)
        return pd.DataFrame({"acq_id": p["acq_id"], "row_idx": p["row_idx"], "spot_id": got})

    light = rows.select("acq_id", "row_idx", "mx", "my", "weight")
    ids = light.groupBy("acq_id").cogroup(plan.select(F.col("acq_id").alias("of"), "spot_idx", "x", "y").groupBy("of")).applyInPandas(slots, f"acq_id {_kind(rows)}, row_idx bigint, spot_id bigint")
    return rows.join(ids, ["acq_id", "row_idx"])


def plan_path(centres: DataFrame, plan: DataFrame, band: int = 3, stay_penalty: float = 0.0) -> DataFrame:
    """(acq_id, span_id, spot_idx): the plan spot of each centre (acq_id, span_id, mx, my) in the order of spans, never going
    back and within ``band`` spots of the span's place, at the least squared distance.

    A group has an acquisition's spans and its plan, not its rows; memory is 2 * band + 1 numbers for a span. Acquisitions
    with more spans than the plan has spots and the band reaches have no path.
    """
    ship(centres.sparkSession)

    def path(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or len(p) - 1 - band > len(q) - 1 or q.empty:
            return pd.DataFrame(columns=["acq_id", "span_id", "spot_idx"])
        p, q = p.sort_values("span_id"), q.sort_values("spot_idx")
        at = kernels.banded_path(p[["mx", "my"]].to_numpy(float), q[["x", "y"]].to_numpy(float), band, stay_penalty)
        return pd.DataFrame({"acq_id": p["acq_id"], "span_id": p["span_id"], "spot_idx": q["spot_idx"].to_numpy()[at]})

    light = centres.select("acq_id", "span_id", "mx", "my")
    return light.groupBy("acq_id").cogroup(plan.select(F.col("acq_id").alias("of"), "spot_idx", "x", "y").groupBy("of")).applyInPandas(path, f"acq_id {_kind(centres)}, span_id bigint, spot_idx bigint")


def slot_spans(rows: DataFrame) -> DataFrame:
    """(acq_id, span_id, row_start, row_end, spot_id): runs of rows of one slot."""
    order = Window.partitionBy("acq_id").orderBy("row_idx")
    on = rows.withColumns({"_before": F.lag("spot_id").over(order)})
    new = (F.col("spot_id") >= 0) & ~F.col("_before").eqNullSafe(F.col("spot_id"))
    marked = on.withColumn("_run", F.sum(new.cast("int")).over(order)).filter("spot_id >= 0")
    return marked.groupBy("acq_id", (F.col("_run") - 1).alias("span_id")).agg(F.min("row_idx").alias("row_start"), (F.max("row_idx") + 1).alias("row_end"), F.min_by("spot_id", "row_idx").alias("spot_id"))


def cheapest_layers(rows: DataFrame, plan: DataFrame, penalty: float | None = None) -> DataFrame:
    """Adds layer: the cheapest path of all rows from layer 0 up, by 0 or 1 a row, where a row costs its squared distance to
    the layer and a step ``penalty``. None: inferred from the plan.

    Layer by layer, all rows at once. With S the running sum of a layer's distances, the cheapest way to be on layer k at row
    i is S(k, i) plus the least of best(k - 1, j - 1) + penalty - S(k, j - 1) over the rows j up to i at which it may have
    been entered, a running minimum. The rows at which its layers were entered go along with it, so the cheapest of the last
    row tells all steps. Staying wins a tie, and the lower of equal last layers. Each layer is one window over the rows in
    order, and all of them have one partitioning and sort; they run in the JVM, row by row, and spill where they must.

    Costs are whole millionths of mm2, so that sums are exact and equal ways are equal, in whatever order they are added.
    Layers behind one without spots can't be reached. Where a row has no position, all are on layer 0. The number of layers,
    one number, is asked of the plans first, as there is a window for each.
    """
    order = Window.partitionBy("acq_id").orderBy("row_idx")
    up_to, before, whole = (order.rowsBetween(Window.unboundedPreceding, x) for x in (Window.currentRow, -1, Window.unboundedFollowing))
    layers = (layer_energies(plan).agg(F.max("layer")).first()[0] or 0) + 1
    table = advance_penalty(plan) if penalty is None else plan.select("acq_id").distinct().withColumn("penalty", F.lit(float(penalty)))
    light = spread(layer_distances(rows.join(table.withColumnRenamed("penalty", "_pen"), "acq_id", "left"), plan), "acq_id")
    whole_units = lambda c: F.rint(c * 1e6)
    light = light.withColumn("_pen", whole_units(F.col("_pen")))
    emit = [whole_units(F.get("emit", F.lit(k))) for k in range(layers)]
    summed = light.withColumns({"_i": F.row_number().over(order) - 1, "_none": F.max(F.col("mx").isNull() | F.col("my").isNull()).over(whole), "_s": F.array(*[F.sum(e).over(up_to) for e in emit])}).drop("emit")
    s = [F.get("_s", F.lit(k)) for k in range(layers)]
    none = F.array().cast("array<int>")
    summed = summed.withColumn("_c", F.when(s[0].isNotNull(), F.struct(s[0].alias("cost"), none.alias("entered")))).withColumn("_best", F.col("_c"))
    for k in range(1, layers):
        way = F.struct((F.col("_c.cost") + F.col("_pen") - s[k]).alias("v"), (F.col("_i") + 1).alias("j"), F.col("_c.entered").alias("entered"))
        summed = summed.withColumn("_m", F.min(F.when(way["v"].isNotNull(), way)).over(before))
        here = F.struct((s[k] + F.col("_m.v")).alias("cost"), F.array_append("_m.entered", F.col("_m.j").cast("int")).alias("entered"))
        summed = summed.withColumn("_c", F.when(F.col("_m").isNotNull() & here["cost"].isNotNull(), here)).drop("_m")
        summed = summed.withColumn("_best", F.when(F.col("_c.cost") < F.col("_best.cost"), F.col("_c")).otherwise(F.col("_best")))
    end = F.last("_best").over(whole)["entered"]
    layer = F.coalesce(F.size(F.filter("_end", lambda j: j <= F.col("_i"))), F.lit(0))
    ended = summed.withColumn("_end", end).withColumn("layer", F.when(F.col("_none"), 0).otherwise(layer).cast("int"))
    return ended.drop("_pen", "_i", "_none", "_s", "_c", "_best", "_end")


def assign_by_path(rows: DataFrame, plan: DataFrame, penalty: float | None = None, weight_mode: str = "channel_sum", a_is_x: bool = False, heal: bool = False, max_points: int | None = None) -> DataFrame:
    """Assigned rows by the cheapest layer path, of the first ``max_points`` of each acquisition. Spots are the gate's phases where there are gates, else the layers."""
    from .gates import gate_phase_spots

    if penalty is not None and penalty < 0:
        raise ValueError("the penalty must not be negative")
    fit = first_points(R.with_plan_axes(rows.filter("fit_a is not null and t is not null"), a_is_x).filter(R.position_ok(heal)), max_points).withColumn("weight", R.spot_weight(weight_mode))
    whole = impute_axes(fit.withColumns({"_x": F.col("mx"), "_y": F.col("my")}), plan) if heal else fit
    layered = cheapest_layers(whole, plan, penalty)
    if heal:
        layered = impute_on_layer(layered.withColumns({"mx": F.col("_x"), "my": F.col("_y")}).drop("_x", "_y"), plan)
    gated = F.max((F.coalesce("gate", F.lit(-1)) >= 0).cast("int")).over(Window.partitionBy("acq_id"))
    out = gate_phase_spots(layered).withColumn("spot_id", F.when(gated == 1, F.col("phase_id")).otherwise(F.col("layer").cast("bigint"))).drop("phase_id")
    return R.with_detector_axes(out, a_is_x)


def prepare_auto(rows: DataFrame, plan: DataFrame, weight_mode: str = "channel_sum", a_is_x: bool = False, heal: bool = False, with_dead: bool = False, max_points: int | None = None) -> DataFrame:
    """Rows of auto mode: fitted ones, of which the first ``max_points`` are read, complete or healed along one axis of the
    whole plan; weights that aren't positive are 1. With dead rows, these stay without positions. Rows are numbered again."""
    typed = R.with_plan_axes(first_points(signal_rows(rows, with_dead), max_points), a_is_x).filter(R.position_ok(heal, with_dead))
    typed = typed.withColumns({"weight": R.spot_weight(weight_mode, auto=True), "channel": F.when(F.col("channel") > 0, F.col("channel")).otherwise(1.0), "fit_a": F.coalesce("fit_a", F.lit(0.0))})
    if heal:
        alive = typed.filter("partial >= 0")
        healed = impute_axes(alive, plan)
        typed = healed.unionByName(typed.filter("partial < 0")) if with_dead else healed
    return numbered(R.with_detector_axes(typed, a_is_x))


def given_parameters(plan: DataFrame, min_rows: int, dead_ratio: float = K.DEAD_RATIO) -> DataFrame:
    """(acq_id, dead_ratio, min_rows) for ``episode_spans``, the same for every acquisition."""
    if min_rows < 1 or not 0 < dead_ratio:
        raise ValueError("an episode has one row at least, and the dead ratio is positive")
    return plan.select("acq_id").distinct().select("acq_id", F.lit(float(dead_ratio)).alias("dead_ratio"), F.lit(int(min_rows)).alias("min_rows"))


def assign_auto(rows: DataFrame, plan: DataFrame, method: str = "episodes", min_rows: int | None = None, dead_ratio: float | None = None, **more) -> DataFrame:
    """Assigned rows of auto mode: by episodes of the signal, or in plan order (``plan_sequential``, ``sequential``).

    With ``min_rows``, nothing is inferred: episodes have that many rows at least, between rows at or below the dead ratio.
    """
    table = layer_table(plan)
    if method in ("plan_sequential", "sequential"):
        from .layers import delivery_layers

        got = plan_sequence(prepare_auto(rows, plan, with_dead=True, **more), plan).filter("spot_id >= 0")
        return delivery_layers(delivery_weights(got), table)
    if method != "episodes":
        raise ValueError(f"unknown method: {method}")
    ready = prepare_auto(rows, plan, **more)
    given = None if min_rows is None else given_parameters(plan, min_rows, K.DEAD_RATIO if dead_ratio is None else dead_ratio)
    spans = spread_layers(episode_spans(ready, plan, given), table)
    places = spread(spans.filter("row_end > row_start"), "acq_id").select("acq_id", F.col("span_id").alias("spot_id"), "layer", F.explode(F.sequence(F.col("row_start"), F.col("row_end") - 1)).alias("row_idx"))
    return delivery_weights(ready).join(sorted_beside(places), ["acq_id", "row_idx"])
