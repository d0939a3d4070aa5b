"""Nearest plan spots: on a layer, over the whole plan, along one axis.

On a layer or over a plan, rows meet the spots around their cell (``cells.nearest``). The nearest spot along an axis is found
by sorting rows and spots together. Nothing is multiplied by the number of spots and no row goes to a group. Equal
distances go to the lowest spot_idx. Rows of a whole run stay where they are, by acquisition: they are put into pieces, which
meet their plan's spots and are taken apart again (``_own_spot``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R
from ..session import ship
from ..sources.partitions import partitions, sorted_beside
from .cells import nearest, with_boxes
from .grid import Layers, OwnLayer
from .layers import layer_energies, layer_of_row, layer_table, layered, with_layers

PIECE = 256  # row numbers of one piece: an Arrow batch has up to 10,000 pieces


def _with_match(rows: DataFrame) -> DataFrame:
    spot = F.col("near.spot")
    return rows.withColumns(
        {
            "distance": F.coalesce(F.sqrt(F.col("near.d2")), F.lit(float("inf"))),
            "expected_x": spot["x"],
            "expected_y": spot["y"],
            "expected_energy": spot["energy"],
            "expected_mu": spot["mu"],
            "nn_spot_idx": spot["spot_idx"],
            "nn_local_idx": F.coalesce(spot["local_idx"], F.lit(-1)),
        }
    ).drop("near")


def match_on_layer(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the nearest spot of the row's layer (rounded, within the plan).

    distance is infinite, and the expected values missing, for rows without a position and on layers without spots.
    """
    boxed = with_boxes(layered(plan), ["acq_id", "layer"])
    boxes = boxed.groupBy("acq_id", "layer").agg(F.first("last_layer").alias("_last"), F.first("box").alias("box"))
    boxes = boxes.groupBy("acq_id").agg(F.max("_last").alias("_last"), F.map_from_entries(F.collect_list(F.struct("layer", "box"))).alias("_boxes"))
    placed = rows.join(boxes, "acq_id", "left").withColumn("_layer", layer_of_row(F.col("layer"), F.col("_last")))
    placed = placed.withColumn("box", F.try_element_at("_boxes", F.col("_layer"))).drop("_boxes", "_last")
    return _with_match(nearest(placed, boxed.withColumnRenamed("layer", "_layer"), ["acq_id", "_layer"])).drop("_layer")


def _near_any(rows: DataFrame, spots: DataFrame) -> DataFrame:
    boxed = with_boxes(spots.withColumn("local_idx", F.col("spot_idx").cast("int")), ["acq_id"])
    boxes = boxed.groupBy("acq_id").agg(F.first("box").alias("box"))
    return nearest(rows.join(boxes, "acq_id", "left"), boxed, ["acq_id"])


def match_on_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the nearest spot whatever its layer."""
    return _with_match(_near_any(rows, plan))


def plan_slot(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds plan_idx: the slot of the nearest spot on the row's layer, where the layer's number is cut off, not rounded."""
    table = layer_table(plan)
    cut = rows.withColumn("_keep", F.col("layer")).withColumn("layer", F.col("layer").cast("int").cast("double"))
    matched = match_on_layer(cut, plan).withColumn("layer", F.col("_keep")).drop("_keep")
    first = table.select("acq_id", F.col("layer").alias("_cut"), "first_slot")
    out = matched.withColumn("_cut", F.col("layer").cast("int")).join(first, ["acq_id", "_cut"], "left")
    return out.withColumn("plan_idx", F.when(F.col("nn_local_idx") >= 0, F.col("first_slot") + F.col("nn_local_idx")).otherwise(-1)).drop("_cut", "first_slot")


def _squared_by_layer(xs: pa.Array, ys: pa.Array, at: pa.Array, px: pa.Array, py: pa.Array, n: pa.Array) -> pa.Array:
    """For each piece of rows, the distances of its positions to the layers of its plan."""
    x, y = (v.values.to_numpy(zero_copy_only=False) for v in (xs, ys))
    there = (pc.is_valid(xs.values).to_numpy(zero_copy_only=False)) & (pc.is_valid(ys.values).to_numpy(zero_copy_only=False))
    plan = [v.values.to_numpy(zero_copy_only=False) for v in (at, px, py)]
    ends, places = xs.offsets.to_numpy(), at.offsets.to_numpy()
    known, found, hidden, sizes = (None, None), [np.empty(0)], [np.empty(0, bool)], [np.empty(0, np.int64)]
    for i, layers in enumerate(n.fill_null(0).to_numpy()):
        k, sx, sy = (v[places[i] : places[i + 1]] for v in plan)
        if (key := (layers, k.tobytes(), sx.tobytes(), sy.tobytes())) != known[0]:  # pieces of a plan mostly follow each other
            known = key, Layers(np.column_stack([sx, sy]), k.astype(np.int64), int(layers))
        part = slice(ends[i], ends[i + 1])
        d2 = known[1].squared(np.column_stack([x[part], y[part]]))
        none = np.repeat(~there[part, None], layers, axis=1)
        none[:, known[1].without] = True
        found.append(d2.ravel())
        hidden.append(none.ravel())
        sizes.append(np.full(len(d2), layers, np.int64))
    rows = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int32), pa.array(np.concatenate(found), mask=np.concatenate(hidden)))
    return pa.ListArray.from_arrays((ends - ends[0]).astype(np.int32), rows)


def layer_distances(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds emit: for each layer of the plan in order, the squared distance to its nearest spot (NULL without).

    The rows of an acquisition are put into pieces of at most ``PIECE`` row numbers, where they are. The plan's spots come to a
    piece as one list, numpy finds the distances of its rows, and the piece becomes rows again. Rows are shuffled once, by acq_id."""
    ship(rows.sparkSession)
    placed = with_layers(plan).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    spots = placed.groupBy("acq_id").agg(F.collect_list(F.struct("layer", "x", "y")).alias("_s"))
    lists = layer_energies(plan).groupBy("acq_id").agg((F.max("layer") + 1).alias("_n")).join(sorted_beside(spots), "acq_id", "left")
    light = [c for c in rows.columns if c != "acq_id"]
    n = partitions(rows)
    pieces = rows.repartition(*([n] if n else []), "acq_id").groupBy("acq_id", F.floor(F.col("row_idx") / PIECE).alias("_piece")).agg(F.collect_list(F.struct(*light)).alias("_rows"))
    met = pieces.join(sorted_beside(lists), "acq_id", "left")
    squared = F.arrow_udf(_squared_by_layer, "array<array<double>>")(F.col("_rows")["mx"].cast("array<double>"), F.col("_rows")["my"].cast("array<double>"), *[F.coalesce(F.col("_s")[c], F.array()).cast(f"array<{kind}>") for c, kind in (("layer", "int"), ("x", "double"), ("y", "double"))], F.col("_n"))
    each = met.withColumn("_d2", squared).select("acq_id", "_n", F.explode(F.arrays_zip("_rows", "_d2")).alias("_z"))
    return each.select(*[F.col("acq_id") if c == "acq_id" else F.col("_z")["_rows"][c].alias(c) for c in rows.columns], F.when(F.col("_n").isNotNull(), F.col("_z")["_d2"]).alias("emit"))


def distances_long(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, row_idx, layer, d2): for each row and layer the squared distance to the nearest spot (infinite without)."""
    met = layer_distances(rows.select("acq_id", "row_idx", "mx", "my"), plan).select("acq_id", "row_idx", F.posexplode("emit").alias("layer", "d2"))
    return met.withColumn("d2", F.coalesce("d2", F.lit(float("inf"))))


def _nearest_along(rows: DataFrame, spots: DataFrame, axis: str, value: Column, keys: list[str]) -> DataFrame:
    """(acq_id, row_idx, _s): the spot nearest to each row along one axis, by sorting rows and spots together.

    Of spots with equal distances the lowest spot_idx counts. Going up, the last spot before a row is the nearest one
    below it; going down, the nearest one above it.
    """
    once = spots.groupBy(*keys, F.col(axis).alias("_v")).agg(F.min(F.struct("spot_idx", "x", "y")).alias("_p"))
    places = once.select(*keys, "_v", F.lit(None).cast("bigint").alias("row_idx"), F.struct(F.col("_v").alias("v"), "_p.*").alias("_p"))
    wanted = rows.select(*keys, value.alias("_v"), "row_idx", F.lit(None).cast(dict(places.dtypes)["_p"]).alias("_p"))
    both = places.unionByName(wanted)
    up, down = (Window.partitionBy(*keys).orderBy(v, F.col("_p").isNull()) for v in (F.col("_v").asc(), F.col("_v").desc()))
    seen = lambda w: F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_a", seen(up)).withColumn("_b", seen(down)).filter("row_idx is not null")
    far = lambda c: F.struct(F.abs(F.col(c)["v"] - F.col("_v")).alias("d"), F.col(c)["spot_idx"].alias("spot_idx"), F.col(c)["x"].alias("x"), F.col(c)["y"].alias("y"))
    best = F.least(F.when(F.col("_a").isNotNull(), far("_a")), F.when(F.col("_b").isNotNull(), far("_b")))
    return found.select(*keys, "row_idx", best.alias("_s"))


def impute_axes(rows: DataFrame, spots: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Completes rows with one axis: both axes become those of the spot that is nearest along the known one.

    Rows without any axis become the spot with the smallest x. ``spots`` are a plan's, or a layer's (with its key in ``on``).
    """
    keys = on or ["acq_id"]
    only_x, only_y = rows.filter("mx is not null and my is null"), rows.filter("mx is null and my is not null")
    near = _nearest_along(only_x, spots, "x", F.col("mx"), keys).unionByName(_nearest_along(only_y, spots, "y", F.col("my"), keys))
    near = near.select("acq_id", "row_idx", F.col("_s.x").alias("_x1"), F.col("_s.y").alias("_y1"))
    left = spots.groupBy(*keys).agg(F.min(F.struct("x", "spot_idx", "y")).alias("_l"))
    none = F.col("mx").isNull() & F.col("my").isNull()
    joined = rows.join(sorted_beside(near), ["acq_id", "row_idx"], "left").join(left, keys, "left")
    x, y = F.when(none, F.col("_l.x")).otherwise(F.coalesce("_x1", "mx")), F.when(none, F.col("_l.y")).otherwise(F.coalesce("_y1", "my"))
    return joined.withColumns({"_x1": x, "_y1": y}).withColumns({"mx": F.col("_x1"), "my": F.col("_y1")}).drop("_x1", "_y1", "_l")


def _found(find: Callable[[OwnLayer, np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., pa.Array]:
    """For each piece of rows, the spots of its plan that ``find`` gives for its positions and layers, as lists of (x, y), and
    the positions completed by them, as mx and my."""

    def pieces(layers: pa.Array, xs: pa.Array, ys: pa.Array, at: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        plain = lambda v, missing: v.values.fill_null(missing).to_numpy(zero_copy_only=False)
        layer, q = plain(layers, -1), np.column_stack([plain(xs, np.nan), plain(ys, np.nan)])
        there = np.column_stack([pc.is_valid(v.values).to_numpy(zero_copy_only=False) for v in (xs, ys)])
        of, points = plain(at, -1), np.column_stack([plain(px, np.nan), plain(py, np.nan)])
        ends, places, known, found = xs.offsets.to_numpy(), at.offsets.to_numpy(), (None, None), np.full((len(q), 2), np.nan)
        for i in range(len(xs)):
            part, spots = slice(ends[i], ends[i + 1]), slice(places[i], places[i + 1])
            if (key := (of[spots].tobytes(), points[spots].tobytes())) != known[0]:  # pieces of a plan mostly follow each other
                known = key, OwnLayer(points[spots], of[spots])
            k = find(known[1], q[part], layer[part], there[part])
            found[part][k >= 0] = points[spots][k[k >= 0]]
        done = np.where(~there.all(axis=1)[:, None] & ~np.isnan(found), found, q)
        columns = np.column_stack([found, done])[ends[0] : ends[-1]].T
        each = pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in columns], ["x", "y", "mx", "my"])
        return pa.ListArray.from_arrays((ends - ends[0]).astype(np.int32), each)

    return pieces


def _own_spot(rows: DataFrame, plan: DataFrame, layer: Callable[[Column, Column], Column], find: Callable[[OwnLayer, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Adds own, a struct (x, y, mx, my): the spot that ``find`` gives for each row on its layer (NULL without), and the row's
    position, completed by it. ``layer`` is the layer's number, of the row's layer and the plan's last one.

    The rows of an acquisition are put into pieces of at most ``PIECE`` row numbers, where they are, as for ``layer_distances``.
    Rows that are together by acq_id are not shuffled, others once; only a plan's spots are, as one list for each acquisition."""
    ship(rows.sparkSession)
    placed = layered(plan)
    last = placed.groupBy("acq_id").agg(F.max("last_layer").alias("_last"))
    lists = placed.groupBy("acq_id").agg(F.sort_array(F.collect_list(F.struct("spot_idx", "layer", "x", "y"))).alias("_s"))
    at = rows.join(sorted_beside(last), "acq_id", "left").withColumn("_own", layer(F.col("layer"), F.col("_last")).cast("int")).drop("_last")
    light = F.struct(*[c for c in at.columns if c != "acq_id"])
    pieces = at.groupBy("acq_id", F.floor(F.col("row_idx") / PIECE).alias("_piece")).agg(F.collect_list(light).alias("_rows"))
    met = pieces.join(sorted_beside(lists), "acq_id", "left")
    column = lambda c, kind: F.col("_rows")[c].cast(f"array<{kind}>")
    planned = [F.coalesce(F.col("_s")[c], F.array()).cast(f"array<{kind}>") for c, kind in (("layer", "int"), ("x", "double"), ("y", "double"))]
    spots = F.arrow_udf(_found(find), "array<struct<x:double,y:double,mx:double,my:double>>")(column("_own", "int"), column("mx", "double"), column("my", "double"), *planned)
    each = met.withColumn("_f", spots).select("acq_id", F.explode(F.arrays_zip("_rows", "_f")).alias("_z"))
    return each.select(*[F.col("acq_id") if c == "acq_id" else F.col("_z")["_rows"][c].alias(c) for c in rows.columns], F.col("_z")["_f"].alias("own"))


def _completing(spots: OwnLayer, q: np.ndarray, layer: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Places of the spots that complete one-axis rows, and rows without an axis; -1 for others."""
    x, y = there.T
    some = spots.along(q, layer, x & ~y, 0)
    some = np.where(~x & y, spots.along(q, layer, ~x & y, 1), some)
    return np.where(~x & ~y, spots.leftmost(layer, ~x & ~y), some)


def _whole(spots: OwnLayer, q: np.ndarray, layer: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Places of the spots nearest to rows with both axes; -1 for others."""
    return spots.nearest(q, layer, there.all(axis=1))


def _either(spots: OwnLayer, q: np.ndarray, layer: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(there.all(axis=1), _whole(spots, q, layer, there), _completing(spots, q, layer, there))


def own_spot(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds own, a struct with the nearest spot (x, y) of the row's layer (rounded, within the plan), NULL without."""
    return _own_spot(rows, plan, layer_of_row, _whole)


def impute_on_layer(rows: DataFrame, plan: DataFrame, keep_own: bool = False) -> DataFrame:
    """The same within each row's own layer. ``keep_own`` adds own with the nearest spot (x, y) of complete rows, and for others
    the one that completes them, which is their nearest one then. So ``flier_score`` has nothing to look up again."""
    found = _own_spot(rows, plan, lambda layer, last: layer.cast("int"), _either if keep_own else _completing)
    whole = found.withColumns({"mx": F.col("own.mx"), "my": F.col("own.my")})
    return whole if keep_own else whole.drop("own")


def distance_to_energy(rows: DataFrame, plan: DataFrame, energy: float) -> DataFrame:
    """Adds distance_to_energy: the distance to the nearest spot of one nominal energy."""
    spots = plan.filter(F.abs(F.col("energy") - energy) <= K.ENERGY_TOLERANCE_MEV)
    distance = F.coalesce(F.sqrt("near.d2"), F.lit(float("inf")))
    return _near_any(rows, spots).withColumn("distance_to_energy", distance).drop("near")


def flier_score(rows: DataFrame, plan: DataFrame, a_is_x: bool = False, fallback: float = K.SIGMA_FALLBACK_MM) -> DataFrame:
    """Rows with score: the distance to the nearest spot of their layer, which may be known (``own``), in units of the row's
    widths (NULL without a spot)."""
    known = rows if "own" in rows.columns else own_spot(rows, plan)
    m = R.sigma_xy(known, a_is_x, fallback)
    dx, dy = (F.col("mx") - F.col("own.x")) / F.col("sx"), (F.col("my") - F.col("own.y")) / F.col("sy")
    return m.withColumn("score", F.sqrt(dx * dx + dy * dy)).drop("own")


def filter_fliers(rows: DataFrame, plan: DataFrame, n_sigma: float = K.FLIER_SIGMA, a_is_x: bool = False, fallback: float = K.SIGMA_FALLBACK_MM) -> DataFrame:
    """Rows within n_sigma of their expected spot, and rows without one. Nothing is filtered for n_sigma up to 0."""
    if n_sigma <= 0:
        return rows.drop("own")
    kept = flier_score(rows, plan, a_is_x, fallback).filter(F.coalesce(F.col("score") <= float(n_sigma), F.lit(True)))
    return kept.select(*[c for c in rows.columns if c != "own"])


def error_lines(matched: DataFrame, pass_mm: float = K.PASS_MM) -> DataFrame:
    """Segments from measured to expected position, of rows beyond the pass threshold."""
    far = matched.filter((F.col("distance") > pass_mm) & F.col("expected_x").isNotNull())
    return far.select("acq_id", "row_idx", F.col("mx").alias("x0"), F.col("my").alias("y0"), F.col("expected_x").alias("x1"), F.col("expected_y").alias("y1"), "distance")


def align_pairs(matched: DataFrame) -> DataFrame:
    """Pairs for a fit: rows with a position, an expected spot and a positive weight."""
    w = R.align_weight(F.col("weight"))
    return matched.filter("mx is not null and my is not null and expected_x is not null").select("acq_id", "row_idx", "mx", "my", F.col("expected_x").alias("px"), F.col("expected_y").alias("py"), w.alias("w"))
