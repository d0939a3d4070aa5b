"""Energy layers of a plan, and layers of spots.

Layers are runs of exactly equal energies in delivery order. A spot belongs to the first layer whose energy is within
``ENERGY_TOLERANCE_MEV`` of its own, so an energy that comes back later leaves its second layer empty.
Every frame is keyed by acq_id; windows are over one acquisition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K


def _order() -> WindowSpec:
    return Window.partitionBy("acq_id").orderBy("spot_idx")


def layer_energies(plan: DataFrame) -> DataFrame:
    """(acq_id, layer, energy): one row for each run of energies, with layer from 0."""
    before = F.lag("energy").over(_order())
    runs = plan.select("acq_id", "spot_idx", "energy", (before.isNull() | (before != F.col("energy"))).alias("new")).filter("new")
    return runs.select("acq_id", (F.row_number().over(_order()) - 1).cast("int").alias("layer"), "energy")


def last_layers(plan: DataFrame) -> DataFrame:
    """(acq_id, _last): the number of each plan's last layer."""
    return layer_energies(plan).groupBy("acq_id").agg(F.max("layer").alias("_last"))


def layered(plan: DataFrame) -> DataFrame:
    """Adds layer (first match by energy), local_idx (place among the layer's spots) and last_layer (the plan's).

    All windows are over one acquisition or within one, so the plan is shuffled once and joined with nothing.
    """
    new = ~F.lag("energy").over(_order()).eqNullSafe(F.col("energy"))
    runs = plan.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(_order()).cast("int") - 1)
    whole = Window.partitionBy("acq_id")
    first = F.when(F.col("_new"), F.struct(F.col("_run").alias("layer"), F.col("energy").alias("e")))
    listed = runs.withColumns({"_layers": F.sort_array(F.collect_list(first).over(whole)), "last_layer": F.max("_run").over(whole)})
    near = F.filter("_layers", lambda x: F.abs(x["e"] - F.col("energy")) <= K.ENERGY_TOLERANCE_MEV)
    placed = listed.withColumn("layer", F.get(near, F.lit(0))["layer"]).drop("_layers", "_new", "_run").filter("layer is not null")
    local = Window.partitionBy("acq_id", "layer").orderBy("spot_idx")
    return placed.withColumn("local_idx", (F.row_number().over(local) - 1).cast("int"))


def with_layers(plan: DataFrame) -> DataFrame:
    """Adds layer and local_idx."""
    return layered(plan).drop("last_layer")


def layer_table(plan: DataFrame) -> DataFrame:
    """(acq_id, layer, energy, n_spots, first_slot, total_mu): slots are counted over the layers in order."""
    spots = with_layers(plan).groupBy("acq_id", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("mu").alias("total_mu"))
    table = layer_energies(plan).join(spots, ["acq_id", "layer"], "left").withColumn("n_spots", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n")
    before = Window.partitionBy("acq_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("first_slot", F.coalesce(F.sum("n_spots").over(before), F.lit(0)).cast("bigint")).select("acq_id", "layer", "energy", "n_spots", "first_slot", "total_mu")


def energy_bounds(plan: DataFrame) -> DataFrame:
    return plan.groupBy("acq_id").agg(F.coalesce(F.max("energy"), F.lit(0.0)).alias("e_high"), F.coalesce(F.min("energy"), F.lit(0.0)).alias("e_low"))


def slot_layers(table: DataFrame) -> DataFrame:
    """(acq_id, slot, slot_layer): the layer of every slot in delivery order."""
    full = table.filter("n_spots > 0")
    return full.select("acq_id", F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("n_spots") - 1)).alias("slot"), F.col("layer").alias("slot_layer"))


def layer_edges(table: DataFrame) -> DataFrame:
    """(acq_id, edges, slots, last): the first slots of the layers that have any, number of slots, last layer."""
    first = F.when(F.col("n_spots") > 0, F.struct("first_slot", "layer"))
    return table.groupBy("acq_id").agg(F.sort_array(F.collect_list(first)).alias("_edges"), F.sum("n_spots").alias("_slots"), F.max("layer").alias("_last"))


def delivery_layers(spots: DataFrame, table: DataFrame, spot: str = "spot_id") -> DataFrame:
    """Adds layer by the place of the spot in delivery; spots beyond the plan are of the last layer.

    The layers' first slots come as one short list for each acquisition, so rows that are already together by acq_id
    (after a window) are not shuffled again.
    """
    at = F.filter("_edges", lambda e: e["first_slot"] <= F.col(spot))
    layer = F.when(F.col(spot) < 0, 0).when(F.col(spot) >= F.col("_slots"), F.col("_last")).otherwise(F.try_element_at(at, F.lit(-1))["layer"])
    return spots.join(layer_edges(table), "acq_id", "left").withColumn("layer", F.coalesce(layer, F.lit(0)).cast("int")).drop("_edges", "_slots", "_last")


def spread_layers(spots: DataFrame, table: DataFrame, order: str = "row_start") -> DataFrame:
    """Adds layer so that the spots, ranked by ``order``, spread over the layers in proportion to their sizes.

    Rank i of n falls into the first layer whose cumulated share is above (i + 0.5) / n. In whole numbers: the layer
    holds slot floor((2 i + 1) * total / (2 n)).
    """
    rank = Window.partitionBy("acq_id").orderBy(order, "span_id")
    every = Window.partitionBy("acq_id")
    totals = table.groupBy("acq_id").agg(F.sum("n_spots").alias("_total"))
    ranked = spots.withColumns({"_i": F.row_number().over(rank) - 1, "_n": F.count(F.lit(1)).over(every)}).join(totals, "acq_id", "left")
    slot = F.floor((2 * F.col("_i") + 1) * F.coalesce("_total", F.lit(0)) / (2 * F.col("_n"))).cast("bigint")
    return delivery_layers(ranked.withColumn("_slot", slot), table, "_slot").drop("_slot", "_i", "_n", "_total")


def layer_of_row(layer, last):
    """Layer index of a measured row: rounded half to even, within the plan."""
    return F.greatest(F.lit(0), F.least(last, F.coalesce(F.rint(layer), F.lit(0.0)).cast("int")))


def row_energies(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds nominal energy by the rounded layer within the plan; a missing layer counts as the first."""
    last = table.groupBy("acq_id").agg(F.max("layer").alias("_last"))
    keyed = rows.join(last, "acq_id", "left").withColumn("_layer", layer_of_row(F.col("layer"), F.col("_last")))
    return keyed.join(table.select("acq_id", F.col("layer").alias("_layer"), F.col("energy").alias("nominal_energy")), ["acq_id", "_layer"], "left").drop("_layer", "_last")


def energy_band(table: DataFrame, centre: int, half_width: int = 2) -> DataFrame:
    """Lowest and highest energy of the layers around one, clamped to the plan."""
    last = Window.partitionBy("acq_id")
    c = F.greatest(F.lit(0), F.least(F.lit(centre), F.max("layer").over(last)))
    return table.withColumn("_c", c).filter(F.abs(F.col("layer") - F.col("_c")) <= half_width).groupBy("acq_id").agg(F.min("energy").alias("band_low"), F.max("energy").alias("band_high"))


def nearest_layer_by_energy(rows: DataFrame, table: DataFrame, energy: str = "energy") -> DataFrame:
    """Adds nearest_layer: the first layer with the energy closest to the row's. Layers come as one list for each acquisition."""
    lists = table.groupBy("acq_id").agg(F.sort_array(F.collect_list(F.struct("layer", F.col("energy").alias("e")))).alias("_l"))
    best = F.array_min(F.transform("_l", lambda x: F.struct(F.abs(x["e"] - F.col(energy)).alias("d"), x["layer"].alias("layer"))))
    return rows.join(lists, "acq_id", "left").withColumn("nearest_layer", best["layer"]).drop("_l")
