"""Nearest spots by cells: an equi-join of rows with the spots around their cell.

Each list of spots (a plan's layer, or a plan) has a grid of its own, with cells a little larger than the spots' distance.
Every spot is put into the nine cells around it, so a cell has all spots of its neighbourhood. It keeps those that can be
the nearest one somewhere in the cell: no farther at its closest point than another one at its farthest. A row joins the
one cell that it lies in: rows are not multiplied, they meet the few spots near them, and a long acquisition is spread
over as many keys as it has cells. The nearest spot there is the nearest of all if it is closer than the border of the
nine cells. The few rows for which it isn't, far from any spot, join the whole list; the others have a key there that is
no list's, different enough not to gather anywhere. Cells and lists are joined by sorting, never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.partitions import partitions, sorted_beside

SPOT = ("spot_idx", "local_idx", "x", "y", "energy", "mu")
_NOWHERE, _SPREAD = 1 << 40, 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _side(wide: Column, high: Column, n: Column) -> Column:
    wide, high = F.greatest(wide, F.lit(1e-9)), F.greatest(high, F.lit(1e-9))
    return 1.2 * F.greatest(F.sqrt(wide * high / n), F.greatest(wide, high) / n)


def with_boxes(spots: DataFrame, keys: list[str]) -> DataFrame:
    """Adds box, a struct (x0, y0, side), to spots: the grid of their list."""
    w = Window.partitionBy(*keys)
    low = {c: F.min(c).over(w) for c in "xy"}
    wide, high = (F.max(c).over(w) - low[c] for c in "xy")
    return spots.withColumn("box", F.struct(low["x"].alias("x0"), low["y"].alias("y0"), _side(wide, high, F.count(F.lit(1)).over(w)).alias("side")))


def _squared(s: Column, mx: Column, my: Column) -> Column:
    return (s["x"] - mx) * (s["x"] - mx) + (s["y"] - my) * (s["y"] - my)


def _possible(spots: Column, x: Column, y: Column, side: Column, at: Callable[[Column], Column] = lambda s: s) -> Column:
    """The spots that can be the nearest one of a point in the cell from (x, y) on."""
    low = lambda v, c: F.greatest(c - v, v - c - side, F.lit(0.0))
    high = lambda v, c: F.greatest(F.abs(v - c), F.abs(v - c - side))
    far = F.array_min(F.transform(spots, lambda s: high(at(s)["x"], x) * high(at(s)["x"], x) + high(at(s)["y"], y) * high(at(s)["y"], y)))
    near = lambda s: low(s["x"], x) * low(s["x"], x) + low(s["y"], y) * low(s["y"], y)
    return _let(far, lambda most: F.filter(spots, lambda s: near(at(s)) <= most * (1 + 1e-9)))


def _border(u: Column, v: Column, side: Column) -> Column:
    """Squared distance to the border of the nine cells around (u, v), a little less."""
    inner = F.least(u - F.floor(u), F.ceil(u) - u, v - F.floor(v), F.ceil(v) - v)
    return ((1 + inner) * side) * ((1 + inner) * side) * (1 - 1e-9)


def nearest(rows: DataFrame, boxed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds near, a struct (d2, spot), the nearest of the row's list, to rows with the keys, mx, my and box.

    Of equal distances the lowest spot_idx counts. NULL without a position, or without spots. ``boxed`` are spots with box.
    """
    spot = F.struct(*SPOT).alias("spot")
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cell = lambda p, c: F.floor((F.col(p) - F.col("box")[f"{c}0"]) / F.col("box")["side"])
    around = boxed.select(*keys, spot, "box", cell("x", "x").alias("cx"), cell("y", "y").alias("cy"))
    around = around.withColumn("_cx", F.explode(F.transform(step, lambda i: F.col("cx") + i))).withColumn("_cy", F.explode(F.transform(step, lambda i: F.col("cy") + i)))
    cells = around.groupBy(*keys, "_cx", "_cy").agg(F.collect_list("spot").alias("_spots"), F.first("box").alias("_b"))
    corner = lambda c: F.col("_b")[f"{c}0"] + F.col(f"_c{c}") * F.col("_b")["side"]
    cells = cells.withColumn("_spots", _possible(F.col("_spots"), corner("x"), corner("y"), F.col("_b")["side"])).drop("_b")
    lists = boxed.select(*keys, spot).groupBy(*keys).agg(F.collect_list("spot").alias("_every"), F.least(F.count(F.lit(1)), F.lit(0)).alias("_all"))  # 0, but no literal: that would be no key of the join

    best = lambda c: F.array_min(F.transform(F.col(c), lambda s: F.struct(_squared(s, F.col("mx"), F.col("my")).alias("d2"), s.alias("spot"))))
    there = F.col("mx").isNotNull() & F.col("my").isNotNull() & F.col("box").isNotNull()
    u, v = ((F.col(p) - F.col("box")[f"{c}0"]) / F.col("box")["side"] for p, c in (("mx", "x"), ("my", "y")))
    names = [c for c in ("row_idx", "spot_id", "span_id", "t") if c in rows.columns]
    spread = F.pmod(F.xxhash64(*names) if names else F.lit(0), F.lit(_SPREAD))
    placed = rows.withColumns({"_cx": F.when(there, F.floor(u)).otherwise(_NOWHERE + spread), "_cy": F.when(there, F.floor(v)).otherwise(0).cast("bigint")})
    n = partitions(rows)
    dealt = lambda table, *by: table.repartition(n, *by) if n else table
    met = dealt(placed, *keys, "_cx", "_cy").join(sorted_beside(cells), [*keys, "_cx", "_cy"], "left").withColumn("_near", best("_spots")).drop("_spots", "_cx", "_cy")
    sure = ~there | F.coalesce(F.col("_near")["d2"] < _border(u, v, F.col("box")["side"]), F.lit(False))
    met = met.withColumn("_all", F.when(sure, -1 - spread).otherwise(0).cast("bigint"))
    return dealt(met, *keys, "_all").join(sorted_beside(lists), [*keys, "_all"], "left").withColumn("near", F.when(F.col("_all") < 0, F.col("_near")).otherwise(best("_every"))).drop("_near", "_all", "_every", "box")
