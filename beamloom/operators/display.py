"""Data of the three-dimensional view: clouds, slices, sizes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import depth as D
from ..functions import rows as R
from .alignment import strided
from .layers import energy_bounds, layer_table, row_energies


def measured_cloud(rows: DataFrame, plan: DataFrame, a_is_x: bool = False, most: int | None = None) -> DataFrame:
    """Measured points with nominal energy; with ``most``, the first rows of each acquisition."""
    placed = row_energies(R.with_plan_axes(rows, a_is_x) if "mx" not in rows.columns else rows, layer_table(plan))
    if most is None:
        return placed
    from pyspark.sql import Window

    return placed.withColumn("_n", F.row_number().over(Window.partitionBy("acq_id").orderBy("row_idx"))).filter(F.col("_n") <= most).drop("_n")


def with_scene_z(points: DataFrame, plan: DataFrame, energy: str = "energy", water: bool = False, metric: str = "csda", wet_mm: float = 0.0) -> DataFrame:
    """Adds scene_z from the plan's range of energies."""
    bounds = energy_bounds(plan)
    return points.join(bounds, "acq_id", "left").withColumn("scene_z", D.scene_z(F.col(energy), F.col("e_low"), F.col("e_high"), water, metric, wet_mm)).drop("e_low", "e_high")


def energy_slice(energy: Column, low: float, high: float) -> Column:
    return energy.between(min(low, high), max(low, high))


def time_slice(t: Column, start: float, window: float, t_min: float | None = None) -> Column:
    """Within [start, start + window]; a window of -1 is everything from t_min to start. Missing times are outside."""
    inside = t.between(t_min if t_min is not None else float("-inf"), start) if window == -1 else t.between(start, start + window)
    return F.coalesce(inside, F.lit(False))


def timeline_range(*frames: DataFrame) -> DataFrame:
    """(acq_id, from_ms, to_ms) over the times of all frames."""
    times = [f.select("acq_id", "t") for f in frames]
    whole = times[0]
    for f in times[1:]:
        whole = whole.unionByName(f)
    return whole.filter("t is not null").groupBy("acq_id").agg(F.floor(F.min("t") * 1000).cast("bigint").alias("from_ms"), F.floor(F.max("t") * 1000).cast("bigint").alias("to_ms"))


def hide_passed(points: DataFrame, metric: str = "distance", limit: float = K.PASS_MM) -> DataFrame:
    """Points beyond the limit, and those without a finite metric."""
    m = F.col(metric)
    return points.filter(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf")) | (m > limit))


def glyph_sizes(plan: DataFrame) -> DataFrame:
    """Adds half_x, half_y, half_z: half widths, bad ones replaced by the acquisition's median of good ones, else 4 mm."""
    good = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c))
    stats = plan.groupBy("acq_id").agg(F.percentile(good("fwhm_x"), F.lit(0.5)).alias("_mx"), F.percentile(good("fwhm_y"), F.lit(0.5)).alias("_my"), ((F.max("energy") - F.min("energy")) * K.GLYPH_SPAN_FRACTION).alias("half_z"))
    half = lambda c, m: F.coalesce(good(c), m, F.lit(K.FWHM_DEFAULT_MM)) / 2
    return plan.join(stats, "acq_id").withColumns({"half_x": half("fwhm_x", F.col("_mx")), "half_y": half("fwhm_y", F.col("_my"))}).drop("_mx", "_my")


def sigma_sizes(rows: DataFrame, scale: float = K.SIGMA_SCALE, a_is_x: bool = False) -> DataFrame:
    """Adds half_x, half_y: scaled widths within 0.02 to 50 mm; missing ones from the median, else the fallback."""
    x, y = ("sigma_a", "sigma_b") if a_is_x else ("sigma_b", "sigma_a")
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    stats = rows.groupBy("acq_id").agg(F.percentile(good(x), F.lit(0.5)).alias("_mx"), F.percentile(good(y), F.lit(0.5)).alias("_my"))
    half = lambda c, m: F.greatest(F.lit(K.SIGMA_MIN_MM), F.least(F.lit(K.SIGMA_MAX_MM), scale * F.coalesce(good(c), m, F.lit(K.SIGMA_FALLBACK_MM))))
    return rows.join(stats, "acq_id").withColumns({"half_x": half(x, F.col("_mx")), "half_y": half(y, F.col("_my"))}).drop("_mx", "_my")


def crosses(missing: DataFrame, arm: float = K.CROSS_ARM_MM) -> DataFrame:
    """Two segments at each missing spot."""
    seg = lambda dx, dy: F.struct((F.col("x") - dx).alias("x0"), (F.col("y") - dy).alias("y0"), (F.col("x") + dx).alias("x1"), (F.col("y") + dy).alias("y1"))
    return missing.select("acq_id", "spot_idx", "energy", F.explode(F.array(seg(arm, 0.0), seg(0.0, arm))).alias("s")).select("acq_id", "spot_idx", "energy", "s.*")


def display_sample(points: DataFrame, glyphs: bool = False) -> DataFrame:
    """Every n-th point, within the display's budget."""
    return strided(points, K.GLYPH_CAP if glyphs else K.POINT_TARGET)


def sliced(points: DataFrame, energies: tuple[float, float] | None = None, start: float | None = None, window: float = -1, energy: str = "nominal_energy", t: str = "t", t_min: float | None = None) -> DataFrame:
    """Points within a range of energies and of times, where these are given."""
    if energies is not None:
        points = points.filter(energy_slice(F.col(energy), *energies))
    return points if start is None else points.filter(time_slice(F.col(t), start, window, t_min))


def error_segments(matched: DataFrame, plan: DataFrame, pass_mm: float = K.PASS_MM, water: bool = False) -> DataFrame:
    """Segments of the view from measured to expected positions beyond the pass threshold, with scene heights of both ends."""
    far = row_energies(matched, layer_table(plan)).filter((F.col("distance") > pass_mm) & F.col("expected_x").isNotNull())
    ends = with_scene_z(with_scene_z(far, plan, "nominal_energy", water).withColumnRenamed("scene_z", "z0"), plan, "expected_energy", water)
    return ends.select("acq_id", "row_idx", F.col("mx").alias("x0"), F.col("my").alias("y0"), "z0", F.col("expected_x").alias("x1"), F.col("expected_y").alias("y1"), F.col("scene_z").alias("z1"))


COLOURINGS = ("position", "dose", "weight")


def display_measured(matched: DataFrame, plan: DataFrame, low: float | None = None, high: float | None = None, hide: bool = False, glyphs: bool = False, water: bool = False, colour: str = "position") -> DataFrame:
    """Measured points of the view: colours, heights, sizes, within the budget.

    Colours are by position tiers, by dose tiers (of rows with ``signed_pp`` and ``deviation_pp``), or by weight. With
    ``hide``, points that pass in the metric of their colour are left out; weights hide none.
    """
    from ..functions import colors

    if colour not in COLOURINGS:
        raise ValueError(f"unknown colouring: {colour}")
    metric, usual = ("deviation_pp", (K.PASS_PP, K.WARN_PP)) if colour == "dose" else ("distance", (K.PASS_MM, K.WARN_MM))
    low, high = usual[0] if low is None else low, usual[1] if high is None else high
    shown = display_sample(hide_passed(matched, metric, low) if hide and colour != "weight" else matched, glyphs)
    painted = colors.by_weight(shown) if colour == "weight" else colors.by_dose(shown, low, high) if colour == "dose" else colors.by_position(shown, low, high)
    return with_scene_z(row_energies(sigma_sizes(painted), layer_table(plan)), plan, "nominal_energy", water)


def display_plan(plan: DataFrame, missing: DataFrame, water: bool = False) -> DataFrame:
    """Plan spots of the view, with sizes, heights, and whether nothing was delivered to them."""
    gone = missing.select("acq_id", "spot_idx", F.lit(True).alias("_gone"))
    marked = glyph_sizes(plan).join(gone, ["acq_id", "spot_idx"], "left").withColumn("missing", F.coalesce("_gone", F.lit(False))).drop("_gone")
    return with_scene_z(marked, plan, "energy", water)
