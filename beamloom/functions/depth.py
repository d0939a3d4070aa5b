"""Energy to depth in water, and to the scene's depth axis."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

_TOP = K.RANGE_FIRST_MEV + K.RANGE_STEP_MEV * (len(K.RANGE_MM) - 1)
METRICS = ("csda", "r90", "r80")


def _power(e0: float, r0: float, e1: float, r1: float, anchor_e: float, anchor_r: float) -> tuple[float, float]:
    """Factor and exponent of the power law with the slope of two points, through the anchor."""
    p = math.log(r1 / r0) / math.log(e1 / e0)
    return anchor_r / anchor_e**p, p


LOW = _power(10.0, K.RANGE_MM[0], 20.0, K.RANGE_MM[2], 10.0, K.RANGE_MM[0])
HIGH = _power(340.0, K.RANGE_MM[-3], 350.0, K.RANGE_MM[-1], _TOP, K.RANGE_MM[-1])


def metric(name: str | None) -> str:
    key = str(name).strip().lower()
    return key if key in METRICS else "csda"


def csda_range_mm(energy: Column) -> Column:
    """Range in water: linear between table energies, power laws beyond both ends."""
    e = F.greatest(energy, F.lit(1e-6))
    place = F.least(F.floor((e - K.RANGE_FIRST_MEV) / K.RANGE_STEP_MEV), F.lit(len(K.RANGE_MM) - 2)).cast("int")
    table = F.array(*[F.lit(float(r)) for r in K.RANGE_MM])
    low, high = F.get(table, place), F.get(table, place + 1)
    share = (e - (K.RANGE_FIRST_MEV + place * K.RANGE_STEP_MEV)) / K.RANGE_STEP_MEV
    return F.when(e < K.RANGE_FIRST_MEV, LOW[0] * F.pow(e, F.lit(LOW[1]))).when(e > _TOP, HIGH[0] * F.pow(e, F.lit(HIGH[1]))).otherwise(low + (high - low) * share)


def water_depth_mm(energy: Column, name: str = "csda") -> Column:
    r = csda_range_mm(energy)
    match metric(name):
        case "r90":
            return F.greatest(F.lit(0.0), K.R90_SCALE * r - K.R90_OFFSET_MM)
        case "r80":
            return F.greatest(F.lit(0.0), K.R80_SCALE * r - K.R80_OFFSET_MM)
    return r


def shifted_depth_mm(energy: Column, name: str = "csda", wet_mm: float = 0.0) -> Column:
    """Depth behind a range shifter of wet_mm of water, not below 0."""
    return F.greatest(water_depth_mm(energy, name) - max(0.0, wet_mm), F.lit(0.0))


def scene_z(energy: Column, e_low: Column, e_high: Column, water: bool = False, name: str = "csda", wet_mm: float = 0.0) -> Column:
    """Scene height: the plan's range of energies (or depths) turned upside down, so deep layers are low."""
    if not water:
        return e_high + e_low - energy
    d0, d1 = shifted_depth_mm(e_low, name, wet_mm), shifted_depth_mm(e_high, name, wet_mm)
    low, high = F.least(d0, d1), F.greatest(d0, d1)
    return F.when(high <= low, low + 1.0).otherwise(high) + low - shifted_depth_mm(energy, name, wet_mm)


def label_at(z: Column, z_min: Column, z_max: Column, at_min: Column, at_max: Column) -> Column:
    """Axis label at scene height z, within the axis; NULL on an axis without length."""
    share = F.least(F.greatest((z - z_min) / (z_max - z_min), F.lit(0.0)), F.lit(1.0))
    return F.when(z_min != z_max, at_min + (at_max - at_min) * share)


def axis_label_count(low: float, high: float, step: float, most: int = K.AXIS_LABELS_MAX) -> int:
    span = abs(high - low)
    if not (step > 0 and math.isfinite(step) and math.isfinite(span) and span > 0):
        return 5
    return max(5, min(math.ceil(span / step) + 1, most))


def end_labels(points: list[tuple[float, float]], z_min: float, z_max: float) -> tuple[float, float]:
    """Labels at both ends of an axis from (z, label) points; of equal heights the last counts; the ends' slopes go on."""
    if not points:
        return 0.0, 1.0
    kept = sorted(dict(sorted(points, key=lambda p: p[0])).items())
    if len(kept) == 1:
        return kept[0][1], kept[0][1]

    def at(z: float) -> float:
        i = min(max(1, sum(p[0] < z for p in kept)), len(kept) - 1)
        (z0, v0), (z1, v1) = kept[i - 1], kept[i]
        return v0 + (v1 - v0) / (z1 - z0) * (z - z0) if abs(z1 - z0) >= 1e-12 else v0

    return at(z_min), at(z_max)


def axis_spec(points: list[tuple[float, float]], water: bool, tick: float = K.AXIS_TICK_MM) -> dict:
    """Depth axis of a scene from (scene height, depth or energy) points: ends, their labels, number of labels, title."""
    heights = [z for z, _ in points] or [0.0, 1.0]
    low, high = min(heights), max(heights)
    if not high - low > 0:
        pad = 0.5 if water else 1.0
        low, high = low - pad, high + pad
    a, b = end_labels(points, low, high)
    step = tick if tick > 0 and math.isfinite(tick) else K.AXIS_TICK_MM
    return {"z_min": low, "z_max": high, "label_at_min": a, "label_at_max": b, "n_labels": axis_label_count(a, b, step), "title": "Water depth (mm)" if water else "Z (MeV)"}
