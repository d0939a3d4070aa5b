"""Texts for reports: counts, times, spot details."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import ship

WEIGHT_NAMES = {"channel_sum": "IX512 channel sum", "fit_amplitude_a": "Fit amplitude A", "fit_amplitude_b": "Fit amplitude B"}


def weight_caption(mode: str) -> str:
    return f"{WEIGHT_NAMES[mode]} (nA)"


def position_caption(n_pass: int, n_warn: int, n_fail: int, pass_mm: float, warn_mm: float) -> str:
    n = n_pass + n_warn + n_fail
    share = lambda k: f"{100 * k / n:.1f} %" if n else "-"
    return f"Position QA: {n_pass} pass ({share(n_pass)}, up to {pass_mm:g} mm), {n_warn} warn ({share(n_warn)}, up to {warn_mm:g} mm), {n_fail} fail ({share(n_fail)})"


def position_captions(n_pass: str, n_warn: str, n_fail: str, pass_mm: float = K.PASS_MM, warn_mm: float = K.WARN_MM) -> Column:
    """The same of columns with counts."""

    def write(p: pd.Series, w: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([position_caption(*map(int, c), pass_mm, warn_mm) for c in zip(p, w, f, strict=True)])

    return F.pandas_udf(write, "string")(n_pass, n_warn, n_fail)


def dose_caption(n_pass: int, over_warn: int, over_fail: int, under_warn: int, under_fail: int, pass_pp: float, warn_pp: float) -> str:
    return f"Dose QA: {n_pass} pass (up to {pass_pp:g} pp), over: {over_warn} warn, {over_fail} fail, under: {under_warn} warn, {under_fail} fail (beyond {warn_pp:g} pp)"


def counts_label(n_pass: int, n_warn: int, n_fail: int) -> str:
    return f"pass {n_pass} / warn {n_warn} / fail {n_fail}"


def tuning_label(parameters: dict | None) -> str:
    """The inferred parameters of auto mode in one line."""
    if not parameters:
        return ""
    names = (("gap_s", "gap", "s"), ("dead_ratio", "dead ratio", ""), ("min_rows", "rows", ""), ("min_on_weight", "weight", "nA"), ("penalty", "penalty", "mm2"))
    return ", ".join(f"{n} {parameters[k]:.4g}{' ' + u if u else ''}" for k, n, u in names if parameters.get(k) is not None)


def auto_lines(n_raw: int, n_spots: int, n_plan: int, ok: bool) -> list[str]:
    """What auto mode found, against the plan."""
    out = [f"episodes: {n_raw} raw, {n_spots} after alignment, {n_plan} planned"]
    return out if ok else [*out, "the number of episodes could not be made to fit the plan"]


def timeline(seconds: float) -> str:
    if seconds is None or not math.isfinite(seconds):
        return "—"
    return f"{int(seconds // 60)}:{seconds % 60:04.1f}"


def timeline_column(seconds: Column) -> Column:
    return F.when(seconds.isNotNull() & ~F.isnan(seconds), F.format_string("%d:%04.1f", F.floor(seconds / 60), F.pmod(seconds, F.lit(60.0)))).otherwise("—")


def number(value: float | None, digits: int = 4) -> str:
    return "—" if value is None or not math.isfinite(value) else f"{value:.{digits}g}"


# The rows of a spot's record, their columns and formats.
_PLAN = (
    ("X", "x", "{:.3f} mm"), ("Y", "y", "{:.3f} mm"), ("Nominal energy", "energy", "{:.3f} MeV"), ("Layer index", "layer", "{:.0f}"), ("Plan MU", "mu", "{:.4g}"),
    ("FWHM X", "fwhm_x", "{:.3g} mm"), ("FWHM Y", "fwhm_y", "{:.3g} mm"), ("Delivery time", "delivery_t", "{:.3f} s"),
)
_MEASURED = (
    ("Fit A", "a", "{:.3f} mm"), ("Fit B", "b", "{:.3f} mm"), ("Layer index", "layer", "{:.0f}"), ("Spot weight", "weight", "{:.4g}"), ("Partial code", "partial", "{:.0f}"),
    ("σ A", "sigma_a", "{:.3g} mm"), ("σ B", "sigma_b", "{:.3g} mm"), ("Delivery time", "t", "{:.3f} s"), ("Plan XY distance", "distance", "{:.3g} mm"),
    ("Expected plan X", "expected_x", "{:.3f} mm"), ("Expected plan Y", "expected_y", "{:.3f} mm"), ("Expected plan E", "expected_energy", "{:.3f} MeV"),
    ("Expected plan MU", "expected_mu", "{:.4g}"), ("Dose deviation", "deviation_pp", "{:.3g} pp"),
)


def _written(pattern: pd.Series, value: pd.Series) -> pd.Series:
    """Numbers by their patterns, which Spark's own functions cannot write (significant digits); missing ones as a dash."""
    dash = lambda p: "—" + p[p.index("}") + 1 :]
    return pd.Series([p.format(v) if v == v and abs(v) != math.inf else dash(p) for p, v in zip(pattern, value.astype(float), strict=True)])


def spot_details(df: DataFrame, kind: str = "measured") -> DataFrame:
    """(acq_id, spot, place, label, value): the record of each spot, one row for each line. Meant for the spots looked at.

    Columns that the frame lacks are left out.
    """
    key, lines = ("spot_idx", _PLAN) if kind == "plan" else ("spot_id", _MEASURED)
    have = [line for line in lines if line[1] in df.columns]
    entries = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("pattern"), F.col(c).cast("double").alias("v")) for label, c, p in have])
    listed = df.select("acq_id", F.col(key).alias("spot"), F.posexplode(entries).alias("place", "p"))
    ship(df.sparkSession)
    return listed.select("acq_id", "spot", "place", "p.label", F.pandas_udf(_written, "string")("p.pattern", "p.v").alias("value"))


def playback_start(start_ms: int, elapsed_ms: float, speed: float, low_ms: int, high_ms: int) -> int:
    """Replay clock: moved on by elapsed time at a speed, within the timeline."""
    return max(low_ms, min(high_ms, round(start_ms + elapsed_ms * speed)))
