"""Configuration of a run: modes, ranges of parameters, aliases."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import constants as K

LAYER_MODES = ("gate_counter", "time_gap", "plan_viterbi", "auto")
AUTO_METHODS = ("episodes", "plan_sequential")
WEIGHT_ALIASES = {
    "": "channel_sum", "channel_sum": "channel_sum", "channel": "channel_sum", "ix512": "channel_sum",
    "fit_amplitude_a": "fit_amplitude_a", "fit_a": "fit_amplitude_a", "a": "fit_amplitude_a",
    "fit_amplitude_b": "fit_amplitude_b", "fit_b": "fit_amplitude_b", "b": "fit_amplitude_b",
}

#: Ranges: (lowest, highest, whether each of them is allowed).
RANGES = {
    "layer_gap_s": (0.0, 3600.0, False, False),
    "refill_tolerance_mm": (0.0, 1000.0, False, False),
    "min_on_weight_na": (0.0, 1e15, True, True),
    "min_episode_rows": (1, 10_000, True, True),
    "penalty_mm2": (0.0, 1e8, True, True),
    "wet_mm": (0.0, 500.0, True, True),
    "flier_sigma": (0.5, 20.0, True, True),
}


def parse(name: str, text: str) -> float | int | None:
    """A number typed by a user, or None if it is malformed or out of its range."""
    low, high, with_low, with_high = RANGES[name]
    try:
        value = int(text.strip()) if isinstance(low, int) else float(text.strip().replace(",", "."))
    except (ValueError, AttributeError):
        return None
    inside = (value >= low if with_low else value > low) and (value <= high if with_high else value < high)
    return value if inside else None


def in_progress(text: str) -> bool:
    """Whether a text may become a number while it is typed."""
    t = text.strip()
    return t in ("", "-", ".", "-.") or t.endswith((".", ",")) or (t.startswith("0") and t.strip("0") in ("", "."))


def parse_thresholds(low: str, high: str) -> tuple[float, float] | None:
    """Pass and warn thresholds, 0 < pass < warn <= 500."""
    try:
        a, b = float(low.strip().replace(",", ".")), float(high.strip().replace(",", "."))
    except (ValueError, AttributeError):
        return None
    return (a, b) if 0 < a < b <= 500 else None


def thresholds_in_progress(low: str, high: str) -> bool:
    return in_progress(low) or in_progress(high)


def weight_mode(name: str | None) -> str:
    key = (name or "").strip().lower().replace("-", "_").replace(" ", "_")
    if key not in WEIGHT_ALIASES:
        raise ValueError(f"unknown weight mode: {name}")
    return WEIGHT_ALIASES[key]


def saved_weight_mode(name: str | None) -> str:
    try:
        return weight_mode(name)
    except ValueError:
        return "channel_sum"


def layer_mode(name: str) -> str:
    key = name.strip().lower()
    if key not in LAYER_MODES:
        raise ValueError(f"unknown layer mode: {name}")
    return key


def chosen_mode(name: str | None) -> str:
    """A mode chosen in an interface: unknown ones, and those that a gate counter replaces, become gate_counter."""
    key = (name or "").strip().lower()
    return key if key in ("gate_counter", "auto", "plan_sequential") else "gate_counter"


def chosen_assignment(name: str | None) -> tuple[str, str, bool]:
    """(layer mode, auto method, whether parameters are inferred) of a chosen mode."""
    key = chosen_mode(name)
    return ("auto", "plan_sequential", True) if key == "plan_sequential" else (key, "episodes", key == "auto")


def resolved_mode(name: str, has_gate: bool, has_plan: bool) -> str:
    """The mode that a file allows."""
    key = name.strip().lower()
    key = key if key in LAYER_MODES else "gate_counter"
    if not has_plan or (key == "gate_counter" and not has_gate):
        return "time_gap"
    return key


@dataclass(frozen=True)
class Config:
    """All settings of a run."""

    layer_mode: str = "gate_counter"
    auto_method: str = "episodes"
    aggregate: bool = True
    weight_mode: str = "channel_sum"
    a_is_x: bool = False
    heal: bool = False
    max_points: int | None = None
    layer_gap_s: float = K.LAYER_GAP_S
    refill_tolerance_mm: float = K.REFILL_TOLERANCE_MM
    penalty_mm2: float | None = K.ADVANCE_PENALTY_MM2
    auto_infer: bool = True
    min_episode_rows: int = 1
    dead_ratio: float = K.DEAD_RATIO
    coarse: bool = False
    flier_sigma: float | None = None
    fine_shift: bool = False
    fine_rotation: bool = False
    fine_scale: bool = False
    pass_mm: float = K.PASS_MM
    warn_mm: float = K.WARN_MM
    pass_pp: float = K.PASS_PP
    warn_pp: float = K.WARN_PP
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        layer_mode(self.layer_mode)
        weight_mode(self.weight_mode)
        if self.auto_method not in AUTO_METHODS:
            raise ValueError(f"unknown auto method: {self.auto_method}")
        if self.layer_gap_s <= 0 or self.refill_tolerance_mm <= 0 or (self.penalty_mm2 is not None and self.penalty_mm2 < 0):
            raise ValueError("gap and tolerance must be positive, the penalty not negative")
        if self.min_episode_rows < 1 or self.dead_ratio <= 0 or (self.max_points is not None and self.max_points < 1):
            raise ValueError("episodes have one row at least, and so has a limit of points; the dead ratio is positive")

    @property
    def position_qa(self) -> bool:
        """Whether the thresholds allow position quality."""
        return 0 <= self.pass_mm < self.warn_mm

    @property
    def dose_qa(self) -> bool:
        return 0 <= self.pass_pp < self.warn_pp
