"""Assignment modes and what follows them: a registry of callables from rows and plan to assigned rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .episodes import assign_auto, assign_by_path
from .gaps import assign_by_gap
from .gates import assign_by_gate, gate_phase_spots
from .nearest import plan_slot
from .spots import plan_slot_spots, uncovered, weighted_spots


@dataclass(frozen=True)
class Mode:
    """A way to assign rows. ``ids_are_slots``: its spot ids count as plan slots."""

    name: str
    assign: Callable[..., DataFrame]
    needs_plan: bool
    ids_are_slots: bool = True


MODES: dict[str, Mode] = {}


def register(mode: Mode) -> Mode:
    MODES[mode.name] = mode
    return mode


register(Mode("gate_counter", assign_by_gate, True))
register(Mode("time_gap", assign_by_gap, False))
register(Mode("plan_viterbi", assign_by_path, True, False))
register(Mode("auto", assign_auto, True))


def assign(rows: DataFrame, plan: DataFrame | None, mode: str, **parameters) -> DataFrame:
    """Assigned rows of a mode: rows with spot_id, layer, weight, partial and positions."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if plan is None and MODES[mode].needs_plan:
        raise ValueError(f"{mode} needs a plan")
    return MODES[mode].assign(rows, plan, **parameters)


def with_plan_slot(assigned: DataFrame, plan: DataFrame, mode: str) -> DataFrame:
    """Adds plan_idx: the spot id where ids are slots, else the nearest spot's slot."""
    if MODES[mode].ids_are_slots:
        return assigned.withColumn("plan_idx", F.col("spot_id").cast("bigint"))
    return plan_slot(assigned, plan)


def coverage(assigned: DataFrame, plan: DataFrame, mode: str) -> DataFrame:
    """Plan spots without any assigned row."""
    return uncovered(plan, with_plan_slot(assigned, plan, mode))


def aggregate(assigned: DataFrame, plan: DataFrame | None, mode: str, method: str = "episodes", regroup: bool | None = None) -> DataFrame:
    """Measured spots. Modes that see the gate counter group by its phases where there are gates (``regroup``)."""
    if mode == "auto" and method in ("plan_sequential", "sequential"):
        return plan_slot_spots(assigned, plan)
    if regroup is None:
        regroup = mode in ("time_gap", "plan_viterbi")
    if regroup:
        from pyspark.sql import Window

        gated = F.max((F.coalesce("gate", F.lit(-1)) >= 0).cast("int")).over(Window.partitionBy("acq_id")) == 1
        phased = gate_phase_spots(assigned)
        assigned = phased.withColumn("spot_id", F.when(gated, F.col("phase_id")).otherwise(F.col("spot_id"))).drop("phase_id")
    return weighted_spots(assigned)
