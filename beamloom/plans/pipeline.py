"""The whole dataflow: rows and plan to measured spots, quality, coverage and the combined export.

Phases are DataFrame transforms, the alignment fits too (a table of transforms by acquisition), so nothing runs before a
result is asked for. A progress callback is told the name of each phase as its plan is made.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..config import Config, resolved_mode
from ..functions import rows as R
from ..operators import alignment, assign, nearest, quality, spots
from ..operators.layers import layer_table
from ..sources import acquisition, plans

log = logging.getLogger("beamloom")
Progress = Callable[[str], None]


def quiet(phase: str) -> None:
    log.info("phase: %s", phase)


@dataclass(frozen=True)
class Result:
    """Lazy results of a run. ``measured`` has the fine-aligned spots where that helped; ``coarse`` and ``fine`` are the
    tables of transforms, and None where that alignment wasn't asked for."""

    plan: DataFrame
    assigned: DataFrame
    measured: DataFrame
    matched: DataFrame
    missing: DataFrame
    delivery: DataFrame
    mode: str
    coarse: DataFrame | None
    fine: DataFrame | None

    def position_counts(self, config: Config) -> DataFrame | None:
        """None where the thresholds are no thresholds."""
        if not config.position_qa:
            return None
        return quality.position_counts(self.matched, config.pass_mm, config.warn_mm)

    def dose_counts(self, config: Config) -> DataFrame | None:
        if not config.dose_qa:
            return None
        return quality.dose_counts(quality.dose_fractions(self.measured, self.plan), config.pass_pp, config.warn_pp)

    def captions(self) -> DataFrame | None:
        """(acq_id, caption) of the last alignment that moved each acquisition."""
        coarse = None if self.coarse is None else alignment.coarse_captions(self.coarse)
        if self.fine is None:
            return coarse
        fine = alignment.fine_captions(self.fine)
        return fine if coarse is None else fine.unionByName(coarse.join(fine, "acq_id", "left_anti"))


def _parameters(config: Config, mode: str) -> dict:
    common = {"weight_mode": config.weight_mode, "a_is_x": config.a_is_x, "max_points": config.max_points}
    match mode:
        case "gate_counter":
            return common | {"keep_own": bool(config.flier_sigma)}
        case "time_gap":
            return common | {"heal": config.heal, "gap_s": config.layer_gap_s, "tolerance_mm": config.refill_tolerance_mm}
        case "plan_viterbi":
            return common | {"heal": config.heal, "penalty": config.penalty_mm2}
    given = {} if config.auto_infer else {"min_rows": config.min_episode_rows, "dead_ratio": config.dead_ratio}
    return common | {"heal": config.heal, "method": config.auto_method} | given


def run(rows: DataFrame, plan: DataFrame | None, config: Config, has_gate: bool = True, progress: Progress = quiet, keep: Callable[[DataFrame], DataFrame] = lambda table: table) -> Result:
    """All phases over typed rows and a plan (both with acq_id). ``keep`` is done to the assigned rows, which all results come
    from: where several of them are asked for, ``landed`` assigns the rows once."""
    mode = resolved_mode(config.layer_mode, has_gate, plan is not None)
    coarse = None
    if config.coarse and plan is not None:
        progress("coarse alignment")
        coarse = alignment.coarse_align(R.with_plan_axes(rows.filter("fit_a is not null"), config.a_is_x), plan)
        rows = alignment.apply(R.with_plan_axes(rows, config.a_is_x), coarse, config.a_is_x)
    progress("assignment")
    assigned = assign.assign(rows, plan, mode, **_parameters(config, mode))
    if config.flier_sigma and plan is not None:
        progress("flier filter")
        assigned = nearest.filter_fliers(assigned, plan, config.flier_sigma, config.a_is_x)
    assigned = keep(assigned)
    if plan is None:
        measured = spots.weighted_spots(assigned)
        return Result(plan, assigned, measured, measured, measured.limit(0), measured.limit(0), mode, coarse, None)
    slots = assign.with_plan_slot(assigned, plan, mode)
    missing, delivery = spots.uncovered(plan, slots), spots.delivery_times(plan, slots)
    progress("aggregation")
    measured = assign.aggregate(assigned, plan, mode, config.auto_method) if config.aggregate else assigned
    if config.aggregate:
        measured = R.with_plan_axes(measured.withColumnRenamed("partial", "_p"), config.a_is_x).withColumn("partial", F.col("_p")).drop("_p").withColumn("row_idx", F.col("first_row"))
    fine = None
    if config.fine_shift or config.fine_rotation or config.fine_scale:
        progress("fine alignment")
        measured, fine = alignment.fine_align(measured, plan, config.fine_shift, config.fine_rotation, config.fine_scale, config.a_is_x)
    return Result(plan, assigned, measured, nearest.match_on_layer(measured, plan), missing, delivery, mode, coarse, fine)


def export(result: Result, config: Config) -> DataFrame:
    """The combined table of 19 columns (and acq_id), one row for each measured spot in order."""
    m = quality.dose_fractions(result.measured, result.plan)
    layer = F.rint("layer").cast("int")
    table = layer_table(result.plan).select("acq_id", F.col("layer").alias("layer_index"), F.col("energy").alias("nominal_energy_mev"))
    index = F.row_number().over(Window.partitionBy("acq_id").orderBy("row_idx")).cast("int")
    yes = lambda v: F.when(v, "yes").otherwise("no")
    fits = None if result.fine is None else result.fine.select("acq_id", F.lit(True).alias("_aligned"))
    m = m.withColumn("_aligned", F.lit(False)) if fits is None else m.join(fits, "acq_id", "left").fillna(False, ["_aligned"])
    out = m.withColumn("layer_index", layer).join(table, ["acq_id", "layer_index"], "left").select(
        "acq_id", index.alias("spot_index"), yes(F.lit(config.aggregate)).alias("aggregated"), "layer_index", "nominal_energy_mev", F.col("a").alias("measured_fit_a_mm"), F.col("b").alias("measured_fit_b_mm"), F.col("weight").alias("spot_weight"),
        F.col("partial").cast("int").alias("partial_code"), F.col("sigma_a").alias("sigma_a_mm"), F.col("sigma_b").alias("sigma_b_mm"), F.col("expected_x").alias("expected_plan_x_mm"), F.col("expected_y").alias("expected_plan_y_mm"),
        F.col("expected_energy").alias("expected_plan_energy_mev"), F.col("expected_mu").alias("expected_plan_mu"), R.finite(F.col("distance")).alias("plan_xy_distance_mm"), (F.col("plan_fraction") * 100).alias("plan_dose_fraction_pct"),
        (F.col("measured_fraction") * 100).alias("meas_dose_fraction_pct"), F.col("deviation_pp").alias("dose_deviation_pp"), yes(F.col("_aligned")).alias("positions_aligned_to_plan"),
    )
    return out.select("acq_id", *K.EXPORT_COLUMNS)


def run_files(spark: SparkSession, acquisition_path: str, plan_path: str, config: Config, progress: Progress = quiet) -> Result:
    """One acquisition file against one plan file."""
    progress("loading")
    text = acquisition.read_text(spark, acquisition_path)
    acquisition.check_columns(text.columns, config.weight_mode, config.layer_mode == "auto")
    stem = acquisition.acquisition_stem(acquisition_path)
    plan = plans.read_plan(spark, plan_path).withColumn("acq_id", F.lit(stem))
    result = run(acquisition.typed(text, stem), plan, config, acquisition.has_gate_counter(text.columns), progress)
    if not result.assigned.head(1):
        raise ValueError("the flier filter leaves no row" if config.flier_sigma else "no row of the acquisition is assigned")
    return result
