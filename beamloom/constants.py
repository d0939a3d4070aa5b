"""Values that results depend on."""

# Column names of acquisition files.
TIME = "time (s)"
CHANNEL_SUM = "IX512 Channel Sum (nA)"
FIT_AMPLITUDE_A = "Fit Amplitude A (nA)"
FIT_AMPLITUDE_B = "Fit Amplitude B (nA)"
POSITION_A = "Fit Mean Position A (mm)"
POSITION_B = "Fit Mean Position B (mm)"
SIGMA_A = "Fit Standard Deviation A (mm)"
SIGMA_B = "Fit Standard Deviation B (mm)"
GATE_COUNTER = "Gate Counter"

# Columns of the combined export, in order.
EXPORT_COLUMNS = (
    "spot_index",
    "aggregated",
    "layer_index",
    "nominal_energy_mev",
    "measured_fit_a_mm",
    "measured_fit_b_mm",
    "spot_weight",
    "partial_code",
    "sigma_a_mm",
    "sigma_b_mm",
    "expected_plan_x_mm",
    "expected_plan_y_mm",
    "expected_plan_energy_mev",
    "expected_plan_mu",
    "plan_xy_distance_mm",
    "plan_dose_fraction_pct",
    "meas_dose_fraction_pct",
    "dose_deviation_pp",
    "positions_aligned_to_plan",
)

# Assignment.
ENERGY_TOLERANCE_MEV = 1e-4
LAYER_GAP_S = 0.2
REFILL_TOLERANCE_MM = 3.0
REFILL_EXTRA_MM = 5.0
REFILL_RATIO = 1.4
REFILL_TRUST_MM = 35.0
ADVANCE_PENALTY_MM2 = 400.0
ROLLING_WINDOW = 15
DEAD_RATIO = 0.60
DEAD_RATIO_MIN = 0.48
DEAD_RATIO_MAX = 0.85
DEAD_RATIO_STEPS = 49
ON_FRACTION = 0.45
TINY_MERGE_ROWS = 2
MAX_SPLITS = 2048
REFINE_MAX_SPANS = 32_000
REFINE_ROWS = 32
REFINE_PASSES = 4
PLAN_BLEND = 0.65
MERGE_DT_MM2_PER_S2 = 50.0
SEQUENTIAL_WINDOW = 5
SEQUENTIAL_MARGIN_MM2 = 4.0
CLUSTER_RADIUS_MM = 10.0
CLUSTER_SCALE = 1.6
SPOT_JUMP_MM = 3.0
MIN_WEIGHT_NA = 1e-9

# Alignment.
FIT_SAMPLES = 3_000
ICP_ITERATIONS = 25
ICP_TOLERANCE_MM = 0.05
PRESCREEN_DEGREES = (0, 90, 180, 270)
FINALIST_KEEP_MM = 1.5
FINALISTS = 4
RMS_STOP_MM = 0.05
FINE_ICP_ITERATIONS = 5
FINE_ICP_TOLERANCE_MM = 0.005
FINE_NEWTON_ITERATIONS = 50
FINE_NEWTON_TOLERANCE_MM = 0.01
FINE_SCALE_MIN = 0.9
FINE_SCALE_MAX = 1.1

# Quality thresholds and filters.
FLIER_SIGMA = 3.0
SIGMA_FALLBACK_MM = 0.35
PASS_MM, WARN_MM = 1.0, 3.0
PASS_PP, WARN_PP = 1.0, 3.0

# Display.
GLYPH_CAP = 24_000
POINT_TARGET = 1_250_000
FWHM_DEFAULT_MM = 4.0
SIGMA_SCALE = 0.5
SIGMA_MIN_MM = 0.02
SIGMA_MAX_MM = 50.0
CROSS_ARM_MM = 1.0
GLYPH_SPAN_FRACTION = 0.004
GRID_TICK_MM = 10.0
LABEL_PAD_MM = 4.0
AXIS_LABELS_MAX = 11
AXIS_TICK_MM = 5.0
COLOURS = {
    "pass": "#22c55e",
    "warn": "#eab308",
    "fail": "#ef4444",
    "under_warn": "#38bdf8",
    "under_fail": "#a855f7",
    "plan": "#1f77b4",
    "measured": "#d62728",
    "partial": "#daa520",
}

# Range of protons in water (mm) at 10, 15, ... 350 MeV.
RANGE_MM = (
    1.23, 2.54, 4.26, 6.37, 8.85, 11.70, 14.89, 18.41, 22.27, 26.44, 30.93, 35.72, 40.80, 46.18, 51.84, 57.77, 63.98, 70.45, 77.18, 84.16,
    91.40, 98.88, 106.60, 114.60, 122.80, 131.20, 139.80, 148.70, 157.70, 167.00, 176.50, 186.20, 196.10, 206.20, 216.50, 227.00, 237.70, 248.50, 259.60, 270.80,
    282.20, 293.80, 305.50, 317.40, 329.50, 341.70, 354.10, 366.70, 379.40, 392.20, 405.30, 418.40, 431.70, 445.20, 458.80, 472.50, 486.40, 500.40, 514.50, 528.80,
    543.20, 557.70, 572.40, 587.10, 602.00, 617.00, 632.20, 647.40, 662.80,
)
RANGE_FIRST_MEV, RANGE_STEP_MEV = 10.0, 5.0
R90_SCALE, R90_OFFSET_MM = 0.975, 0.56
R80_SCALE, R80_OFFSET_MM = 0.910, 1.14
