"""Registration of detector positions to the plan: rigid and similarity fits, coarse search, fine search.

Each acquisition has its own fit: a row of a table of transforms (acq_id, the affine map ``AFFINE``, and what the map is
made of), which is joined back by acq_id. Acquisitions' rows never meet in a group.

The coarse search tries many starts on a sample of bounded size. An orientation of an acquisition is a row of a table, with
the rotations to start from as a list, so all of them run at the same time. Which orientation is best is decided by all rows, matched to the whole plan in
pieces of bounded size and averaged. The fine search matches all rows to their layers, sums up thirteen moments of the pairs for each
acquisition, and solves the fit from these; a round is one aggregation. What rounds share is written once: the rows that
are fitted, and the small table of the acquisitions' state. So both searches run when they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R
from ..session import ship
from ..sources.workspace import landed
from .grid import Spots
from .nearest import match_on_layer, own_spot
from .quality import weighted_rms

TOGETHER = 4  # starts that are fitted side by side
PIECE = 20_000  # rows of an acquisition that are matched to its plan at a time
AFFINE = ("m11", "m12", "m21", "m22", "t1", "t2")
_NUMBERS = ", ".join(f"{c} double" for c in AFFINE)
_COARSE = f"acq_id {{kind}}, {_NUMBERS}, theta_deg double, tx double, ty double, swap boolean, flip_x boolean, flip_y boolean, rms double, rms_pairs double, n_pairs bigint, n_fit bigint, iterations int"
_FINE = f"acq_id {{kind}}, {_NUMBERS}, theta_deg double, tx double, ty double, sx double, sy double, rms_before double, rms_after double, n_pairs bigint"


@dataclass(frozen=True)
class Rigid:
    """Flips and swap first, then rotation by theta degrees, then shift."""

    theta_deg: float = 0.0
    tx: float = 0.0
    ty: float = 0.0
    swap: bool = False
    flip_x: bool = False
    flip_y: bool = False

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        x, y = (y, x) if self.swap else (x, y)
        x, y = (-x if self.flip_x else x), (-y if self.flip_y else y)
        c, s = math.cos(math.radians(self.theta_deg)), math.sin(math.radians(self.theta_deg))
        return x * c - y * s + self.tx, x * s + y * c + self.ty

    def matrix(self) -> np.ndarray:
        """The same as a matrix of two rows, the shift in the last column."""
        c, s = math.cos(math.radians(self.theta_deg)), math.sin(math.radians(self.theta_deg))
        turn = np.array([[0.0, 1.0], [1.0, 0.0]]) if self.swap else np.eye(2)
        m = np.array([[c, -s], [s, c]]) @ np.diag([-1.0 if self.flip_x else 1.0, -1.0 if self.flip_y else 1.0]) @ turn
        return np.column_stack([m, [self.tx, self.ty]])

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        c, s = math.cos(math.radians(self.theta_deg)), math.sin(math.radians(self.theta_deg))
        x, y = (x - self.tx) * c + (y - self.ty) * s, (y - self.ty) * c - (x - self.tx) * s
        x, y = (-x if self.flip_x else x), (-y if self.flip_y else y)
        return (y, x) if self.swap else (x, y)


@dataclass(frozen=True)
class Similarity:
    """Scales first, then rotation by theta degrees, then shift."""

    theta_deg: float = 0.0
    tx: float = 0.0
    ty: float = 0.0
    sx: float = 1.0
    sy: float = 1.0

    def columns(self, x: Column, y: Column) -> tuple[Column, Column]:
        c, s = math.cos(math.radians(self.theta_deg)), math.sin(math.radians(self.theta_deg))
        return x * self.sx * c - y * self.sy * s + self.tx, x * self.sx * s + y * self.sy * c + self.ty

    def matrix(self) -> np.ndarray:
        c, s = math.cos(math.radians(self.theta_deg)), math.sin(math.radians(self.theta_deg))
        return np.array([[c * self.sx, -s * self.sy, self.tx], [s * self.sx, c * self.sy, self.ty]])


def after(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The matrix of one map after another."""
    return np.column_stack([second[:, :2] @ first[:, :2], second[:, :2] @ first[:, 2] + second[:, 2]])


def apply(rows: DataFrame, transform: Rigid | Similarity | DataFrame | None, a_is_x: bool = False) -> DataFrame:
    """Rows with transformed positions; rows without both coordinates stay as they are.

    A table of transforms moves each acquisition by its own; acquisitions without one stay as they are.
    """
    if transform is None:
        return rows
    have, columns = F.col("mx").isNotNull() & F.col("my").isNotNull(), rows.columns
    if isinstance(transform, DataFrame):
        rows = rows.join(transform.select("acq_id", F.struct(*AFFINE).alias("_map")), "acq_id", "left")
        have = have & F.col("_map").isNotNull()
        x, y = (F.col("_map")[a] * F.col("mx") + F.col("_map")[b] * F.col("my") + F.col("_map")[c] for a, b, c in (("m11", "m12", "t1"), ("m21", "m22", "t2")))
    else:
        x, y = transform.columns(F.col("mx"), F.col("my"))
    out = rows.withColumns({"mx": F.when(have, x).otherwise(F.col("mx")), "my": F.when(have, y).otherwise(F.col("my"))})
    return R.with_detector_axes(out.select(*columns, *(c for c in ("a", "b") if c not in columns and c in out.columns)), a_is_x)


def rigid_sums(pairs: DataFrame) -> DataFrame:
    """Least-squares rigid fit of each acquisition's pairs (mx, my) to (px, py), from one aggregation: theta, tx, ty, rms.

    The best rotation is the angle of (dot products, cross products) of the centred pairs, which are covariances. One pair
    gives a shift only.
    """
    cov, n = F.covar_pop, F.col("n")
    s = pairs.groupBy("acq_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("mx", "my", "px", "py")],
        (cov("mx", "px") + cov("my", "py")).alias("dot"), (cov("mx", "py") - cov("my", "px")).alias("cross"),
        (F.var_pop("mx") + F.var_pop("my") + F.var_pop("px") + F.var_pop("py")).alias("sq"),
    )
    s = s.withColumn("theta", F.when(n > 1, F.atan2("cross", "dot")).otherwise(0.0))
    tx = F.col("px") - (F.cos("theta") * F.col("mx") - F.sin("theta") * F.col("my"))
    ty = F.col("py") - (F.sin("theta") * F.col("mx") + F.cos("theta") * F.col("my"))
    rest = F.col("sq") - 2 * F.sqrt(F.col("dot") * F.col("dot") + F.col("cross") * F.col("cross"))
    return s.select("acq_id", "n", F.degrees("theta").alias("theta_deg"), tx.alias("tx"), ty.alias("ty"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("rms"))


def _rigid_columns(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The same for four arrays: rotation, shift, rms. Sums are over plain arrays, which are fast."""
    n = len(x)
    if n < 1:
        raise ValueError("no pairs")
    cx, cy, cp, cq = (float(v.sum()) / n for v in (x, y, px, py))
    ax, ay, bx, by = x - cx, y - cy, px - cp, py - cq
    theta = math.atan2(float((ax * by - ay * bx).sum()), float((ax * bx + ay * by).sum())) if n > 1 else 0.0
    c, s = math.cos(theta), math.sin(theta)
    dx, dy = ax * c - ay * s - bx, ax * s + ay * c - by
    return np.array([[c, -s], [s, c]]), np.array([cp - (c * cx - s * cy), cq - (s * cx + c * cy)]), math.sqrt(float((dx * dx + dy * dy).sum()) / n)


def rigid_fit(m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The same for arrays of positions: rotation, shift, rms."""
    return _rigid_columns(m[:, 0], m[:, 1], p[:, 0], p[:, 1])


def nearest(m: np.ndarray, plan: np.ndarray | Spots) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest plan point of each position (the first of equal ones)."""
    at, d2 = (plan if isinstance(plan, Spots) else Spots(plan)).nearest(m)
    return at, np.sqrt(d2)


def stride(n: int, most: int) -> int:
    return max(1, -(-n // max(1, most)))


def strided(rows: DataFrame, most: int) -> DataFrame:
    """Every n-th row of each acquisition, so that at most ``most`` are left."""
    by = Window.partitionBy("acq_id")
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy("row_idx")) - 1
    step = F.greatest(F.lit(1), F.ceil(n / F.lit(max(1, most))))
    return rows.withColumns({"_i": i, "_s": step}).filter(F.col("_i") % F.col("_s") == 0).drop("_i", "_s")


#: Degrees between the rotations to start from, for more samples than that.
_SEED_STEPS = {100_000: 90, 50_000: 45, 10_000: 30, 0: 15}


def seed_degrees(n: int) -> tuple[int, ...]:
    """Rotations to start from; fewer for more samples."""
    return tuple(range(0, 360, next(step for more, step in _SEED_STEPS.items() if n > more)))


def _seed_step(n: Column) -> Column:
    return F.coalesce(*[F.when(n > more, step) for more, step in _SEED_STEPS.items()])


def icp(m: np.ndarray, plan: np.ndarray | Spots, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Nearest points and rigid fit in turn: rotation, shift, rms before the last fit, rms, iterations."""
    return icp_starts(m, plan, [(r, t)])[0]


def icp_starts(m: np.ndarray, plan: np.ndarray | Spots, starts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float, float, int]]:
    """The same from several starts, each a fit of its own: only their nearest points are looked up together."""
    index = plan if isinstance(plan, Spots) else Spots(plan)
    (x, y), (px, py) = (np.ascontiguousarray(v.T) for v in (m, index.whole))
    fits, before, live = [(r, t, math.nan, math.inf, 0) for r, t in starts], [math.inf] * len(starts), list(range(len(starts)))
    for k in range(1, K.ICP_ITERATIONS + 1):
        now = np.empty((2, len(live), len(m)))
        for i, of in enumerate(live):
            r, t, *_ = fits[of]
            now[0, i], now[1, i] = x * r[0, 0] + y * r[0, 1] + t[0], x * r[1, 0] + y * r[1, 1] + t[1]
        at, d2 = (v.reshape(len(live), -1) for v in index.nearest(now.reshape(2, -1).T))
        for i, of in enumerate(live):
            r, t, *_ = fits[of]
            r1, t1, rms = _rigid_columns(now[0, i], now[1, i], px[at[i]], py[at[i]])
            fits[of] = r1 @ r, r1 @ t + t1, float(np.sqrt(d2[i].mean())), rms, k
        done = [abs(before[of] - fits[of][3]) < K.ICP_TOLERANCE_MM for of in live]
        for of in live:
            before[of] = fits[of][3]
        live = [of for of, end in zip(live, done, strict=True) if not end]
        if not live:
            break
    return fits


def _start(m: np.ndarray, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    a = math.radians(degrees)
    r = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    c = m.mean(axis=0)
    return r, c - r @ c


ORIENTATIONS = tuple((swap, fx, fy) for swap in (False, True) for fx in (False, True) for fy in (False, True))
_START = f"acq_id {{kind}}, orientation int, place int, {_NUMBERS}, theta_deg double, tx double, ty double, rms_pairs double, rms_fit double, iterations int"


def _points(at) -> np.ndarray:
    """Positions of one value of the table: arrays of x and of y."""
    return np.column_stack([at["x"], at["y"]]).astype(float)


def _tried(starts: DataFrame, tasks: int, keys: tuple[str, ...]) -> DataFrame:
    """The fits of all starts of a row (acq_id, orientation, degrees and their places as lists, sample, plan), each row a group of
    its own, dealt to tasks by ``keys``. Starts behind a nearly perfect one can't win (``_best_starts``) and are left out. Of rows
    with one plan that follow each other in a task, the plan's grid is made once."""
    ship(starts.sparkSession)
    schema = _START.format(kind=dict(starts.dtypes)["acq_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    made: dict[bytes, Spots] = {}  # one at a time, of a task

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in p.itertuples():
            swap, fx, fy = ORIENTATIONS[s.orientation]
            m, points = _points(s.sample), _points(s.plan)
            if (key := points.tobytes()) not in made:
                made.clear()
                made[key] = Spots(points)
            plan = made[key]
            m = (m[:, ::-1] if swap else m) * [-1.0 if fx else 1.0, -1.0 if fy else 1.0]
            seeds = list(zip(s.places, s.degrees, strict=True))
            for few in (seeds[k : k + TOGETHER] for k in range(0, len(seeds), TOGETHER)):
                good = False
                for (place, _), (r, t, pairs, rms, k) in zip(few, icp_starts(m, plan, [_start(m, degrees) for _, degrees in few]), strict=True):
                    g = Rigid(math.degrees(math.atan2(r[1, 0], r[0, 0])), float(t[0]), float(t[1]), swap, fx, fy)
                    out.append([s.acq_id, s.orientation, place, *_flat(g), g.theta_deg, g.tx, g.ty, pairs, rms, k])
                    if good := rms <= K.RMS_STOP_MM:
                        break
                if good:
                    break
        return pd.DataFrame(out, columns=names)

    # the table is small and its fits are long, so that its size doesn't tell into how many tasks it should go
    return starts.repartition(tasks, *keys).groupBy("acq_id", "orientation").applyInPandas(fit, schema)


def _best_starts(fits: DataFrame) -> DataFrame:
    """Of each orientation, the first start that is nearly perfect, or else the one with the least residual."""
    good = F.col("rms_fit") <= K.RMS_STOP_MM
    rank = F.struct(F.when(good, 0).otherwise(1), F.when(good, 0.0).otherwise(F.col("rms_fit")), F.col("place"))
    finite = fits.filter(~F.isnan("rms_fit") & (F.abs("rms_fit") != float("inf")))
    best = finite.groupBy("acq_id", "orientation").agg(F.min_by(F.struct(*[c for c in fits.columns if c not in ("acq_id", "orientation", "place")]), rank).alias("fit"))
    return best.select("acq_id", "orientation", "fit.*")


def _with_rest(fits: DataFrame, live: DataFrame, plans: DataFrame) -> DataFrame:
    """Adds rms: the residual of each fit over all rows. Pieces of ``PIECE`` rows are matched apart and their sums added up."""
    of = fits.groupBy("acq_id").agg(F.collect_list(F.struct("orientation", *AFFINE)).alias("fits")).join(plans, "acq_id")
    cut = live.withColumn("piece", F.floor(F.col("row_idx") / PIECE))
    beside = cut.select("acq_id", "piece").distinct().join(of, "acq_id").select(F.col("acq_id").alias("of"), F.col("piece").alias("of_piece"), "fits", "plan")

    def rest(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame(columns=["acq_id", "orientation", "d2", "n"])
        xy, spots = p[["mx", "my"]].to_numpy(float), Spots(_points(q["plan"].iloc[0]))
        maps = [(f["orientation"], np.array([[f[c] for c in AFFINE[:2]], [f[c] for c in AFFINE[2:4]]]), [f["t1"], f["t2"]]) for f in q["fits"].iloc[0]]
        return pd.DataFrame([[p["acq_id"].iloc[0], o, float(spots.nearest(xy @ m.T + t)[1].sum()), len(p)] for o, m, t in maps], columns=["acq_id", "orientation", "d2", "n"])

    sums = cut.groupBy("acq_id", "piece").cogroup(beside.groupBy("of", "of_piece")).applyInPandas(rest, f"acq_id {dict(live.dtypes)['acq_id']}, orientation int, d2 double, n bigint")
    return fits.join(sums.groupBy("acq_id", "orientation").agg(F.sqrt(F.sum("d2") / F.sum("n")).alias("rms")), ["acq_id", "orientation"])


def coarse_align(rows: DataFrame, plan: DataFrame, most: int = K.FIT_SAMPLES) -> DataFrame:
    """Table of coarse fits, one for each acquisition with measured and planned positions.

    Eight orientations are tried with four rotations; the best few by the residual over all positions are fitted with all
    rotations; the one with the least residual over all positions wins (the first of equal ones). Fits run on every n-th
    position, ``most`` at most.
    """
    live = landed(rows.filter("mx is not null and my is not null").select("acq_id", "row_idx", "mx", "my"))
    point = lambda i, x, y: F.struct(i, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    axes = lambda c: F.struct(F.transform(c, lambda v: v["x"]).alias("x"), F.transform(c, lambda v: v["y"]).alias("y")).alias(c)  # noqa: E731  plain numbers are cheap to pass to Python
    sample = strided(live, most).groupBy("acq_id").agg(F.sort_array(F.collect_list(point("row_idx", "mx", "my"))).alias("sample"), F.count(F.lit(1)).alias("n_fit"))
    planned = plan.groupBy("acq_id").agg(F.sort_array(F.collect_list(point("spot_idx", "x", "y"))).alias("plan"))
    sizes = live.groupBy("acq_id").agg(F.count(F.lit(1)).alias("n_pairs"))
    base = landed(sample.select("acq_id", axes("sample"), "n_fit").join(planned.select("acq_id", axes("plan")), "acq_id").join(sizes, "acq_id"))
    plans = base.select("acq_id", "plan")
    n = max(1, base.count())
    tasks = min(8 * n, max(64, n // 4))
    keys = ("acq_id",) if n >= 2 * tasks else ("acq_id", "orientation")  # few acquisitions are spread by both

    every = base.withColumn("orientation", F.explode(F.array(*[F.lit(k) for k in range(len(ORIENTATIONS))])))
    few = {"degrees": K.PRESCREEN_DEGREES, "places": range(len(K.PRESCREEN_DEGREES))}
    starts = landed(_tried(every.withColumns({name: F.array(*[F.lit(v) for v in values]) for name, values in few.items()}), tasks, keys))
    tried = landed(_best_starts(starts))
    found = landed(_with_rest(tried, live, plans))
    order = Window.partitionBy("acq_id").orderBy("rms", "orientation")
    ranked = found.withColumns({"_k": F.row_number().over(order), "_low": F.min("rms").over(Window.partitionBy("acq_id"))})
    chosen = ranked.filter((F.col("_k") <= 2) | ((F.col("rms") <= F.col("_low") + K.FINALIST_KEEP_MM) & (F.col("_k") <= K.FINALISTS))).select("acq_id", "orientation")
    step = F.col("_step")
    all_seeds = every.join(chosen, ["acq_id", "orientation"]).withColumn("_step", _seed_step(F.col("n_fit"))).filter(step < 90)
    done = F.array(*[F.lit(d) for d in K.PRESCREEN_DEGREES])
    seeds = all_seeds.withColumn("degrees", F.array_except(F.sequence(F.lit(0), 360 - step, step), done)).withColumn("places", F.transform("degrees", lambda d: (d / step).cast("int")))
    at = F.element_at(done, F.col("place") + 1) / step  # the place among all seeds of those that were fitted before
    before = starts.join(all_seeds.select("acq_id", "orientation", "_step"), ["acq_id", "orientation"]).withColumn("place", at.cast("int")).drop("_step")
    again = _best_starts(_tried(seeds.drop("_step"), tasks, keys).unionByName(before))
    again = landed(again.join(found.select("acq_id", "orientation", F.col("rms_fit").alias("_was")), ["acq_id", "orientation"]).filter("rms_fit < _was").drop("_was"))
    better = landed(_with_rest(again, live, plans))
    both = found.join(better.select("acq_id", "orientation"), ["acq_id", "orientation"], "left_anti").unionByName(better)
    won = both.groupBy("acq_id").agg(F.min_by(F.struct(*[c for c in both.columns if c != "acq_id"]), F.struct("rms", "orientation")).alias("f")).select("acq_id", "f.*")
    turn = lambda i: F.get(F.array(*[F.lit(o[i]) for o in ORIENTATIONS]), F.col("orientation"))
    return won.join(base.select("acq_id", "n_pairs", "n_fit"), "acq_id").select(
        "acq_id", *AFFINE, "theta_deg", "tx", "ty", turn(0).alias("swap"), turn(1).alias("flip_x"), turn(2).alias("flip_y"), "rms", "rms_pairs", "n_pairs", "n_fit", "iterations"
    )


def _flat(fit) -> list[float]:
    m = fit if isinstance(fit, np.ndarray) else fit.matrix()
    return [*m[:, :2].ravel().tolist(), *m[:, 2].tolist()]


_PRODUCTS = {"w": "1", "x": "mx", "y": "my", "xx": "mx * mx", "xy": "mx * my", "yy": "my * my", "p": "px", "q": "py", "xp": "mx * px", "yp": "my * px", "xq": "mx * py", "yq": "my * py", "pp": "px * px + py * py"}
MOMENTS = tuple(f"s_{name}" for name in _PRODUCTS)


def moment_sums() -> list[Column]:
    """Aggregates of pairs (mx, my) and (px, py) with weights w: all that a weighted similarity fit needs of them."""
    return [F.sum(F.col("w") * F.expr(product)).alias(f"s_{name}") for name, product in _PRODUCTS.items()]


@dataclass(frozen=True)
class Moments:
    """Sums of the products of measured (x, y, 1) with themselves and with the planned x and y."""

    measured: np.ndarray
    planned: np.ndarray
    squares: float

    @staticmethod
    def of(row: pd.Series) -> Moments:
        g = {name: float(row[f"s_{name}"]) for name in _PRODUCTS}
        return Moments(np.array([[g["xx"], g["xy"], g["x"]], [g["xy"], g["yy"], g["y"]], [g["x"], g["y"], g["w"]]]), np.array([[g["xp"], g["xq"]], [g["yp"], g["yq"]], [g["p"], g["q"]]]), g["pp"])

    def against(self, m: np.ndarray) -> Moments:
        """Those of the same measured positions and where the map m brings them."""
        planned = self.measured @ m.T
        return Moments(self.measured, planned, float((m * planned.T).sum()))

    def rms(self, m: np.ndarray) -> float:
        rest = self.squares - 2 * float((m * self.planned.T).sum()) + float((m * (m @ self.measured)).sum())
        return math.sqrt(max(rest, 0.0) / self.measured[2, 2])


def fit_similarity(g: Moments, n: int, shift: bool = True, rotate: bool = True, scale: bool = True) -> Similarity:
    """Weighted least-squares similarity of n pairs by Gauss-Newton steps on their moments, with scales held within bounds.

    Every derivative of the map is itself a map of (x, y, 1), so the normal equations of a step are products of such maps
    with the moments. One pair gives a shift only.
    """
    rotate, scale = rotate and n > 1, scale and n > 1
    start = (g.planned[2] - g.measured[2, :2]) / g.measured[2, 2] if shift else np.zeros(2)
    fit, before = Similarity(tx=float(start[0]), ty=float(start[1])), math.inf
    for _ in range(K.FINE_NEWTON_ITERATIONS if shift or rotate or scale else 0):
        c, s = math.cos(math.radians(fit.theta_deg)), math.sin(math.radians(fit.theta_deg))
        moves = {
            "theta_deg": rotate and np.array([[-s * fit.sx, -c * fit.sy, 0], [c * fit.sx, -s * fit.sy, 0]]) * math.pi / 180, "tx": shift and np.array([[0, 0, 1.0], [0, 0, 0]]), "ty": shift and np.array([[0, 0, 0], [0, 0, 1.0]]),
            "sx": scale and np.array([[c, 0, 0], [s, 0, 0]]), "sy": scale and np.array([[0, -s, 0], [0, c, 0]]),
        }
        moves = {name: d for name, d in moves.items() if d is not False}
        d = np.array(list(moves.values()))
        left = np.einsum("iab,bc,jac->ij", d, g.measured, d)
        step, _, rank, _ = np.linalg.lstsq(left, np.einsum("iab,ba->i", d, g.planned - g.measured @ fit.matrix().T), rcond=1e-13)
        if rank < 1 or not np.isfinite(step).all():
            break
        new = {name: getattr(fit, name) + float(v) for name, v in zip(moves, step, strict=True)}
        fit = replace(fit, **{name: min(max(v, K.FINE_SCALE_MIN), K.FINE_SCALE_MAX) if name in ("sx", "sy") else v for name, v in new.items()})
        now = g.rms(fit.matrix())
        if abs(before - now) < K.FINE_NEWTON_TOLERANCE_MM:
            break
        before = now
    return fit


_STATE = f"acq_id {{kind}}, {_NUMBERS}, rms_before double, last double, now double, n_pairs bigint, active boolean"


def _matched_sums(light: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, moments, rms, n): rows and their layers' nearest spots, all of them in one aggregation."""
    m = own_spot(light, plan).withColumns({"px": F.col("own.x"), "py": F.col("own.y")}).drop("own")
    pairs = m.filter("mx is not null and my is not null and px is not null")
    squared = (F.col("px") - F.col("mx")) * (F.col("px") - F.col("mx")) + (F.col("py") - F.col("my")) * (F.col("py") - F.col("my"))
    return pairs.groupBy("acq_id").agg(*moment_sums(), weighted_rms(F.sqrt(squared), F.col("w")).alias("rms"), F.count(F.lit(1)).alias("n"))


def fine_fits(rows: DataFrame, plan: DataFrame, shift: bool = True, rotate: bool = True, scale: bool = True) -> DataFrame:
    """Table of fine fits, one for each acquisition that its fit brings closer to its plan. Rows are read in every round.

    A round fits all pairs of rows and their layers' nearest spots, moves the rows by that, and pairs them anew. An
    acquisition takes part until a round brings it no closer. Its map is those of its rounds one after another; the one
    similarity closest to that map over all its rows is noted beside it.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["acq_id"]
    light = rows.select("acq_id", "row_idx", "mx", "my", F.col("layer").cast("double").alias("layer"), R.align_weight(F.col("weight")).alias("w"))
    planned = landed(plan.select("acq_id", "spot_idx", "x", "y", "energy", "mu"))
    state_names = [c.split()[0] for c in _STATE.split(", ")]

    def advance(p: pd.DataFrame) -> pd.DataFrame:
        """Fits of a round for the acquisitions whose rows were paired."""
        for i, row in p[p["active"]].iterrows():
            step = fit_similarity(Moments.of(row), int(row["n"]), shift, rotate, scale).matrix()
            total = after(np.array(row[list(AFFINE)], float)[[0, 1, 4, 2, 3, 5]].reshape(2, 3), step)
            p.loc[i, list(AFFINE)] = _flat(total)
            p.loc[i, "n_pairs"] = int(row["n"])
        return p[state_names]

    still = _flat(Similarity())
    sums = landed(_matched_sums(light, planned))
    state = sums.filter("rms is not null").select("acq_id", *[F.lit(v).alias(c) for c, v in zip(AFFINE, still, strict=True)], *[F.col("rms").alias(c) for c in ("rms_before", "last", "now")], F.lit(0).cast("bigint").alias("n_pairs"), F.lit(True).alias("active"))
    first = sums
    for k in range(K.FINE_ICP_ITERATIONS):
        met = state.join(sums, "acq_id").select(*state.columns, *MOMENTS, "n")
        fitted = landed(met.groupBy("acq_id").applyInPandas(advance, _STATE.format(kind=kind)).unionByName(state.join(sums, "acq_id", "left_anti").withColumn("active", F.lit(False))))
        going = fitted.filter("active")
        sums = landed(_matched_sums(apply(light.join(going.select("acq_id"), "acq_id", "left_semi"), going), planned))
        fresh = fitted.join(sums.select("acq_id", "rms"), "acq_id", "left")
        better = F.col("rms").isNotNull() & (F.lit(k == 0) | (F.col("last") - F.col("rms") >= K.FINE_ICP_TOLERANCE_MM))
        state = landed(fresh.withColumn("now", F.when(F.col("active"), F.col("rms")).otherwise(F.col("now"))).withColumn("active", F.col("active") & better).withColumn("last", F.when(F.col("active"), F.col("now")).otherwise(F.col("last"))).drop("rms"))
        sums = sums.join(state.filter("active").select("acq_id"), "acq_id", "left_semi")
        if state.filter("active").isEmpty():
            break

    schema = _FINE.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]

    def net(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in p.iterrows():
            m = np.array(row[list(AFFINE)], float)[[0, 1, 4, 2, 3, 5]].reshape(2, 3)
            g = fit_similarity(Moments.of(row).against(m), int(row["n"]), shift, rotate, scale)
            out.append([row["acq_id"], *_flat(m), g.theta_deg, g.tx, g.ty, g.sx, g.sy, row["rms_before"], row["now"], row["n_pairs"]])
        return pd.DataFrame(out, columns=names)

    closer = state.filter("now < rms_before - 1e-6").join(first.select("acq_id", *MOMENTS, "n"), "acq_id")
    return closer.groupBy("acq_id").applyInPandas(net, schema)


def fine_align(rows: DataFrame, plan: DataFrame, shift: bool = True, rotate: bool = True, scale: bool = True, a_is_x: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows moved by their acquisition's fine fit, and the table of fits. Where no fit helps, rows are as they were. They are
    written once, for the fits' rounds and for the rows that are moved."""
    if not (shift or rotate or scale):
        return rows, None
    rows = landed(rows)
    fits = landed(fine_fits(rows, plan, shift, rotate, scale))
    return apply(rows, fits, a_is_x), fits


def residual(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(acq_id, rms): weighted root mean square distance to the layers' nearest spots."""
    return match_on_layer(rows, plan).groupBy("acq_id").agg(weighted_rms(F.col("distance"), R.align_weight(F.col("weight"))).alias("rms"))


def _side() -> Column:
    parts = [F.when(F.col(c), name) for c, name in (("swap", "A/B swapped"), ("flip_x", "X mirrored"), ("flip_y", "Y mirrored"))]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", "").otherwise(F.concat(F.lit(" ("), joined, F.lit(")")))


def coarse_captions(fits: DataFrame) -> DataFrame:
    """(acq_id, caption) of coarse fits."""
    text = F.format_string("Coarse align: %.2f deg, (%.2f, %.2f) mm, RMS %.2f mm, n = %d", "theta_deg", "tx", "ty", "rms", "n_pairs")
    return fits.select("acq_id", F.concat(text, _side()).alias("caption"))


def fine_captions(fits: DataFrame) -> DataFrame:
    """(acq_id, caption) of fine fits."""
    text = F.format_string("Fine align: %.2f deg, (%.2f, %.2f) mm, scale %.4f x %.4f, RMS %.2f -> %.2f mm, n = %d", "theta_deg", "tx", "ty", "sx", "sy", "rms_before", "rms_after", "n_pairs")
    return fits.select("acq_id", text.alias("caption"))


def total_captions(before: DataFrame, moved_rows: DataFrame, coarse: DataFrame | None, fine: DataFrame | None) -> DataFrame | None:
    """(acq_id, caption): the whole move of each acquisition from measured to final positions, as one similarity after the
    coarse fit's orientation."""
    if coarse is None:
        return None if fine is None else fine_captions(fine)
    ship(before.sparkSession)
    ends = before.select("acq_id", "row_idx", F.col("mx").alias("x0"), F.col("my").alias("y0")).join(moved_rows.select("acq_id", "row_idx", F.col("mx").alias("px"), F.col("my").alias("py")), ["acq_id", "row_idx"]).dropna()
    ends = ends.join(coarse.select("acq_id", "swap", "flip_x", "flip_y"), "acq_id")
    x, y = F.when(F.col("swap"), F.col("y0")).otherwise(F.col("x0")), F.when(F.col("swap"), F.col("x0")).otherwise(F.col("y0"))
    turned = ends.select("acq_id", F.when(F.col("flip_x"), -x).otherwise(x).alias("mx"), F.when(F.col("flip_y"), -y).otherwise(y).alias("my"), "px", "py", F.lit(1.0).alias("w"))
    sums = turned.groupBy("acq_id").agg(*moment_sums(), F.count(F.lit(1)).alias("n"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        fits = [(row["acq_id"], fit_similarity(Moments.of(row), int(row["n"]))) for _, row in p.iterrows()]
        return pd.DataFrame([[a, g.theta_deg, g.tx, g.ty, g.sx, g.sy] for a, g in fits], columns=["acq_id", "theta", "x", "y", "sx", "sy"])

    net = sums.groupBy("acq_id").applyInPandas(fit, f"acq_id {dict(before.dtypes)['acq_id']}, theta double, x double, y double, sx double, sy double")
    text = F.format_string("Total align: %.2f deg, (%.2f, %.2f) mm, scale %.4f x %.4f", "theta", "x", "y", "sx", "sy")
    return coarse.join(net, "acq_id").select("acq_id", F.concat(text, _side()).alias("caption"))
