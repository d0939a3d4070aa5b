"""Live position quality on Structured Streaming.

Batch has no streams; these are the batch rules for rows that arrive while a plan is delivered. Plans are static and
joined by acquisition, layer and cell, so each row is matched without state. Pauses need the row before: rows wait in the
state until the watermark has passed them, so that they are told apart in order however they arrive.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions import rows as R
from ..operators.nearest import match_on_layer
from ..operators.quality import position_tier
from ..session import ship


def live_tiers(stream: DataFrame, plan: DataFrame, window: str = "10 seconds", late: str = "30 seconds", pass_mm: float = K.PASS_MM, warn_mm: float = K.WARN_MM) -> DataFrame:
    """Counts of tiers by acquisition and window of arrival (``arrived``), from rows with a layer."""
    matched = match_on_layer(R.with_plan_axes(stream).filter("partial = 0"), plan)
    tier = matched.withColumn("tier", position_tier(F.col("distance"), pass_mm, warn_mm)).withWatermark("arrived", late)
    return tier.groupBy("acq_id", F.window("arrived", window)).agg(*[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("pass", "warn", "fail")])


SPOTS = "acq_id bigint, row_idx bigint, t double, mx double, my double, spot_id bigint"
_STATE = "t double, mx double, my double, spot_id bigint, at bigint, waiting binary"


def live_gap_spots(stream: DataFrame, gap_s: float = K.LAYER_GAP_S, tolerance_mm: float = K.REFILL_TOLERANCE_MM, late: str = "30 seconds", forget_s: float = 3600.0) -> DataFrame:
    """Spot ids by pauses, as ``operators.gaps.gap_spots`` gives them, of rows with their time of arrival (``arrived``).

    Rows may arrive in any order within ``late``; what is later is dropped. The state of an acquisition is its last row and
    those that wait, at most what arrives within ``late``. ``forget_s`` after its last row it is dropped; an acquisition that
    goes on after that begins again at spot 0.
    """
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = None, []
        if state.exists:
            *last, at, held = state.get
            last, waiting = (None if last[3] is None else last), pickle.loads(held)
        mark, at = state.getCurrentWatermarkMs(), at if state.exists else 0
        for p in frames:
            waiting += list(p[["row_idx", "t", "mx", "my", "ms"]].itertuples(index=False, name=None))
        out = []
        for row, t, x, y, _ in sorted(r for r in waiting if r[4] <= mark):
            n = 0 if last is None else last[3] + (t - last[0] >= gap_s and not ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 <= tolerance_mm)
            last = (t, x, y, int(n))
            out.append((key[0], row, t, x, y, last[3]))
        at, waiting = max([at, *(r[4] for r in waiting)]), [r for r in waiting if r[4] > mark]
        if waiting or mark < at + 1000 * forget_s:
            state.update((*(last or (None,) * 4), at, pickle.dumps(waiting)))
            state.setTimeoutTimestamp(min((r[4] for r in waiting), default=int(max(at, mark) + 1000 * forget_s)))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["acq_id", "row_idx", "t", "mx", "my", "spot_id"])

    rows = stream.withWatermark("arrived", late).select(F.col("acq_id").cast("bigint").alias("acq_id"), "row_idx", "t", "mx", "my", F.unix_millis("arrived").alias("ms"), "arrived")
    return rows.groupBy("acq_id").applyInPandasWithState(step, SPOTS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Progress(StreamingQueryListener):
    """Tells a callback (query, batch, rows read, watermark) of each batch; ``spark.streams.addListener`` takes it."""

    def __init__(self, told: Callable[[str, int, int, str | None], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.name or str(p.id), p.batchId, p.numInputRows, p.eventTime.get("watermark"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
