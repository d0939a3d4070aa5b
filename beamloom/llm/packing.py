"""Best-fit packing of documents into fixed-length token sequences by large-item matching.

Documents longer than a sequence are cut into full pieces, of which the first may be shorter. Pieces above a third of
the capacity are matched greedily, largest with the largest that still fits, at most two to a bin; the smaller ones then
go, largest first, into the tightest gap that holds them, and into new bins at last.

Only the lengths decide, and there are at most ``capacity`` of them. So the driver packs the histogram (one row for each
length, bounded by the capacity however many documents there are): equal pieces go to equal bins in one step, and a
step is one row of a plan, "of length s, the pieces numbered r to r+n go to bins from b on, k in each, from offset o".
The executors number the pieces of each length and look their place up. Numbers come from counts by (length, bucket of
the piece's hash), so a length that a third of all pieces have is spread over many buckets.

Cases: null text is an empty document of one end token. Rows that repeat an id are documents of their own. Nothing is
dropped. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, documents, tied
from .tokens import END, default_vocabulary, encoder

CAPACITY = 2048
BUCKETS, BUCKET_ROWS = 64, 20_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_END = END.to_bytes(4, "little")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py() or "") + _END
                out += [(doc, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Gaps:
    """Ranges of bins by the room that is left in them."""

    def __init__(self):
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: list[int] = []

    def add(self, gap: int, start: int, n: int) -> None:
        if gap and n:
            if not self.ranges[gap]:
                insort(self.sizes, gap)
            self.ranges[gap].append((start, n))

    def tightest(self, size: int) -> int | None:
        i = bisect_left(self.sizes, size)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int) -> tuple[int, int]:
        found = self.ranges[gap].pop()
        if not self.ranges[gap]:
            self.sizes.remove(gap)
        return found


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, pieces, first bin, offset, pieces in each bin) that place every piece; number of bins."""
    left, rank, rows, bins, gaps = dict(counts), defaultdict(int), [], 0, _Gaps()

    def put(size: int, n: int, start: int, offset: int, each: int = 1) -> None:
        rows.append((size, rank[size], n, start, offset, each))
        rank[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        i = bisect_left(large, capacity - s + 1) - 1  # the largest partner that fits
        t = large[i] if i >= 0 else None
        n = 0 if t is None else left[s] // 2 if t == s else min(left[s], left[t])
        if n:
            put(s, n, bins, 0)
            put(t, n, bins, s)
            gaps.add(capacity - s - t, bins, n)
        else:
            n = left[s]
            put(s, n, bins, 0)
            gaps.add(capacity - s, bins, n)
        bins += n
        large = [x for x in {s, t} & set(large) if left[x]] + [x for x in large if x not in (s, t)]
        large.sort()
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = gaps.tightest(s)
            if gap is None:
                each = capacity // s
                full, rest = divmod(left[s], each)
                gap, start, n = capacity, bins, full + (rest > 0)
                bins += n
            else:
                start, n = gaps.take(gap)
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, start, capacity - gap, each)
                gaps.add(gap - each * s, start, full)
            if full < n and left[s]:  # the last pieces of this length share one more bin
                rest = left[s]
                put(s, rest, start + full, capacity - gap, rest)
                gaps.add(gap - rest * s, start + full, 1)
                full += 1
            gaps.add(gap, start + full, n - full)
    return rows, bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, piece_uid."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity), _PIECES).withColumn("piece_uid", F.monotonically_increasing_id())
    pieces = scratch.table(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    steps = spark.createDataFrame(rows, "s_length bigint, s_rank bigint, s_n bigint, s_bin bigint, s_offset bigint, s_each bigint")
    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_ROWS))
    dealt = pieces.withColumn("b", F.pmod(F.xxhash64("piece_uid"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n")).select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("piece_uid")) - 1).join(base, ["length", "b"]).withColumn("r", F.col("r") + F.col("base"))
    i = F.col("r") - F.col("s_rank")
    placed = ranked.join(F.broadcast(steps), (F.col("length") == F.col("s_length")) & (i >= 0) & (i < F.col("s_n")))
    out = placed.select(
        F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("s_bin") + F.floor(i / F.col("s_each"))).cast("bigint").alias("sequence_id"), (F.col("s_offset") + i % F.col("s_each") * F.col("length")).cast("bigint").alias("offset"), "piece_uid",
    )
    return tied(out, scratch)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("piece_uid")


QUERIES = {"op7_packing": (op7_packing, None)}
