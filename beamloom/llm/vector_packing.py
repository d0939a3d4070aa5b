"""Vector bin packing of training examples into token sequences, under three limits at once.

A sequence has at most so many tokens, segments (pieces of examples) and loss-bearing tokens. An example is a list of
parts, each with a mark that says whether its tokens bear loss (the answers of instruction data do, prompts don't); the
first token of an example never does, since nothing predicts it. A document is an example of one part that bears loss.

The dot-product heuristic fills one sequence at a time: of the pieces that fit in all three dimensions, it takes the one
whose vector has the largest dot product with the room that is left, each dimension weighted by the demand for it. When
none fits, the longest waiting piece is cut to fill the gap. A sequence that reaches a limit before it is full, and the
last ones of a task, end at a power of two, which needs no padding: what stands behind it goes back to the waiting pieces.

Each task packs the rows of its own partition, so nothing is shuffled and ids never leave the worker that made them. It
holds ``POOL`` examples or ``POOL_TOKENS`` tokens at a time, whichever comes first, and one more example. A task leaves
no padding behind, so it doesn't matter how many tasks there are. Places are written to the shared folder once: a lost
executor costs a task's rows, and later reads see the same places. Sequence numbers are the task's number and a count.

Cases: null text or null parts are an empty example of one end token; null texts of parts are empty, null marks false.
Rows that repeat an id are examples of their own; null ids stay. Very long examples are cut into full sequences first.
Of equal dot products, the piece in the earliest place of the waiting list is taken. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents, tied
from .word_tokens import default_word_vocabulary, word_encoder

TOKENS, SEGMENTS, LOSS = 4096, 128, 4096
POOL, POOL_TOKENS = 1024, 1 << 21
END = 2  # the id that ends an example
_PLACED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, segment int, loss_tokens bigint"
_TYPES = (pa.int64(),) * 7 + (pa.int32(), pa.int64())


class Example:
    """Ids of an example, and where its loss-bearing tokens are: ``runs`` has the end of each part and its mark."""

    __slots__ = ("bounds", "id", "ids", "n", "sums")

    def __init__(self, id_: int | None, ids: bytes, runs: list[tuple[int, bool]]):
        self.id, self.ids, self.n = id_, ids, len(ids) // 4
        self.bounds, self.sums, at = [0, 1], [0, 0], 1
        for end, bears in runs:
            if end > at:
                self.bounds.append(end)
                self.sums.append(self.sums[-1] + (end - at if bears else 0))
                at = end

    def before(self, place: int) -> int:
        """Loss-bearing tokens before ``place``."""
        i = bisect_right(self.bounds, place) - 1
        if i + 1 == len(self.bounds) or self.sums[i + 1] == self.sums[i]:
            return self.sums[i]
        return self.sums[i] + place - self.bounds[i]

    def reach(self, start: int, loss: int) -> int:
        """The largest place such that the tokens from ``start`` to it bear at most ``loss``."""
        i = bisect_right(self.sums, most := self.before(start) + loss) - 1
        return self.n if i + 1 == len(self.bounds) else self.bounds[i] + most - self.sums[i]


class Packer:
    """Waiting pieces of examples, and the sequences made of them."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits, self.waiting, self.free, self.total = (tokens, segments, loss), {}, [], 0
        self.size, self.loss, self.sequence = np.zeros(64, np.int64), np.zeros(64, np.int64), 0

    def add(self, e: Example) -> Iterator[list[tuple[Example, int, int]]]:
        """Full sequences of a long example; the rest of it waits."""
        tokens, _, loss = self.limits
        start = 0
        while e.n - start >= tokens and e.before(start + tokens) - e.before(start) <= loss:
            yield [(e, start, start + tokens)]
            start += tokens
        if start < e.n:
            self._wait(e, start, e.n)

    def _wait(self, e: Example, start: int, end: int) -> None:
        place = self.free.pop() if self.free else len(self.waiting)
        if place >= len(self.size):
            self.size, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.loss))
        self.waiting[place] = (e, start, end)
        self.size[place], self.loss[place] = end - start, e.before(end) - e.before(start)
        self.total += end - start

    def _take(self, place: int) -> tuple[Example, int, int]:
        e, start, end = self.waiting.pop(place)
        self.free.append(place)
        self.size[place] = self.loss[place] = 0
        self.total -= end - start
        return e, start, end

    def fill(self) -> list[tuple[Example, int, int]]:
        """One sequence of waiting pieces. Places without a piece have size 0."""
        tokens, segments, loss = self.limits
        weights = self.size.sum() / tokens**2, self.loss.sum() / loss**2  # a segment counts 1 for each piece and decides nothing
        room, bear, made = tokens, loss, []
        while room and len(made) < segments and self.waiting:
            fits = (self.size <= room) & (self.loss <= bear) & (self.size > 0)
            score = np.where(fits, self.size * (weights[0] * room) + self.loss * (weights[1] * bear), -1.0)
            place = int(score.argmax())
            e, start, end = piece = self._take(place if score[place] >= 0 else int(self.size.argmax()))
            if score[place] < 0 and (cut := min(start + room, e.reach(start, bear))) < end:
                self._wait(e, cut, end)
                if cut == start:
                    break
                piece = (e, start, cut)
            made.append(piece)
            room -= piece[2] - start
            bear -= e.before(piece[2]) - e.before(start)
        if room:
            self._trim(made, tokens - room)
        return made

    def _trim(self, made: list[tuple[Example, int, int]], used: int) -> None:
        """The sequence ends at a power of two; the rest of it waits again."""
        over = used - (1 << used.bit_length() - 1)
        while over:
            e, start, end = made.pop()
            keep = max(start, end - over)
            self._wait(e, keep, end)
            over -= end - keep
            if keep > start:
                made.append((e, start, keep))

    def full(self) -> bool:
        return len(self.waiting) >= POOL or self.total >= POOL_TOKENS


def sequences(examples: Iterator[Example], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> Iterator[list[tuple[Example, int, int]]]:
    """Lists of (example, start, end), each one a sequence; every token of every example is in exactly one."""
    packer = Packer(tokens, segments, loss)
    for e in examples:
        yield from packer.add(e)
        if packer.full():
            while len(packer.waiting) > POOL // 2 or packer.total > POOL_TOKENS // 2:
                yield packer.fill()
    while packer.waiting:
        yield packer.fill()


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[Example]:
    coder, end = word_encoder(path), END.to_bytes(4, "little")
    for batch in batches:
        for id_, parts in zip(batch.column(0), batch.column(1), strict=True):
            ids, runs, n = [], [], 0
            for part in parts.as_py() or []:
                ids.append(found := coder.ids((part or {}).get("text") or ""))
                n += len(found) // 4
                runs.append((n, bool((part or {}).get("loss"))))
            runs.append((n + 1, runs[-1][1] if runs else False))
            yield Example(id_.as_py(), b"".join(ids) + end, runs)


def _packed(path: str, tokens: int, segments: int, loss: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PLACED.split(", ")]
        number, out = TaskContext.get().partitionId() << 33, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names)

        for made in sequences(_encoded(batches, path), tokens, segments, loss):
            offset = 0
            for k, (e, start, end) in enumerate(made):
                out.append((e.id, start, end - start, zlib.crc32(memoryview(e.ids)[4 * start : 4 * end]), e.n, number, offset, k, e.before(end) - e.before(start)))
                offset += end - start
            number += 1
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def one_part(text_col: str = "text") -> Column:
    """The parts of a document: its text, all of it bearing loss."""
    return F.array(F.struct(F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(True).alias("loss")))


def pack_vectors(examples: DataFrame, parts: Column, id_col: str = "doc_id", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens.

    ``parts`` is a column array<struct<text string, loss boolean>>. Ids are whole numbers.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("every limit is at least 1")
    scratch = Scratch(examples.sparkSession)
    rows = examples.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), parts.alias("parts"))
    placed = scratch.table(rows.mapInArrow(_packed(vocabulary or default_word_vocabulary(), tokens, segments, loss), _PLACED), "placed")
    return tied(placed.withColumnRenamed("doc_id", id_col), scratch)


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_vectors(documents(spark, sf_dir), one_part()).drop("segment")


QUERIES = {"op11_vector_packing": (op11_vector_packing, None)}
