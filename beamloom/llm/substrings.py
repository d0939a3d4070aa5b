"""Substring deduplication: passages of ``WORDS`` words or more that stand in two documents or more.

Texts are taken as words between white space. The joined words' bytes are cut where the gear rolling hash is lowest
within ``REACH`` bytes on both sides, so an insertion shifts no cut but those near it. Chunk digests are counted over
all documents; a chunk of two documents is shared. If two documents have ``WORDS`` words in a row in common, they are
cut equally there but for the margins, so every whole chunk inside is shared. The windows of ``WORDS`` words for which
that holds are candidates (windows without a whole chunk inside too, so none is missed). Their digests (96 bits, rolled
over the words' 128-bit digests: among 10^12 windows two different ones agree with a probability of 10^-5) are counted in
the same way, and the windows that two documents have give the passages: runs of such windows, word by word.

The document with the smallest key (its id) that has a window keeps it; in the others it is to be removed, which
``remove_passages`` does.

Shuffles: chunk digests are counted with map-side combination and joined back to the documents' lists; only documents
that a Bloom filter of the shared digests doesn't rule out are shuffled with their texts to meet their lists, and only
windows that a filter of the repeated ones doesn't rule out meet their owners. False alarms shuffle more and change no
result. Hot digests are a side of plain sort-merge joins, which adaptive execution can split.

Cases: null text counts as empty; texts of fewer than WORDS words have no passage. A passage that repeats in one
document only is left alone. Rows that repeat an id are documents of their own; among them the row numbers decide.
Equal texts share all their windows, so all but the first are wholly repeated, and
only the first is searched. Very long texts are searched whole. An empty table gives no rows. Other columns are ignored
by ``repeated_passages`` and kept by ``remove_passages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._shared import Scratch, documents, keyed, tied
from .gear import WINDOW, lowest_cuts

WORDS, REACH = 50, 24
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = re.compile(r"\S+")


def _chunk_digests(data: bytes, cuts: np.ndarray) -> np.ndarray:
    c = cuts.tolist()
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(c, c[1:], strict=False)], np.uint64)


def chunked(text: str | None, words_: int = WORDS) -> tuple[list[str], bytes, np.ndarray, np.ndarray]:
    """Words, their joined bytes, cuts, and digests of the chunks between cuts (nothing for texts too short to matter)."""
    words = (text or "").split()
    if len(words) < words_:
        return words, b"", np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = " ".join(words).encode("utf-8", "replace")
    cuts = lowest_cuts(np.frombuffer(data, np.uint8), REACH)
    return words, data, cuts, _chunk_digests(data, cuts)


def candidates(data: bytes, cuts: np.ndarray, shared: np.ndarray, words_: int = WORDS) -> np.ndarray:
    """First words of the windows all of whose inner chunks are shared."""
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    starts, stops = starts[: len(ends) - words_ + 1], ends[words_ - 1 :]
    low = np.searchsorted(cuts, starts + REACH + WINDOW - 1)
    high = np.searchsorted(cuts, stops - REACH - 1, side="right")
    alien = np.r_[0, np.cumsum(~shared)]
    inside = np.maximum(high - 1, low)  # chunks low .. high - 2 lie between cuts that any equal window has too
    last = len(alien) - 1
    return np.flatnonzero(alien[np.minimum(inside, last)] == alien[np.minimum(low, last)])


def window_hashes(words: list[str], at: np.ndarray, words_: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the windows that begin at the given words, of 64 and of 32 bits, by independent word hashes."""
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode("utf-8", "replace")) for w in words]), "<u8").reshape(-1, 2)
    power, inverse = np.full(len(h) + 1, _P, np.uint64), np.full(len(h) + 1, _P_INV, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    out = []
    for k in (0, 1):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h[:, k] * inverse[:-1], dtype=np.uint64)]
        out.append((sums[at + words_] - sums[at]) * power[at])
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digests(words: int):
    """Of each document: a digest of its words, their number, and the distinct digests of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, sizes, found = [], [], []
            for t in b.column(1):
                w, data, _, digests = chunked(t.as_py(), words)
                classes.append(xxhash.xxh3_128_digest(data))
                sizes.append(len(w))
                found.append(np.unique(digests).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["key", "class", "n", "digests"])

    return run


def _may_share(bits, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t in b.column(1):
                w, data, cuts, digests = chunked(t.as_py(), words)
                keep.append(len(w) >= words and len(candidates(data, cuts, bloom.hits(bits.value, digests), words)) > 0)
            if any(keep):
                yield b.filter(pa.array(keep))

    return run


def _windows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, listed, copied in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                w, data, cuts, digests = chunked(text.as_py(), words)
                shared = np.asarray(listed.values) if listed.is_valid else np.zeros(0, np.int64)
                at = candidates(data, cuts, np.isin(digests.view(np.int64), shared), words)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int64)), pa.array(np.full(len(at), copied)), pa.array(at, pa.int32()), *map(pa.array, window_hashes(w, at, words))], ["key", "copied", "at", "h", "g"])

    return run


def _may_repeat(bits):
    """Windows that may have an owner, and all of documents that have copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = bloom.hits(bits.value, b.column(3).to_numpy().view(np.uint64)) | b.column(1).to_numpy(zero_copy_only=False)
            if found.any():
                yield b.filter(pa.array(found))

    return run


def _spans(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, listed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, owner = (np.asarray(listed.values.field(i)).astype(np.int64) for i in (0, 1))
                order = np.argsort(at)
                at, owner = at[order], owner[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > 1) | ((owner[1:] == key) != (owner[:-1] == key))) + 1):
                    rows.append((key, int(at[part[0]]), int(at[part[-1]]) + words, int(owner[part].min()), bool(owner[part[0]] == key)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["key", "start_word", "end_word", "owner", "kept"])

    return run


def _find(rows: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """(key, start_word, end_word, owner, kept) from rows (key, text)."""
    described = scratch.table(rows.select("key", "text").mapInArrow(_digests(words), "key bigint, class binary, n bigint, digests array<bigint>"), "digests").filter(F.col("n") >= words)
    classes = scratch.table(described.groupBy("class").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    alike = scratch.table(described.select("key", "class", "n").join(classes, "class").filter("copies > 1").select("key", "first", "n"), "alike")
    later = alike.filter("key <> first")
    places = described.select("key", F.explode("digests").alias("digest"))
    shared = scratch.table(places.groupBy("digest").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("digest"), "shared")
    lists = places.join(shared, "digest").groupBy("key").agg(F.collect_list("digest").alias("listed"))
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(shared, F.col("digest")))
    copied = alike.filter("key = first").select("key", F.lit(True).alias("copied"))
    texts = rows.select("key", "text").mapInArrow(_may_share(bits, words), "key bigint, text string").join(later.select("key"), "key", "left_anti")
    windows = texts.join(lists, "key", "left").join(copied, "key", "left").select("key", "text", "listed", F.coalesce("copied", F.lit(False)).alias("copied"))
    windows = scratch.table(windows.mapInArrow(_windows(words), "key bigint, copied boolean, at int, h bigint, g int"), "windows")
    owners = scratch.table(windows.groupBy("h", "g").agg(F.min("key").alias("owner"), F.max("key").alias("b")).filter("owner <> b").select("h", "g", "owner"), "owners")
    known = rows.sparkSession.sparkContext.broadcast(bloom.build(owners, F.col("h")))
    windows = windows.mapInArrow(_may_repeat(known), windows.schema)
    met = windows.join(owners, ["h", "g"], "left").filter("owner is not null or copied")
    found = met.groupBy("key").agg(F.collect_list(F.struct("at", F.coalesce("owner", "key").alias("owner"))).alias("found"))
    spans = scratch.table(found.mapInArrow(_spans(words), "key bigint, start_word bigint, end_word bigint, owner bigint, kept boolean"), "spans")
    earliest = scratch.table(spans.groupBy(F.col("key").alias("first")).agg(F.min("owner").alias("owner")), "earliest")
    whole = later.join(earliest, "first").select("key", F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("end_word"), "owner", F.lit(False).alias("kept"))
    return spans.unionByName(whole)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row for each repeated passage in each document: id, start_word, end_word, n_words, first_doc_id (who keeps it), kept."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "id", scratch)[0]
    spans = _find(rows, scratch, words)
    if dict(rows.dtypes)["id"] == "bigint":
        same = not rows.filter("not (id <=> key)").limit(1).collect()
    else:
        same = False
    if same:
        spans = spans.withColumns({"id": F.col("key"), "first": F.col("owner")})
    else:
        names = rows.select("key", "id")
        spans = scratch.table(spans, "spans").join(names, "key").join(names.select(F.col("key").alias("owner"), F.col("id").alias("first")), "owner")
    return tied(spans.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("first").alias("first_doc_id"), "kept"), scratch)


def _cut(place: int):
    """Takes the spans of the last column out of the texts in the column at ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            for i, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    t, at, out, last = texts[i], [m.span() for m in _SPACE.finditer(texts[i])], [], 0
                    for s in sorted(spans, key=lambda s: s["start_word"]):
                        out.append(t[last : at[s["start_word"]][0]])
                        last = at[s["end_word"] - 1][1]
                    texts[i] = "".join([*out, t[last:]])
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the repeated passages that another document keeps; white space around them stays."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    rows, key = keyed(docs, id_col, scratch)
    spans = _find(rows.select(F.col(key).alias("key"), F.col(f"`{text_col}`").alias("text")), scratch, words).filter(~F.col("kept"))
    cuts = spans.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    names = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    met = rows.select(F.col(key).alias("row key"), *names).join(cuts.withColumnRenamed(key, "row key"), "row key", "left").drop("row key")
    return tied(met.mapInArrow(_cut(docs.columns.index(text_col)), docs.schema), scratch)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


QUERIES = {"op6_substrings": (op6_substrings, None)}
