"""Token-id files compressed by a Re-Pair grammar.

Documents are sorted by id over range partitions and encoded; runs of documents of about ``SHARD_TOKENS`` ids make a
shard. In a shard, adjacent pairs of symbols are replaced by new symbols, the most frequent pairs first, until no pair
occurs twice without overlap. Pairs far apart are replaced in one turn: a turn replaces each pair wherever it is more
frequent than the pairs that it overlaps with there. Pairs never cross the end of a document. A shard keeps its rules,
the length of what each rule stands for, and each document's first symbol, so one document, or a part of it, is decoded
alone.

Shards are rows of a Parquet table (columns below), written and read by Spark, so they may lie in any store; the query
writes them to the shared folder, ``write_token_shards`` to any path. Columns: part, k (place of the shard in its
partition), n_docs, n_tokens, data (the file image).

File image, little-endian: the letters RPG1; u32 vocabulary size, rules, documents, symbols; u32 bytes of an expansion
length (1, 2 or 4); the rules' left symbols, right symbols and expansion lengths; documents as i64 id, u8 1 where the id
is null, u32 first symbol, u32 ids; symbols. A list of symbols is a plane of u16 (low bits) and one of the high bits,
which is u8, or u16 where vocabulary and rules are more than 2^24. The rules of a turn are sorted by left and right.

Cases: null text is an empty document, only its end id. Null ids come first, equal ids in the order of their text's hash.
A very long document makes a shard of its own size. An empty table gives no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ._shared import Scratch, documents, tied
from .tokens import END, default_vocabulary, encoder

VOCABULARY = 50_257
SHARD_TOKENS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
SHARDS = "part int, k int, n_docs bigint, n_tokens bigint, data binary"
_HEAD = struct.Struct("<4sIIIII")


def _runs(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places by their pair: numbers of the places in the order of pairs, where each pair begins among them, its left and right.

    Pair and place are one number where that has room, as plain numbers sort several times faster than places by their numbers.
    """
    wide, bits = symbols.bit_length(), len(left).bit_length()
    code = left.astype(np.int64) << wide | right
    if 2 * wide + bits < 64:
        code <<= bits
        code |= np.arange(len(code))
        code.sort()
        order = code & ((1 << bits) - 1)
        code >>= bits
    else:
        order = np.argsort(code, kind="stable")
        code = code[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return order, begin, code[begin] >> wide, code[begin] & ((1 << wide) - 1)


def compress(ids: np.ndarray, starts: np.ndarray, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ids whose documents begin at starts: symbols, first symbols, rules (n, 2), expansion lengths.

    Symbols are a linked list. A turn counts the pairs at the places to look at, gives each pair its count as priority
    (a mark of the pair decides between equal counts, and the pair between equal marks), and replaces a pair wherever it goes before the pairs on both
    sides, if that is twice or more. The most frequent pair of all always is, so turns go on until no pair is left that
    occurs twice without overlap. A pair's count only falls, except for pairs of new symbols. So after the first turn the
    places to look at are those next to a new symbol and those of pairs that still occur twice.
    """
    n = len(ids)
    kind = np.int32 if n < 1 << 30 else np.int64
    s, rules, base = ids.astype(kind), [], vocabulary
    after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
    after[starts[1:] - 1] = -1
    after[-1:] = -1
    before[starts] = -1
    rank, mark = np.zeros(n + 1, kind), np.zeros(n + 1, bool)  # the last one stands for "none", which -1 finds
    look, turn = np.flatnonzero(after >= 0), 0
    while len(look):
        follows, kept = after.take(look), look
        left, right = s.take(look), s.take(follows)
        alike = np.flatnonzero(left == right)
        if len(alike):  # of a run of one symbol every second place counts
            start = np.r_[True, follows[alike[:-1]] != look[alike[1:]]]
            at = np.arange(len(alike))
            counted = np.ones(len(look), bool)
            counted[alike[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 1]] = False
            kept, left, right = look[counted], left[counted], right[counted]
            mark[look[~counted]] = True
        order, begin, first, second = _runs(left, right, base)
        count = np.diff(begin, append=len(order))
        often = count >= 2
        place = kept.take(order[np.repeat(often, count)])
        first, second, count = first[often], second[often], count[often]
        code = (first << 31 | second).astype(np.uint64)
        by_value = np.argsort(count << 36 | ((code * (_MIX + np.uint64(2 * turn))) >> np.uint64(28)).astype(np.int64), kind="stable")
        ranks = np.empty(len(count), kind)
        ranks[by_value] = np.arange(1, len(count) + 1)
        rank[place] = np.repeat(ranks, count)
        mine = rank.take(kept)
        look = np.flatnonzero(mine > 0)
        kept, mine = kept[look], mine[look]
        wins = np.flatnonzero(mine > np.maximum(rank.take(before.take(kept)), rank.take(after.take(kept))))
        rank[kept] = 0
        mark[kept] = True
        hit, mine = kept[wins], by_value.take(mine[wins] - 1)
        taken = np.bincount(mine, minlength=len(count))
        made = np.flatnonzero(taken.take(mine) >= 2)
        hit, mine = hit[made], mine[made]
        if not len(hit):  # then no pair is left
            break
        new = np.flatnonzero(taken >= 2)
        name = np.empty(len(count), np.int64)
        name[new] = base + np.arange(len(new))
        gone, mine = after.take(hit), name.take(mine)
        rules.append(np.column_stack([first[new], second[new]]))
        base += len(new)
        s[hit], s[gone] = mine, -1
        far = after.take(gone)
        after[hit] = far
        before[far[far >= 0]] = hit[far >= 0]
        mark[hit] = True
        mark[before[hit]] = True
        mark[n] = False
        look = np.flatnonzero(mark[:n])
        mark[look] = False
        look = look[(s.take(look) >= 0) & (after.take(look) >= 0)]
        turn += 1
    stays = s >= 0
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    lengths, at = np.ones(base, np.int64), vocabulary
    for pairs in rules:  # rules of one turn refer to earlier ones only
        lengths[at : at + len(pairs)] = lengths[pairs[:, 0]] + lengths[pairs[:, 1]]
        at += len(pairs)
    return s[stays], (np.cumsum(stays) - stays)[starts], table, lengths[vocabulary:]


def _high(symbols: int) -> str:
    return "u1" if symbols <= 1 << 24 else "<u2"


def write_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int = VOCABULARY) -> bytes:
    starts = np.cumsum([0, *counts[:-1]]).astype(np.int64)
    symbols, first, rules, lengths = compress(ids, starts, vocabulary)
    index = np.zeros(len(doc_ids), [("id", "<i8"), ("null", "u1"), ("first", "<u4"), ("n", "<u4")])
    index["id"], index["null"] = [d or 0 for d in doc_ids], [d is None for d in doc_ids]
    index["first"], index["n"] = first, counts
    width = 1 if (most := lengths.max(initial=0)) < 1 << 8 else 2 if most < 1 << 16 else 4
    high = _high(vocabulary + len(rules))
    planes = lambda x: [(x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype(high).tobytes()]
    head = _HEAD.pack(b"RPG1", vocabulary, len(rules), len(doc_ids), len(symbols), width)
    return b"".join([head, *planes(rules[:, 0]), *planes(rules[:, 1]), lengths.astype(f"<u{width}").tobytes(), index.tobytes(), *planes(symbols)])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from each start on, n of each."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)


class Shard:
    """A shard's file image, read in place."""

    def __init__(self, data: bytes):
        name, self.vocabulary, n_rules, n_docs, n, width = _HEAD.unpack_from(data)
        if name != b"RPG1":
            raise ValueError("not a shard of token ids")
        at, high = _HEAD.size, np.dtype(_high(self.vocabulary + n_rules))

        def planes(n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, "<u2", n, at).astype(np.int64) | np.frombuffer(data, high, n, at + 2 * n).astype(np.int64) << 16
            at += (2 + high.itemsize) * n
            return found

        left, right = planes(n_rules), planes(n_rules)
        self.rules = np.column_stack([left, right, np.frombuffer(data, f"<u{width}", n_rules, at).astype(np.int64)])
        at += width * n_rules
        self.index = np.frombuffer(data, [("id", "<i8"), ("null", "u1"), ("first", "<u4"), ("n", "<u4")], n_docs, at)
        at += self.index.nbytes
        self.symbols = planes(n)
        self._texts: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """What each rule stands for, in one array, and where each begins.

        Rules refer to earlier ones, so they are written in runs of rules that refer to none of their own run.
        """
        if self._texts is None:
            base, n = self.vocabulary, len(self.rules)
            parts, size = self.rules[:, :2], self.rules[:, 2]
            begin = np.cumsum(size) - size
            texts, one = np.empty(int(size.sum()), "<u4"), np.r_[size, 1]  # the last one stands for single ids
            newest, start = parts.max(axis=1, initial=0), 0
            while start < n:
                later = newest[start:] >= base + start
                end = start + int(later.argmax()) if later.any() else n
                to = begin[start:end]
                for side in (0, 1):
                    symbol = parts[start:end, side]
                    single = symbol < base
                    texts[to[single]] = symbol[single]
                    rule = symbol[~single] - base
                    texts[_ranges(to[~single], size[rule])] = texts[_ranges(begin[rule], size[rule])]
                    to = to + one[np.where(single, n, symbol - base)]
                start = end
            self._texts = texts, begin
        return self._texts

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        texts, begin = self._expansions()
        base = self.vocabulary
        inner = self.symbols >= base
        rule = np.where(inner, self.symbols - base, 0)
        size = np.where(inner, self.rules[rule, 2], 1) if len(self.rules) else np.ones(len(self.symbols), np.int64)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), "<u4")
        out[at[~inner]] = self.symbols[~inner]
        out[_ranges(at[inner], size[inner])] = texts[_ranges(begin[rule[inner]], size[inner])]
        return out

    def document(self, i: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Ids start to stop of document i: symbols before and after are passed over by their expansion lengths."""
        stop = int(self.index["n"][i]) if stop is None else min(stop, int(self.index["n"][i]))
        out, at, k = [], 0, int(self.index["first"][i])
        while at < stop:
            stack = [int(self.symbols[k])]
            k += 1
            while stack and at < stop:
                s = stack.pop()
                rule = s - self.vocabulary
                size = 1 if rule < 0 else int(self.rules[rule, 2])
                if at + size <= start:
                    at += size
                elif rule < 0:
                    out.append(s)
                    at += 1
                else:
                    stack += [int(self.rules[rule, 1]), int(self.rules[rule, 0])]
        return out


def _write(path: str, shard_tokens: int, vocabulary: int):
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, k = encoder(path), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, size
            image = write_shard(docs, [len(t) // 4 for t in texts], np.frombuffer(b"".join(texts), "<u4"), vocabulary)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64()), pa.array([image], pa.binary())], ["part", "k", "n_docs", "n_tokens", "data"])
            docs.clear()
            texts.clear()
            k, size = k + 1, 0
            return row

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py() or "") + end
                docs.append(doc)
                texts.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_shards(docs: DataFrame, out: Scratch | str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The table of shards, written to a path (or as a scratch table) and opened again.

    Its rows in the order of (part, k) hold ascending ids.
    """
    from tokenizers import Tokenizer

    path = vocabulary or default_vocabulary()
    size = Tokenizer.from_file(path).get_vocab_size()
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(f"`{text_col}`").alias("h"))
    ordered = texts.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    ship(docs.sparkSession)
    shards = ordered.mapInArrow(_write(path, shard_tokens, size), SHARDS)
    if isinstance(out, Scratch):
        return out.table(shards, "shards")
    shards.write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(SHARDS).parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = Shard(data.as_py())
            ids, n = memoryview(shard.ids()).cast("B"), shard.index["n"].astype(np.int64)
            at = np.cumsum(n) - n
            crc = [zlib.crc32(ids[4 * a : 4 * (a + c)]) for a, c in zip(at.tolist(), n.tolist(), strict=True)]
            place = [pa.array(np.full(len(n), v, np.int32)) for v in (part, k)]
            yield pa.RecordBatch.from_arrays([*place, pa.array(shard.index["id"], pa.int64(), mask=shard.index["null"] == 1), pa.array(at), pa.array(n), pa.array(crc, pa.int64())], ["part", "k", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row for each document, decoded from the shards where they lie: doc_id, start, n_tokens, ids_crc32."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # as many rows as partitions that wrote
    before = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "k", inside.alias("inside")).join(totals.select("part", before.alias("before")), "part").select("part", "k", (F.col("inside") + F.col("before")).alias("first"))
    decoded = shards.select("part", "k", "data").mapInArrow(_read, "part int, k int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(starts, ["part", "k"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return tied(read_token_shards(write_token_shards(documents(spark, sf_dir), scratch)), scratch)


QUERIES = {"op9_token_files": (op9_token_files, None)}
