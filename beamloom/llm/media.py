"""Media columns: content-defined chunking of payloads, chunks stored once, media put together from chunk lists.

A payload (the text's bytes, padded with 255 to a multiple of ``UNIT``) is cut by a gear rolling hash into chunks of
``LEAST`` to ``MOST`` bytes, 8-bit samples as they are. A first pass writes the manifest: for each chunk its SHA-256
digest, length and place. Digests that occur more than once are found by a Spark aggregation, and each gets an owner,
the first place that has it. A second pass stores for every document the ordered list of its chunks with the samples of
those that it owns; a chunk that another document owns is stored as its digest alone. Reading joins these digests with
their owners' chunks, puts the lists together, checks every digest and computes the features from the bytes read back.

Only documents that may hold a shared chunk are shuffled to meet their owners' decisions. To tell them in a scan, the
shared digests are put into a Bloom filter: it never misses one, and its false alarms only shuffle some documents more. Samples are zstandard frames inside the store.

A document's stored form, of which media_bytes and media_sha256 are computed, is what is read of the store for it: the
letters CDC1, u32 number of chunks, for each chunk of its list u32 length, u32 length of the stored frame and the digest,
then the frames as they are stored, in order. A chunk's frame is the same whoever owns it.

Cases: null text counts as empty and gives one unit of padding. Very long texts are chunked whole. Rows that repeat an id
are media of their own. Of equal chunks, the one of the smallest key and place is stored. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from ._shared import Scratch, documents, keyed, tied
from .gear import masked_cuts

UNIT, PAD = 576, 255
LEAST, MEAN_BITS, MOST = 1024, 12, 16384
LEVEL = 6
_CHUNKS = "array<struct<digest: binary, size: int, data: binary>>"
_CHUNK = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())])


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the padded payload."""
    raw = (text or "").encode("utf-8", "replace")
    whole = max(1, -(-len(raw) // UNIT)) * UNIT
    return len(raw), raw + bytes([PAD]) * (whole - len(raw))


def chunks(data: bytes) -> list[bytes]:
    out, start = [], 0
    for end in masked_cuts(np.frombuffer(data, np.uint8), LEAST, MEAN_BITS, MOST):
        out.append(data[start:end])
        start = end
    return out


def stored_form(frames: list[bytes], sizes: list[int], digests: list[bytes]) -> bytes:
    head = [struct.pack("<II", n, len(f)) + d for n, f, d in zip(sizes, frames, digests, strict=True)]
    return b"".join([b"CDC1", struct.pack("<I", len(frames)), *head, *frames])


def feature(data: bytes) -> str:
    """Mean and spread of the samples, entropy of their values in bits, and a 64-bit mark of a 24 by 24 mean image."""
    x = np.frombuffer(data, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    rows = x.reshape(-1, UNIT)  # one frame of 24 by 24 samples after another
    image = rows.mean(axis=0).reshape(8, 3, 8, 3).mean(axis=(1, 3))
    mark = int.from_bytes(np.packbits(image.ravel() > image.mean()).tobytes(), "big")
    return f"frames={len(rows)};mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};mark={mark:016x}"


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, seqs, digests = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for seq, part in enumerate(chunks(payload(text.as_py())[1])):
                keys.append(key)
                seqs.append(seq)
                digests.append(hashlib.sha256(part).digest())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seqs, pa.int32()), pa.array(digests, pa.binary())], ["key", "seq", "digest"])


def _store(bits, maybe: bool):
    """Chunk lists of the documents that may (or cannot) hold a shared chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, pack = bits.value, zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            rows = []
            for key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, data = payload(text.as_py())
                parts = chunks(data)
                digests = [hashlib.sha256(p).digest() for p in parts]
                hit = bloom.hits(have, np.frombuffer(b"".join(digests), ">u8")[::4].astype(np.uint64)).any()  # the first 8 of 32 bytes
                if hit == maybe:
                    rows.append((key, doc, n, [{"digest": d, "size": len(p), "data": pack.compress(p)} for p, d in zip(parts, digests, strict=True)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(_CHUNK)), strict=True)], ["key", "doc_id", "n_bytes", "chunks"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, n, listed, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            listed = listed.as_py()
            by_digest = {c["digest"]: c["data"] for c in listed if c["data"] is not None} | {c["digest"]: c["data"] for c in found.as_py() or []}
            frames = [by_digest[c["digest"]] for c in listed]
            parts = [unpack.decompress(f, max_output_size=MOST) for f in frames]
            digests = [hashlib.sha256(p).digest() for p in parts]
            if digests != [c["digest"] for c in listed] or [len(p) for p in parts] != [c["size"] for c in listed]:
                raise ValueError(f"a stored chunk of document {doc} is damaged")
            data, form = b"".join(parts), stored_form(frames, [len(p) for p in parts], digests)
            rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature(data), len(parts)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])


def write_media(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The store: key, doc_id, n_bytes, chunks (digest, size, data: null where another document owns it), shared (places that others refer to)."""
    spark = docs.sparkSession
    texts = keyed(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "doc_id", scratch)[0].select("key", "doc_id", "text")
    manifest = scratch.table(texts.select("key", "text").mapInArrow(_manifest, "key bigint, seq int, digest binary"), "manifest")
    owners = scratch.table(manifest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "seq")).alias("owner")).filter("n > 1").select("digest", "owner"), "owners")
    bits = spark.sparkContext.broadcast(bloom.build(owners, F.expr("cast(conv(hex(substring(digest, 1, 8)), 16, -10) as bigint)")))
    schema = f"key bigint, doc_id bigint, n_bytes bigint, chunks {_CHUNKS}"
    alone = texts.mapInArrow(_store(bits, False), schema).withColumn("shared", F.array().cast("array<int>"))
    owns = (F.col("key") == F.col("owner.key")) & (F.col("seq") == F.col("owner.seq"))
    places = manifest.join(owners, "digest").select("key", "seq", owns.alias("owns")).groupBy("key").agg(F.collect_list(F.when(F.col("owns"), F.col("seq"))).alias("shared"), F.collect_list(F.when(~F.col("owns"), F.col("seq"))).alias("theirs"))
    meeting = texts.mapInArrow(_store(bits, True), schema).join(places, "key", "left")
    kept = F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), c["size"].alias("size"), F.when(~F.coalesce(F.array_contains("theirs", i), F.lit(False)), c["data"]).alias("data")))
    meeting = meeting.select("key", "doc_id", "n_bytes", kept.alias("chunks"), F.coalesce("shared", F.array().cast("array<int>")).alias("shared"))
    return scratch.table(alone.unionByName(meeting), "media")


def read_media(store: DataFrame) -> DataFrame:
    """One row for each document, computed from the bytes read back from the store."""
    out = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int"
    no_chunks = F.array().cast("array<struct<digest: binary, data: binary>>")
    lacks = F.exists("chunks", lambda c: c["data"].isNull())
    whole = store.filter(~lacks).select("doc_id", "n_bytes", "chunks", no_chunks.alias("found")).mapInArrow(_read, out)
    wanted = store.filter(lacks).select("key", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["data"].isNull()), lambda c: c["digest"]))).alias("digest"))
    given = store.filter(F.size("shared") > 0).select(F.explode(F.transform("shared", lambda i: F.element_at("chunks", i + 1))).alias("c")).select("c.digest", "c.data")
    found = wanted.join(given, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("found"))
    rest = store.filter(lacks).join(found, "key", "left").select("doc_id", "n_bytes", "chunks", F.coalesce("found", no_chunks).alias("found")).mapInArrow(_read, out)
    return whole.unionByName(rest)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return tied(read_media(write_media(documents(spark, sf_dir), scratch)), scratch)


QUERIES = {"op2_media": (op2_media, None)}
