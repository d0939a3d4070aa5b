"""Bounded labelled samples and their features, for the classifiers.

A sample takes about ``per_class`` rows of each label, chosen by a hash of the id, so it is the same in every run and
does not grow with the table. Labelled texts of more than ``MOST_CHARS`` characters are not learned from, so that the
sample is bounded in size too. Its features are computed on the executors; only sparse vectors come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

MOST_CHARS = 1 << 16
#: A column with more labels than that (there are about 8000 languages) is refused, not cut.
MOST_LABELS = 10_000
#: With many labels each gets fewer examples, so that a sample never has many more than that.
MOST_ROWS = 8_000
#: Up to that many labels, their sizes are broadcast (a few megabytes).
MOST_SENT = 50_000


def remainder(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 of a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)), F.lit(n)).cast("int")


def sample(rows: DataFrame, per_class: int) -> tuple[DataFrame, dict]:
    """About per_class rows of each label of (id, label), and the share of each label's rows that it takes.

    Ids that repeat count once, with their largest label; null ids and labels are left out. Every label is learned; more
    than ``MOST_LABELS`` labels raise ValueError.
    """
    rows = rows.dropna().groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return rows.limit(0), {}
    each = max(1, min(per_class, MOST_ROWS // len(counts)))
    share = {label: min(1.0, each / n) for label, n in counts.items()}
    limits = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    unit = F.pmod(F.xxhash64("id", F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(F.coalesce(unit < F.element_at(limits, F.col("label")), F.lit(False))), share


def first_by_hash(rows: DataFrame, per_class: int) -> DataFrame:
    """The per_class rows of each label of (id, label) whose ids have the smallest hashes; all rows of rarer labels.

    Beyond ``MOST_ROWS / per_class`` labels each gets fewer rows, but one at least: every label is learned, whatever their
    number. Ids that repeat count once, with their largest label; null ids and labels are left out.

    Rows are ranked within their label. Before that, those go whose hash is so large, for the number of rows that the label
    has, that several times as many smaller ones are to be expected as are wanted. So a label brings about
    4 * per_class + 60 rows to its task, however many it has (fewer than wanted once in e ** 60 labels).
    """
    rows = rows.dropna().groupBy("id").agg(F.max("label").alias("label")).withColumn("hash", F.xxhash64("id", F.lit(77)))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = sizes.count()
    each = max(1, min(per_class, MOST_ROWS // max(1, labels)))
    share = F.col("hash") / F.lit(2.0**64) + 0.5
    near = rows.join(F.broadcast(sizes) if labels <= MOST_SENT else sizes, "label").filter(share * F.col("n") < 4 * each + 60)
    order = Window.partitionBy("label").orderBy("hash", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("id", "label")


def sparse_features(docs: DataFrame, chosen: DataFrame, feature: Callable[[str], tuple[np.ndarray, np.ndarray]], id_col: str, text_col: str, most_chars: int = MOST_CHARS) -> list[tuple[int, object, np.ndarray, np.ndarray]]:
    """(id, label, indices, values) of the sample's documents in the order of their ids; chosen is bounded by ``sample``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [feature(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["id", "label", "i", "v"])

    kind = dict(docs.dtypes)[id_col]
    got = texts.filter(F.length("text") <= most_chars).join(F.broadcast(chosen), "id").select("id", "text", "label").mapInArrow(run, f"id {kind}, label {dict(chosen.dtypes)['label']}, i binary, v binary").collect()
    rows = [(r["id"], r["label"], np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")) for r in got]
    return sorted(rows, key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
