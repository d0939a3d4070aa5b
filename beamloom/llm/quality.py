"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words between white space (lower case, without marks at their ends), the last three characters of
each as they stand, case and marks included, and one term for a word that repeats the word before it. Terms are hashed to
``DIM`` places. The square roots of their shares of the text times idf are projected on the ``LATENT`` main axes of the
term-by-document matrix of a bounded labelled sample (a singular value decomposition in numpy, by subspace iteration). The sample's projected
vectors, of length one, go to the executors by broadcast (at most ``PER_CLASS`` a label, so bounded). Each document's
cosines to all of them come from blocked matrix products, and the ``NEIGHBOURS`` nearest vote with their cosine to the
power ``SHARPNESS`` times the inverse of their label's sample share.

Cases: null text counts as empty and is scored like one, by a place of its own. Whole texts are read. Equal cosines (to 10
decimals) are taken in the order of the examples' ids. Rows that repeat an id get a row each. Without a labelled row every
score is 0; with one label only, that label. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import documents, keeps, labels, task_of
from .learn import MOST_CHARS, remainder, sample, sparse_features

PER_CLASS, DIM, LATENT, NEIGHBOURS, SHARPNESS = 1500, 4096, 32, 25, 8
KEEP = 0.3  # scores from here on are good enough
_BLOCK = 256  # documents whose cosines are computed at once
_KEPT = 200_000  # words whose places a worker keeps
_MARKS = ".,;:!?"


class _Places(dict):
    """Places of a word and of its last three characters, as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        plain, end = word.lower().strip(_MARKS), word[-3:]
        found = self[word] = (2 + zlib.crc32(f"w{plain}".encode("utf-8", "replace")) % (DIM - 2)) * DIM + 2 + zlib.crc32(f"e{end}".encode("utf-8", "replace")) % (DIM - 2)
        return found


_PLACES = _Places()
keeps("quality", _PLACES.clear)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a whole text's terms and their shares; place 0 holds repeated words, place 1 texts without any."""
    words = text.split()
    if not words:
        return np.ones(1, np.int64), np.ones(1)
    both = np.fromiter(map(_PLACES.__getitem__, words), np.int64, len(words))
    counts = np.bincount(both // DIM, minlength=DIM) + np.bincount(both % DIM, minlength=DIM)
    counts[0] = sum(map(str.__eq__, words[1:], words))
    where = np.flatnonzero(counts)
    return where, counts[where] / len(words)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # DIM by LATENT
    vectors: np.ndarray  # examples by LATENT, of length one
    good: np.ndarray
    vote: np.ndarray

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        full = np.zeros((len(rows), DIM))
        for i, (where, share) in enumerate(rows):
            full[i, where] = np.sqrt(share) * self.idf[where]
        v = full @ self.axes
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for s in range(0, len(texts), _BLOCK):
            cosine = np.round(self.project([features(t) for t in texts[s : s + _BLOCK]]) @ self.vectors.T, 10)
            least = np.partition(cosine, -k, axis=1)[:, -k, None]
            over, equal = cosine > least, cosine == least
            taken = over | equal & (np.cumsum(equal, axis=1) <= k - over.sum(axis=1, keepdims=True))  # the first of equal ones
            row, top = np.nonzero(taken)
            w = (np.maximum(cosine[row, top], 1e-6) ** SHARPNESS * self.vote[top]).reshape(-1, k)
            out[s : s + _BLOCK] = (w * self.good[top].reshape(-1, k)).sum(axis=1) / w.sum(axis=1)
        return np.clip(out, 0, 1)


def main_axes(matrix: np.ndarray, n: int = LATENT, rounds: int = 16) -> np.ndarray:
    """The first n right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(1).standard_normal((matrix.shape[1], n + 16))
    for _ in range(rounds):
        q, _ = np.linalg.qr(matrix.T @ (matrix @ q))
    _, _, turn = np.linalg.svd(matrix @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :n])


def train(rows: list[tuple], share: dict[int, float]) -> Model:
    """Learn from (id, label, places, shares)."""
    if not rows:
        return Model(np.ones(DIM), np.zeros((DIM, LATENT)), np.zeros((0, LATENT)), np.zeros(0), np.zeros(0))
    full = np.zeros((len(rows), DIM))
    for i, (_, _, where, part) in enumerate(rows):
        full[i, where] = np.sqrt(part)
    idf = np.log(1 + len(rows) / np.maximum((full > 0).sum(axis=0), 1))
    model = Model(idf, main_axes(full * idf), np.zeros((0, LATENT)), np.array([float(r[1] == 1) for r in rows]), np.array([1 / share[r[1]] for r in rows]))
    model.vectors = model.project([(r[2], r[3]) for r in rows])
    return model


def fit(docs: DataFrame, truth: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model:
    """Learn from ``truth`` (id, label 0 or 1) and the texts of its documents."""
    chosen, share = sample(truth, per_class)
    return train(sparse_features(docs, chosen, features, id_col, text_col, most_chars), share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("quality")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores([t.as_py() or "" for t in b.column(1)]), pa.float64())], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def fit_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learn from the table of labels, but for the fifth of the ids that is held out."""
    truth = labels(spark, sf_dir).filter(remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return fit(docs, truth)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = score(docs, fit_labels(spark, docs, sf_dir))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score from ``least`` on; all columns stay. Rows are filtered where they are."""
    ship(docs.sparkSession)
    shared, place, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("quality")
        for b in batches:
            good = shared.value.scores([t.as_py() or "" for t in b.column(place).cast(pa.string())]) >= least
            if good.any():
                yield b.filter(pa.array(good))

    return docs.mapInArrow(run, schema)


QUERIES = {"op5_quality": (op5_quality, None)}
