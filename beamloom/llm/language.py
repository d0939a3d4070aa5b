"""Language identification: averaged hashed subword embeddings with a linear softmax.

The lower-cased text's UTF-8 bytes give n-grams of 2, 3 and 4 bytes (white space included, so word ends count), hashed
to ``BUCKETS`` rows of an embedding. A document is the mean of its rows; a linear softmax scores the languages. Both
are trained by stochastic gradient descent in numpy on a bounded sample (``PER_CLASS`` texts of each language, fewer
where there are many languages but one at least, of at most ``MOST_CHARS`` characters each). As the model is linear, embedding and softmax
are multiplied once into one table of buckets by languages where there are at most ``DIM`` languages; with more, both go
to the executors. So the model has at most ``DIM * (BUCKETS + languages)`` numbers, whatever the corpus.

Calibration: every fifth text of the shuffled sample is not used in training. These fix the temperature of the softmax,
and the score below which a prediction is marked ``rejected`` (as ``REJECT`` of correct predictions there are).

Cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and rejected. Whole texts are
read. If no row is labelled, every document is ``und``. Equal scores go to the label that sorts first. Documents of one
text get one prediction, and rows that repeat an id a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import documents
from .learn import MOST_CHARS, first_by_hash, remainder, sparse_features

BUCKETS, DIM, GRAMS = 1 << 16, 12, (2, 3, 4)
PER_CLASS = 500  # labelled documents of each language that are learned from
EPOCHS, RATE, SEED, REJECT = 4, 0.6, 5, 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = max(GRAMS) - 1
_PIECE = 1 << 20  # bytes worked on at a time


def _buckets(data: np.ndarray, n: int, length: int) -> np.ndarray:
    """Bucket (from 1) of the n-gram at each of the first ``length`` places."""
    h = np.full(length, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ data[k : k + length]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1) + 1


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace") + bytes(_PAD), np.uint8).astype(np.uint32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and the share of its n-grams in each."""
    data = _bytes(text)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data) - _PAD, _PIECE):
        piece = data[start : start + _PIECE + _PAD]
        for n in GRAMS:
            counts += np.bincount(_buckets(piece, n, len(piece) - _PAD), minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where, counts[where] / max(1, counts.sum())


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS by labels, or by DIM
    top: np.ndarray | None  # DIM by labels, where the table is not multiplied with it
    bias: np.ndarray
    temperature: float
    reject: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Scores of each text: its n-grams' mean table row."""
        wide = self.table.shape[1]
        out = np.zeros((len(texts), wide))
        i = 0
        while i < len(texts):
            parts, size, j = [], 0, i
            while j < len(texts) and (j == i or size < _PIECE):
                parts.append(_bytes(texts[j]))
                size += len(parts[-1])
                j += 1
            if j == i + 1 and size > _PIECE:
                where, share = features(texts[i])
                out[i] = share @ self.table[where]
            else:
                data = np.concatenate(parts)
                lengths = np.array([len(p) for p in parts])
                ends = np.cumsum(lengths)
                total = np.zeros((len(data) - _PAD, wide), np.float32)
                for n in GRAMS:
                    total += self.table[_buckets(data, n, len(data) - _PAD)]
                pads = (ends[:-1, None] - np.arange(1, _PAD + 1)).ravel()
                total[pads] = 0  # n-grams that begin behind a text belong to none
                sums = np.add.reduceat(total, ends - lengths, axis=0, dtype=np.float64) if len(total) else np.zeros((len(parts), wide))
                out[i:j] = sums / (np.maximum(lengths - _PAD, 1) * len(GRAMS))[:, None]
            i = j
        return out if self.top is None else out @ self.top


def train(rows: list[tuple]) -> Model | None:
    """Learn from (id, label, buckets, shares)."""
    labels = sorted({r[1] for r in rows})
    if not labels:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    kept_out = np.arange(len(rows)) % 5 == 4
    held, used = order[kept_out], order[~kept_out]
    emb, top, bias = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32), np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    place = {x: k for k, x in enumerate(labels)}
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(used):
            _, label, where, share = rows[r]
            if not len(where):
                continue
            rate = RATE * (1 - done / steps)
            done += 1
            h = share @ emb[where]
            z = h @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[place[label]] -= 1
            back = top @ p
            top -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            emb[where] -= rate * 20 * share[:, None] * back  # shares are small: embeddings take longer steps
    few = len(labels) <= DIM
    model = Model(labels, (emb @ top).astype(np.float32) if few else emb, None if few else top, bias.astype(np.float64), 1.0, 0.0)
    if not len(held):
        return model
    logits = np.array([rows[r][3] @ model.table[rows[r][2]] for r in held])
    logits = logits if few else logits @ top
    truth = np.array([place[rows[r][1]] for r in held])
    best = None
    for t in np.geomspace(0.05, 5, 41):
        model.temperature = float(t)
        p = model.probabilities(logits)
        loss = -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    p = model.probabilities(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    model.reject = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Model | None:
    """Learn from the rows of ``docs`` with a label and a text of at most ``most_chars`` characters."""
    short = docs.filter(F.length(F.col(f"`{text_col}`").cast("string")) <= most_chars)
    chosen = first_by_hash(short.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")), per_class)
    return train(sparse_features(short, chosen, features, id_col, text_col, most_chars))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, lang_pred, score, rejected."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS, DIM and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            known = np.array([m is not None and bool(_LETTER.search(t)) for t in texts], bool)
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                p = m.probabilities(m.logits([t for t, k in zip(texts, known, strict=True) if k]))
                names[known] = np.array(m.labels, object)[p.argmax(axis=1)]
                score[known] = p.max(axis=1)
            rejected = ~known | (score < (m.reject if m else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": (op3_language_id, None)}
