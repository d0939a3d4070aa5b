"""Near-duplicate detection: BagMinHash signatures, banding, verification of the multiset overlap.

A text is the multiset of its shingles of ``SHINGLE`` words (lower case, letters and digits; a shorter text is one
shingle). The similarity of two texts is the weighted Jaccard index of their multisets: sum of minima by sum of maxima.

BagMinHash: a shingle with count n owns the weights [0, n), cut at the discrete levels 0, 1, 2, 4, 8, ... Each level is
a Poisson process of points with a rate of its width; each point has a time, one of ``BANDS * ROWS`` signature places,
and a weight within the level, and counts only below n, so a level that n cuts through keeps the part below it. A place
of the signature is the earliest time of its points. Two texts agree at a place with the probability of their
similarity. Points come in the order of time, and a process ends once it is later than all places, so a signature
takes about as many points as there are shingles plus places * ln(places). Times are whole numbers, so they are equal
wherever they are computed.

Bands of ``ROWS`` places make buckets. In a bucket, each member is compared with one hub, the member whose buckets hold
the most documents, instead of with all others: the centre of a family collides most. Compared means: the exact overlap
of the two texts' multisets. Verified links give components.

What is left is settled exactly. For members x and y of one hub c, overlap(x, y) is at most the lower of their overlaps
with c, plus what they share beyond c. So a pair of different components can only be similar if (A) the lower overlap
alone reaches what their total weights ask for, which is looked up by the few pairs (weight, overlap) of a hub's members,
or (B) they share shingles that c hasn't. A hub's shingles beyond c that members of different components hold are
counted first. A member of weight w and overlap o with fewer than 0.8 w - o of them is done. The others put theirs in the
order of their counts, the rarest first; the first shingle that a similar pair shares leaves both enough that follow.
So a passage or line that many texts share stands last, where too little follows it, and makes no pairs. (Texts that are put
together from the same few blocks, each pair of them similar to a little less than 0.8, are another matter: no bound rules
their pairs out, so all of them are compared, and these grow with the square of such a family.) Members that share a shingle early enough are compared, first with one of them for each shingle, and, where that has not made them one
component, with each other. Before that, whatever was compared with a member of a component is compared with its centre
too, and a pair is looked at only below the largest hub of both, if that is the same one: the bounds are tight there. So
every pair of a common bucket is linked, joined by others, or known to be dissimilar.

With 28 bands of 6 places, a pair of similarity 0.8 shares a bucket with a probability of 0.9998, of 0.85 of 1 - 2e-6.

Shuffles: equal word sequences are one class from the start, and only its first document goes on, so copies cost
nothing. Bucket sizes and hubs are combined before the shuffle; joins of members with their hubs and of pairs with their
texts are plain sort-merge joins, which adaptive execution can split. Texts outside all pairs are ruled out once, by a
Bloom filter sized by the number of texts in pairs, and the others are written once for all rounds of comparisons. Components: minimum labels with hooking and pointer jumping, in tables
written to the shared folder.

Cases: texts without words (null, empty, marks only) are near-duplicates of equal texts only. Rows that repeat an id are
rows of their own; the class id is the smallest id of the class. Classes of equal size or hubs of equal degree are told
apart by the smaller key. Very long texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bloom
from ._shared import Scratch, documents, keeps, keyed, task_of, tied

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 6
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_TIME = float(1 << 32)
_KEPT = 250_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_HASHES = _Hashes()
keeps("words", _HASHES.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def bag(words: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles, ascending, and their counts."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = min(shingle, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total = total * _P + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(total), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two bags."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], places: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signature of each bag (none of them empty)."""
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    shingle, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    parts = [(doc, shingle, np.zeros(len(doc), np.int64), count)]
    level = 1
    while True:  # level j > 0 covers [2^(j-1), 2^j)
        more = count > 1 << (level - 1)
        if not more.any():
            break
        parts.append((doc[more], shingle[more], np.full(int(more.sum()), level), count[more]))
        level += 1
    doc, shingle, level, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    shift = np.maximum(level - 1, 0)  # the width is 2^shift
    seed = _mix(shingle ^ (level.astype(np.uint64) + np.uint64(1)) * _P)
    best = np.full(len(bags) * places, np.iinfo(np.int64).max, np.int64)
    size = np.bincount(doc, minlength=len(bags))
    time, number = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.uint64)
    active, worst = np.arange(len(doc)), np.full(len(bags), np.iinfo(np.int64).max)
    while len(active):
        d = doc[active]
        take = np.where(worst[d] == np.iinfo(np.int64).max, -(-2 * places // size[d]), 1)
        ends = np.cumsum(take)
        row = np.repeat(np.arange(len(active)), take)
        point = _mix(seed[active][row] + (number[active][row] + (np.arange(len(row)) - np.repeat(ends - take, take)).astype(np.uint64) + np.uint64(1)) * _P)
        wait = (-np.log(((point >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * _TIME).astype(np.int64) >> shift[active][row]
        run = np.cumsum(wait)
        t = time[active][row] + run - np.repeat(np.r_[0, run[ends[:-1] - 1]], take)
        other = _mix(point ^ _P)
        place = ((other >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
        weight = low[active][row] + ((other & np.uint64(0xFFFFFFFF)) >> np.uint64(32) - shift[active][row].astype(np.uint64)).astype(np.int64)
        inside = weight < count[active][row]
        np.minimum.at(best, d[row[inside]] * places + place[inside], t[inside])
        time[active], number[active] = t[ends - 1], number[active] + take.astype(np.uint64)
        worst = best.reshape(len(bags), places).max(axis=1)
        active = active[time[active] < worst[d]]
    return best.reshape(len(bags), places)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    x = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    h = np.broadcast_to(_mix(np.arange(1, bands + 1).astype(np.uint64) * _P), x.shape[:2])
    for k in range(rows):
        h = _mix(h * _P + x[:, :, k])
    return h.view(np.int64)


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("words")
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                keys, classes, weights, bags = part.column(0), [], [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    classes.append(xxhash.xxh3_128_digest("w " + " ".join(words) if words else "t " + (text.as_py() or "")))
                    bags.append(bag(words, shingle))
                    weights.append(int(bags[-1][1].sum()))
                some = [i for i, w in enumerate(weights) if w]
                bands: list = [None] * len(weights)
                if some:
                    for i, row in zip(some, band_keys(signatures([bags[i] for i in some])), strict=True):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([keys, pa.array(classes, pa.binary()), pa.array(weights, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["key", "class", "w", "bands"])

    return run


def beyond(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, np.ndarray]:
    """Overlap of the bags, total weight of b, and the shingles (one for each repetition) that b has beyond a."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    rest = b[1].astype(np.int64).copy()
    low = np.minimum(a[1][i], b[1][j])
    rest[j] -= low
    row = np.repeat(np.arange(len(rest)), rest)
    step = np.arange(len(row)) - np.repeat(np.cumsum(rest) - rest, rest)
    return int(low.sum()), int(b[1].sum()), _mix(b[0][row] + step.astype(np.uint64) * _P)


def _compare(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("words")
        last, bag_a = None, None
        for b in batches:
            keys, sims, overlaps, weights, tokens = b.column(0).to_pylist(), [], [], [], []
            for key, text_a, text_b in zip(keys, b.column(2), b.column(3), strict=True):
                if key != last:
                    last, bag_a = key, bag(words_of(text_a.as_py()), shingle)
                o, w, t = beyond(bag_a, bag(words_of(text_b.as_py()), shingle))
                sims.append(o / (w + int(bag_a[1].sum()) - o))
                overlaps.append(o)
                weights.append(w)
                tokens.append(t.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64()), pa.array(overlaps, pa.int32()), pa.array(weights, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["a", "b", "sim", "o", "w", "tokens"])

    return run


def _only(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) for k in b.column(0).to_pylist()], np.uint64)
            if (found := bloom.hits(bits.value, h)).any():
                yield b.filter(pa.array(found))

    return run


def _texts(rows: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, text) of the rows in pairs (a, b), and of the few others that the filter lets through."""
    needed = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "needed")
    bits = rows.sparkSession.sparkContext.broadcast(bloom.build(needed, F.xxhash64("key")))
    return scratch.table(rows.select("key", "text").mapInArrow(_only(bits), "key bigint, text string"), "texts")


def _verify(texts: DataFrame, pairs: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """(a, b, sim, o, w, tokens) of pairs (a, b): similarity, overlap, weight of b, shingles of b beyond a."""
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return scratch.table(both.mapInArrow(_compare(shingle), "a bigint, b bigint, sim double, o int, w int, tokens array<bigint>"), "sims")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of every document in links (a, b): root is the smallest document that links lead to."""
    edges = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = scratch.table(edges.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root")), "label")
    while True:
        near = edges.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        both = scratch.table(label.join(near, "v"), "both")  # (v, root, near)
        hook = both.groupBy(F.col("root").alias("v")).agg(F.min("near").alias("hook"))
        lower = both.join(hook, "v", "left").select("v", F.least("root", "near", F.coalesce("hook", "root")).alias("root"), F.col("root").alias("was"))
        lower = scratch.table(lower, "lower")
        up = lower.select(F.col("v").alias("root"), F.col("root").alias("up"))
        after = scratch.table(lower.join(up, "root").select("v", F.least("root", "up").alias("root"), "was"), "after")
        label = after.select("v", "root")
        if not after.filter("root <> was").limit(1).collect():
            return label


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (v, root) with more links: only the roots that these join are worked on."""
    root = lambda end: labels.select(F.col("v").alias(end), F.col("root").alias(f"{end}_root"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    ends = scratch.table(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct(), "root_links")
    above = components(ends, scratch)
    known = labels.join(above.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left").select("v", F.coalesce("up", "root").alias("root"))
    new = above.join(labels.select("v"), "v", "left_anti").select("v", "root")
    return scratch.table(known.unionByName(new), "labels")


def _classes(rows: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """(key, root) of rows (key, text): root is the smallest key of the near-duplicate class."""
    described = scratch.table(rows.select("key", "text").mapInArrow(_describe(shingle), "key bigint, class binary, w int, bands array<bigint>"), "described")
    classes = scratch.table(described.groupBy("class").agg(F.min("key").alias("rep")), "classes")
    firsts = scratch.table(described.filter("w > 0").join(classes, "class").filter("key = rep").select("key", "w", "bands"), "firsts")
    members = firsts.select("key", "w", F.explode("bands").alias("bucket"))
    sizes = scratch.table(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    met = scratch.table(members.join(sizes, "bucket"), "met")  # (bucket, key, w, n)
    degree = met.groupBy("key").agg(F.sum("n").alias("degree"))
    hubs = met.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("key")).alias("minus"), "w")).alias("hub"))
    hubs = scratch.table(hubs.select("bucket", (-F.col("hub.minus")).alias("hub")), "hubs")
    pairs = scratch.table(met.join(hubs, "bucket").filter(F.col("key") != F.col("hub")).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    texts = _texts(rows, pairs, scratch)  # later pairs are of the same rows
    sims = _verify(texts, pairs, scratch, shingle)
    labels = components(sims.filter(F.col("sim") >= similarity).select("a", "b"), scratch)
    if (more := _to_centres(met, sims, labels, scratch, similarity)) is not None:
        again = _verify(texts, more, scratch, shingle)
        labels = joined(labels, again.filter(F.col("sim") >= similarity).select("a", "b"), scratch)
        sims = sims.unionByName(again)
    for centres in (True, False):
        more = _unsettled(sims, labels, scratch, similarity, centres)
        if more is not None:
            links = _verify(texts, more, scratch, shingle).filter(F.col("sim") >= similarity).select("a", "b")
            labels = joined(labels, links, scratch)
    roots = described.select("key", "class").join(classes, "class").join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    return scratch.table(roots.select("key", F.coalesce("root", "rep").alias("root")), "roots")


def _to_centres(met: DataFrame, sims: DataFrame, labels: DataFrame, scratch: Scratch, similarity: float) -> DataFrame | None:
    """Pairs (a, b): a component's centre, its member that shares buckets most, and what was compared with its members;
    and, for members that their hub isn't linked to, the largest hub that this hub itself was compared with."""
    degree = met.groupBy("key").agg(F.sum("n").alias("degree"))
    centres = labels.join(degree.withColumnRenamed("key", "v"), "v").groupBy("root").agg(F.max(F.struct("degree", (-F.col("v")).alias("minus"))).alias("top"))
    centres = scratch.table(centres.select("root", (-F.col("top.minus")).alias("centre")), "centres")
    tested = sims.select(F.col("a").alias("v"), F.col("b").alias("key"))
    wanted = tested.join(labels, "v").join(centres, "root").filter("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct()
    sizes = scratch.table(tested.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "hub_sizes")
    above = scratch.table(tested.join(sizes, "v").groupBy("key").agg(F.max(F.struct("n", "v")).alias("top")).select(F.col("key").alias("v"), F.col("top.v").alias("up"), F.col("top.n").alias("up_n")), "above")
    larger = scratch.table(sizes.join(above, "v").filter("up_n > n").select("v", "up"), "larger")
    apart = sims.filter(F.col("sim") < similarity).select(F.col("a").alias("v"), F.col("b").alias("key")).join(larger, "v").filter("key <> up")
    wanted = wanted.unionByName(apart.select(F.col("up").alias("a"), F.col("key").alias("b"))).distinct()
    pairs = scratch.table(wanted.join(sims.select("a", "b"), ["a", "b"], "left_anti"), "centre_pairs")
    return pairs if pairs.limit(1).collect() else None


def _unsettled(sims: DataFrame, labels: DataFrame, scratch: Scratch, similarity: float, centres: bool) -> DataFrame | None:
    """Pairs (a, b) of members of one hub, of two components, that may still be similar and haven't been compared.

    With ``centres``, pairs by shared shingles are only those with one member for each shingle.
    """
    share = similarity / (1 + similarity)  # overlap that a similarity asks for, of the sum of both weights
    members = sims.select(F.col("a").alias("hub"), F.col("b").alias("key"), "w", "o", "tokens").join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    members = scratch.table(members, "members")
    sizes = scratch.table(members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hub_sizes")
    top = members.select("hub", "key").join(sizes, "hub").groupBy("key").agg(F.max(F.struct("n", "hub"))["hub"].alias("top"))
    members = scratch.table(members.join(top, "key"), "members_top")  # top: the key's hub with the most members
    mixed = scratch.table(members.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("hub"), "mixed")
    left, right = [], []
    for side, out in (("1", left), ("2", right)):
        out += [F.col(c).alias(f"{c}{side}") for c in ("key", "w", "o", "root", "top")]
    found = []
    if centres:  # A: by weights and overlaps; equal ones count once
        kinds = scratch.table(members.join(mixed, "hub").groupBy("hub", "w", "o").agg(F.min("root").alias("low"), F.max("root").alias("high")), "kinds")
        x, y = (kinds.select("hub", *[F.col(c).alias(f"{c}{k}") for c in ("w", "o", "low", "high")]) for k in (1, 2))
        reach = F.least("o1", "o2") >= share * (F.col("w1") + F.col("w2")) - 1e-9
        linked = lambda k: F.col(f"o{k}") >= share * F.col(f"w{k}")  # noqa: E731  a weak bound that keeps weak kinds out early
        met = x.filter(linked(1)).join(y.filter(linked(2)), "hub").filter(reach & (F.least("low1", "low2") != F.greatest("high1", "high2"))).select("hub", "w1", "o1", "w2", "o2")
        met = scratch.table(met, "kinds_met")
        m1 = members.select("hub", *left).join(met, ["hub", "w1", "o1"])
        found.append(m1.join(members.select("hub", *right), ["hub", "w2", "o2"]))
    # B: by shingles beyond the hub that members of different components hold
    mine = members.join(mixed, "hub")
    tokens = mine.select("hub", "key", "root", "top", F.explode("tokens").alias("token"))
    held = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("root", "top") for f in (F.min, F.max)])
    held = scratch.table(held.filter("root_min <> root_max and (top_min <> top_max or top_min = hub)").select("hub", "token", "n"), "held")
    mine = mine.select("hub", "key", "w", "o", "root", "top")
    each = Window.partitionBy("hub", "key")
    left_over = F.count(F.lit(1)).over(each) - F.row_number().over(each.orderBy("n", "token")) + 1
    shared = tokens.select("hub", "key", "token").join(held, ["hub", "token"]).withColumn("rest", left_over)  # rest: this one and what follows
    shared = shared.join(mine, ["hub", "key"]).filter(F.col("o") + F.col("rest") >= similarity * F.col("w") - 1e-9)
    shared = scratch.table(shared.select("hub", "token", "key", "w", "o", "root", "top", "rest"), "shared")
    enough = F.least("o1", "o2") + F.least("rest1", "rest2") >= share * (F.col("w1") + F.col("w2")) - 1e-9
    one = shared
    if centres:
        one = shared.groupBy("hub", "token").agg(F.max(F.struct("o", "key", "w", "root", "top", "rest")).alias("x")).select("hub", "token", "x.*")
    else:  # the lighter one of a pair needs more of its own weight, so that fewer of its shingles come early enough
        one = shared.filter(F.col("o") + F.col("rest") >= 2 * share * F.col("w") - 1e-9)
    x, y = (d.select("hub", "token", F.col("rest").alias(f"rest{k}"), *cols) for d, k, cols in ((shared, 1, left), (one, 2, right)))
    met = x.join(y, ["hub", "token"]).filter(enough)
    found.append(met if centres else met.filter((F.col("w1") > F.col("w2")) | (F.col("w1") == F.col("w2")) & (F.col("key1") < F.col("key2"))))
    pairs = None
    for f in found:
        may = F.least("o1", "o2") + F.least(F.col("w1") - F.col("o1"), F.col("w2") - F.col("o2")) >= share * (F.col("w1") + F.col("w2")) - 1e-9
        here = (F.col("top1") != F.col("top2")) | (F.col("top1") == F.col("hub"))  # pairs of one top hub are looked at there
        p = f.filter((F.col("root1") != F.col("root2")) & here & may).select(F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b"))
        pairs = p if pairs is None else pairs.unionByName(p)
    done = sims.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.table(pairs.distinct().join(done, ["a", "b"], "left_anti"), "more_pairs")
    return pairs if pairs.limit(1).collect() else None


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (smallest id of its class), class_size, kept (the class's first row)."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), "id", scratch)[0]
    roots = _classes(rows, scratch, similarity, shingle).join(rows.select("key", "id"), "key")
    roots = scratch.table(roots, "ids")
    sizes = scratch.table(roots.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"), F.min("id").alias("class_id")), "class_sizes")
    out = roots.join(sizes, "root").select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("key") == F.col("root")).alias("kept"))
    return tied(out, scratch)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the first row of each near-duplicate class; all columns stay as they are."""
    scratch = Scratch(docs.sparkSession)
    rows, key = keyed(docs, id_col, scratch)
    plain = rows.select(F.col(key).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = _classes(plain, scratch, similarity, shingle).filter("key = root").select(F.col("key").alias(key))
    return tied(rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]), scratch)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


QUERIES = {"op1_near_dedup": (op1_near_dedup, None)}
