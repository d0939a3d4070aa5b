"""Spelling variants: words of a vocabulary at edit distance one, found by a trie self-join with active nodes.

A node of a trie is active for another one when their strings are at most one edit apart. The active nodes of a child
follow from those of its parent, so walking down the trie once gives, at each word's end, all words near it; no pair is
compared that doesn't share such a path.

The vocabulary is partitioned by prefixes. Two near words whose shorter one has m letters share the first m // 2 letters
or the last m - m // 2, whatever the edit. So a word of m letters stands in the tries (m, first half) and (m, last half),
and, since its partner may be shorter, in those for m - 1. A trie that would hold more than ``MOST_LETTERS`` letters is
partitioned again in the same way, by halves of what its words don't share yet, until it is small or one letter is left;
then there are at most as many words as pairs of letters. Each pair has exactly one trie that reports it: where a half was
chosen by its end, words that share the beginning as well are left to the trie of the beginning (``below``).

Words are counted where they stand, before any shuffle. A trie's words lie together, sorted, in a partition of many
tries; a worker holds one trie at a time. Each word's near words come out of a trie already counted, with the best of
them, and are summed up by word. A form is at least twice as frequent as its word, so chains of forms have no circles
and at most log2(n) steps; roots are found by doubling the steps, in a table written each time.

Cases: null and empty texts have no words. A null id counts as the empty string in the hash. Repeated rows count each
time. Runs of any length are words; of ties in n the smallest word in code-point order is the form. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents, tied, whole_text

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO = 5, 3, 2, 97
#: Letters that the tries' words don't share, in one trie.
MOST_LETTERS = 60_000
_NO_LIMIT = 2**31 - 1
_TRIE = ["hash", "m", "first", "last", "below"]
_NEAR = "word string, n_near bigint, near_n bigint, near_word string"


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters, lower-cased from A to Z, with the letter deleted that a hash of (id, run) names.

    Runs of fewer than ``LEAST_LETTERS`` letters can't become words and aren't read.
    """
    runs = F.regexp_extract_all(whole_text(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _halves(first: Column, last: Column, below: Column) -> Column:
    """The two ways to share half of the ``m - first - last`` letters that aren't shared yet."""
    half = F.floor((F.col("m") - first - last) / 2).cast("int")
    begin = F.struct((first + half).alias("first"), last.alias("last"), below.alias("below"))
    end = F.struct(first.alias("first"), (F.col("m") - first - half).cast("int").alias("last"), F.least(below, first + half).alias("below"))
    return F.array(begin, end)


def _split(rows: DataFrame, first: Column, last: Column, below: Column) -> DataFrame:
    rows = rows.withColumn("part", F.explode(_halves(first, last, below))).select("word", "n", "m", "part.first", "part.last", "part.below")
    shared = F.xxhash64("m", "first", "last", "below", F.substring(F.col("word"), F.lit(1), F.col("first")), F.substring(F.col("word"), F.length("word") - F.col("last") + 1, F.col("last")))
    return rows.withColumn("hash", shared)


def tries(words: DataFrame, scratch: Scratch, most_letters: int = MOST_LETTERS) -> DataFrame:
    """(word, n, m, first, last, below, hash): each word in each trie where it may meet a near one.

    A trie is of words of m and m + 1 letters that share the first ``first`` and the last ``last`` letters.
    """
    length = F.length("word")
    both = F.filter(F.array(length, length - 1), lambda m: m >= LEAST_LETTERS)
    zero = F.lit(0)
    small, rows = None, _split(words.select("word", "n", F.explode(both).alias("m")), zero, zero, F.lit(_NO_LIMIT))
    while True:
        own = F.col("m") - F.col("first") - F.col("last")
        large = rows.groupBy(*_TRIE).agg(F.sum(F.length("word") - F.col("first") - F.col("last")).alias("letters")).filter((F.col("letters") > most_letters) & (own > 1)).select(*_TRIE)
        large = scratch.table(large, "large")
        if large.isEmpty():
            return rows if small is None else small.unionByName(rows)
        fine = rows.join(large, _TRIE, "left_anti")
        small = fine if small is None else small.unionByName(fine)
        rows = scratch.table(_split(rows.join(large, _TRIE, "left_semi"), F.col("first"), F.col("last"), F.col("below")), "split")


def near_in_trie(words: list[tuple[str, int]], m: int, first: int, last: int, below: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, number of near words, n of the best, the best) within one trie, by active nodes.

    Pairs of two longer words belong to the trie of m + 1. Pairs that share ``below`` letters or more are others'.
    """
    kids: list[dict[str, int]] = [{}]
    at_end: dict[int, tuple[str, int]] = {}
    for word, n in words:
        node = 0
        for c in word[first : len(word) - last]:
            child = kids[node].get(c)
            if child is None:
                child = kids[node][c] = len(kids)
                kids.append({})
            node = child
        at_end[node] = word, n
    stack = [(0, {0: 0} | dict.fromkeys(kids[0].values(), 1))]
    while stack:
        node, active = stack.pop()
        if node in at_end:
            word, n = at_end[node]
            count, best = 0, None
            for other, distance in active.items():
                if distance and other in at_end:
                    w, k = at_end[other]
                    if len(w) + len(word) < 2 * m + 2 and w[:below] != word[:below]:
                        count += 1
                        best = min(best, (-k, w)) if best else (-k, w)
            if count:
                yield word, count, -best[0], best[1]
        for c, child in kids[node].items():
            mine: dict[int, int] = {}
            for v, distance in active.items():
                for x, w in kids[v].items():
                    d = distance + (x != c)
                    if d < mine.get(w, 2):
                        mine[w] = d
                if not distance:
                    mine.setdefault(v, 1)
            for v in [v for v, d in mine.items() if not d]:
                for w in kids[v].values():
                    mine.setdefault(w, 1)
            stack.append((child, mine))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near words in every trie of a partition, whose rows are sorted by trie."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def flush() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near_word"])

    out: list[tuple] = []
    for (_, m, first, last, below), group in groupby(rows(), itemgetter(0, 1, 2, 3, 4)):
        shared: dict[tuple[str, str], list[tuple[str, int]]] = {}  # the hash may stand for two tries
        for *_, word, n in group:
            shared.setdefault((word[:first], word[len(word) - last :]), []).append((word, n))
        for words in shared.values():
            if len(words) > 1:
                out += near_in_trie(words, m, first, last, below)
                if len(out) >= 10_000:
                    yield flush()
                    out.clear()
    if out:
        yield flush()


def near_words(words: DataFrame, scratch: Scratch, most_letters: int = MOST_LETTERS) -> DataFrame:
    """(word, n_near, near_n, near_word) of the words that have near ones; near_word is the one of largest n."""
    placed = tries(words, scratch, most_letters).select(*_TRIE, "word", "n").repartition("hash").sortWithinPartitions(*_TRIE)
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near_word").alias("w")))
    found = placed.mapInArrow(_near, _NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.k")).alias("near_n"), F.col("best.w").alias("near_word"))


def roots(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``words`` (word, form, ...) with the last word that its forms lead to; the word itself where there is none."""
    steps = scratch.table(words.filter("form is not null").select("word", F.col("form").alias("up")), "steps")
    while True:
        beyond = steps.select(F.col("word").alias("up"), F.col("up").alias("next"))
        longer = scratch.table(steps.join(beyond, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = longer.select("word", "up")
        if longer.filter("moved").isEmpty():
            return words.join(steps, "word", "left").withColumn("root", F.coalesce("up", "word")).drop("up")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_letters: int = MOST_LETTERS) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.table(words_of(docs, id_col, text_col).filter(F.col("n") >= LEAST_COUNT), "words")
    near = near_words(words, scratch, most_letters)
    known = words.join(near, "word", "left")
    common = F.col("near_n") >= RATIO * F.col("n")
    known = known.select("word", F.when(common, F.col("near_word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(common, F.col("near_n")).alias("form_n"))
    known = scratch.table(known, "near")
    return tied(roots(known, scratch).select("word", "form", "root", "n", "n_near", "form_n"), scratch)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


#: Words by crc32 written out, near words by strings with one letter masked or deleted, roots by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS step FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{5,}}')) AS raw FROM documents),
lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(raw, '{ascii_uppercase}', '{ascii_lowercase}') AS id_run, translate(raw, '{ascii_uppercase}', '{ascii_lowercase}') AS run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT run, k, hex(encode(id_run)) AS h FROM lowered),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
                     lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS hash
  FROM bytes, crc),
written AS (SELECT CASE WHEN hash % 97 = 0 THEN substr(run, 1, CAST(hash % length(run) AS BIGINT)) || substr(run, CAST(hash % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
masked AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
shorter AS (SELECT DISTINCT m.word, m.n, v.word AS other, v.n AS other_n FROM masked m JOIN vocabulary v ON v.word = m.head || m.tail),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, CASE WHEN top_n >= 2 * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS leaf, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chains c JOIN forms f ON f.word = c.leaf WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(leaf, depth) AS root FROM chains GROUP BY word) USING (word)
"""

QUERIES = {"op12_spelling_variants": (op12_spelling_variants, ORACLE_SQL)}
