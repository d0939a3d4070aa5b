"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; then adjacent
pairs of numbers are sorted and numbered again, level by level, until one number is left for each document. At each
level equal numbers mean equal content, so (level, number) identifies a text without collisions.

Blocks meet once, as bytes, when they are made distinct. To give each occurrence its number, it is joined by a digest;
digests that two different blocks share are found on the way and those occurrences are joined by their bytes, so the
digest is a route and never a proof. Numbers come from sorting within hash partitions and are unique over all of them.

Nothing gathers a group: distinct() and the group counts combine before the shuffle, and joins of occurrences with
their names or groups are plain sort-merge joins that adaptive execution can split at a hot key.

Cases: null text counts as empty, and all empty texts form one group. Of a group, the row with the largest id stays;
null ids come last. Rows that repeat an id are rows of their own, and of equal ids exactly one stays. Very long texts are
so many blocks, none is left out. Names depend on how rows are partitioned; which names are equal doesn't. An empty table
gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents, keyed, tied, whole_text

BLOCK_BYTES = 8192
_NONE = -(2**63)  # stands for the missing right half of an odd pair


def _digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _blocks(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    return docs.select("key", F.encode(whole_text(text_col), "UTF-8").alias("bytes")).withColumn("n", F.greatest(F.ceil(F.octet_length("bytes") / size), F.lit(1)).cast("int"))


def _cut(size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))


def name_texts(docs: DataFrame, scratch: Scratch, key: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """(key, level, name) of every row of ``docs``: equal (level, name) exactly for equal texts."""
    base = _blocks(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias(text_col)), text_col, block_bytes)
    occ = scratch.table(base.select("key", "n", F.transform(_cut(block_bytes), digest).alias("d")), "digests")
    texts = base.select("key", "n", F.posexplode(_cut(block_bytes)).alias("pos", "block"))
    distinct = texts.select("block").distinct().withColumn("d", digest(F.col("block")))
    names = scratch.table(distinct.sortWithinPartitions("d", "block").select("d", F.monotonically_increasing_id().alias("name")), "blocks")
    shared = names.groupBy("d").count().filter("count > 1").select("d")
    spread = occ.select("key", "n", F.posexplode("d").alias("pos", "d"))
    if shared.limit(1).collect():  # different blocks with one digest: these are joined by their bytes
        shared = scratch.table(shared, "shared")
        own = distinct.join(shared, "d", "left_semi").sortWithinPartitions("d", "block").select("d", "block", (-1 - F.monotonically_increasing_id()).alias("name"))
        own = scratch.table(own, "own")
        exact = texts.withColumn("d", digest(F.col("block"))).join(own, ["d", "block"]).select("key", "n", "pos", "name")
        current = spread.join(names.join(shared, "d", "left_anti"), "d").select("key", "n", "pos", "name").unionByName(exact)
    else:
        current = spread.join(names, "d").select("key", "n", "pos", "name")
    current = scratch.table(current, "level0")
    done = current.filter("n = 1").select("key", F.lit(0).alias("level"), "name")
    most, level = current.agg(F.max("n")).first()[0] or 1, 0
    while most > 2**level:
        level += 1
        odd = F.col("pos") % 2 == 1
        pairs = current.filter(f"n > {2 ** (level - 1)}").groupBy("key", "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.max(F.when(~odd, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(_NONE)).alias("r"))
        pairs = scratch.table(pairs, f"pairs{level}")
        numbers = scratch.table(pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id()), f"names{level}")
        current = scratch.table(pairs.join(numbers, ["l", "r"]).select("key", "n", "pos", "name"), f"level{level}")
        done = done.unionByName(current.filter(f"n <= {2**level}").select("key", F.lit(level).alias("level"), "name"))
    return done


def _decide(rows: DataFrame, key: str, scratch: Scratch, id_col: str, text_col: str, **more) -> DataFrame:
    named = scratch.table(name_texts(rows, scratch, key, text_col, **more), "named")
    light = rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id"), F.sha2(F.encode(whole_text(text_col), "UTF-8"), 256).alias("sha"))
    light = scratch.table(light.join(named, "key"), "rows")
    groups = scratch.table(light.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.col("id").isNotNull().alias("is"), "id", "key")).alias("top")), "groups")
    return light.join(groups, ["level", "name"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, text_level, text_name."""
    scratch = Scratch(docs.sparkSession)
    rows = _decide(*keyed(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", scratch), scratch, "id", "text", **more)
    out = rows.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("size").cast("bigint").alias("group_size"), (F.col("key") == F.col("top.key")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("level").alias("text_level"), F.col("name").alias("text_name"))
    return tied(out, scratch)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay as they are."""
    scratch = Scratch(docs.sparkSession)
    rows, key = keyed(docs, id_col, scratch)
    kept = _decide(rows, key, scratch, id_col, text_col, **more).filter("key = top.key").select(F.col("key").alias(key))
    return tied(rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]), scratch)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op10_exact_dedup": (op10_exact_dedup, ORACLE_SQL)}
