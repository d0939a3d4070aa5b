"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each named source has a target share of the mixed text; all other sources (null too) form one group with its own
share. A group's mean repetition rate is ``ratio * all characters * share / its characters``. Each document is
repeated as often as the inverse of the Poisson distribution function at a number hashed from the seed and its id
says, so the result is the same in every run and for every partitioning. The copies are then sorted by a hashed
number, which shuffles them globally.

Sizes: the rates are a table of one row for each named source and one more, so it is bounded by the parameters and
joined by broadcast; a hot source therefore costs no shuffle of its own. Only the final sort moves texts. A rate
beyond ``CHUNK`` is split into equal parts whose counts are drawn one by one and added up, so no rate is capped.

Cases: null text counts as empty and still gets copies. A source without characters gets the rate ``ratio``. A source
with weight 0 disappears. Rows that repeat an id get equal counts. Null ids are drawn as the word "null". Input
columns named like an added one are renamed with the suffix ``_input``. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, free_name, plain_name, whole_text

CHUNK = 64.0  # the largest mean that one number is inverted for
#: Target shares of the production mix; OTHER holds for every source that is not named.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.10, "src4": 0.10, "src5": 0.05, "src6": 0.05, "src7": 0.05, "src8": 0.05, "src9": 0.05}
OTHER, RATIO, SEED = 0.20, 1.0, "mix-1"


def poisson_cdf(mean: float) -> list[float]:
    """Values of the distribution function from 0 on, until it reaches 1 in double precision."""
    out, total, i = [], 0.0, 0
    while i <= mean or total < 1.0 - 2.0**-52:
        p = math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) if mean > 0 else float(i == 0)
        total += p
        out.append(total)
        if i > mean and p < 1e-18:
            break
        i += 1
    return out


def _unit(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))


def rates(docs: DataFrame, weights: dict[str, float], other: float, ratio: float, source_col: str = "source", text_col: str = "text") -> dict[str | None, float]:
    """Mean repetition rate of each named source and, under None, of all others together."""
    group = F.when(F.col(f"`{source_col}`").isin(list(weights)), F.col(f"`{source_col}`"))
    found = {r["g"]: r["c"] for r in docs.groupBy(group.alias("g")).agg(F.sum(F.length(whole_text(text_col))).alias("c")).collect()}
    shares = {g: w for g, w in [*weights.items(), (None, other)] if found.get(g)}
    whole, total = sum(shares.values()), sum(found.values())
    return {g: (ratio * total * (w / whole) / found[g] if whole and found.get(g) else ratio) for g, w in [*weights.items(), (None, other)]}


def poisson_mix(
    docs: DataFrame, weights: dict[str, float], other: float = 0.0, ratio: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, repeated, with copy (from 1) and shuffle_key (the global order; rows come sorted by it)."""
    if any(w < 0 for w in [*weights.values(), other]) or ratio < 0:
        raise ValueError("weights and ratio must not be negative")
    spark, means = docs.sparkSession, rates(docs, weights, other, ratio, source_col, text_col)
    parts = {g: max(1, math.ceil(m / CHUNK)) for g, m in means.items()}
    table = spark.createDataFrame([(g is None, g, parts[g], poisson_cdf(m / parts[g])) for g, m in means.items()], "rest boolean, source string, parts int, cdf array<double>")
    docs = plain_name(docs, "copy", "shuffle_key")
    rate, n = free_name(docs, "rate"), free_name(docs, "n")
    table = table.select("rest", "source", F.struct("parts", "cdf").alias(rate))
    source = docs[f"`{source_col}`"]
    named = F.coalesce(source.isin(list(weights)), F.lit(False))
    same = (~named == table["rest"]) & F.when(named, source).eqNullSafe(table["source"])
    columns = [docs[f"`{c}`"] for c in docs.columns]
    rows = docs.join(F.broadcast(table), same).select(*columns, rate)
    below = lambda j: F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= _unit(seed, "n", _id(id_col), j.cast("string"))))
    rows = rows.withColumn(n, F.aggregate(F.sequence(F.lit(1), F.col(rate)["parts"]), F.lit(0), lambda a, j: a + below(j)))
    rows = rows.filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("o"), _id(id_col), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("bigint")
    return rows.withColumn("shuffle_key", key).select(*[F.col(f"`{c}`") for c in docs.columns], "copy", "shuffle_key").orderBy("shuffle_key", "copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(documents(spark, sf_dir), WEIGHTS, OTHER, RATIO, SEED)


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` mixed by the production weights, with no column added."""
    return poisson_mix(docs, WEIGHTS, OTHER, RATIO, SEED).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = f"""
WITH w(g, w) AS (VALUES {", ".join(f"('{g}', CAST({x} AS DOUBLE))" for g, x in WEIGHTS.items())}, (NULL, CAST({OTHER} AS DOUBLE))),
d AS (SELECT *, CASE WHEN source IN ({", ".join(f"'{g}'" for g in WEIGHTS)}) THEN source END AS g FROM documents),
n AS (SELECT g, sum(length(coalesce(text, ''))) AS c FROM d GROUP BY g),
m AS (SELECT w.g, CASE WHEN n.c > 0 THEN CAST({RATIO} AS DOUBLE) * (SELECT sum(c) FROM n) * (w.w / (SELECT sum(w.w) FROM w JOIN n ON w.g IS NOT DISTINCT FROM n.g WHERE n.c > 0)) / n.c
        ELSE CAST({RATIO} AS DOUBLE) END AS mean FROM w LEFT JOIN n ON w.g IS NOT DISTINCT FROM n.g),
p AS (SELECT m.g, i, sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) OVER (PARTITION BY m.g ORDER BY i) AS cdf FROM m, range(0, 200) t(i) WHERE mean > 0),
k AS (SELECT doc_id, d.g, CAST('0x' || substr(md5(concat_ws('|', '{SEED}', 'n', coalesce(CAST(doc_id AS VARCHAR), 'null'), '1')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM d),
c AS (SELECT k.doc_id, count(*) AS n FROM k JOIN p ON k.g IS NOT DISTINCT FROM p.g AND p.cdf <= k.u GROUP BY k.doc_id)
SELECT documents.*, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5(concat_ws('|', '{SEED}', 'o', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(copy AS VARCHAR))), 1, 15) AS BIGINT) AS shuffle_key
FROM documents JOIN c USING (doc_id), LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""

QUERIES = {"op8_mixing": (op8_mixing, ORACLE_SQL)}
