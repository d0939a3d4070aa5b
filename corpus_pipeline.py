"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``, whatever they are. Between stages the rows are written as Parquet and read again, so a lost executor
costs one stage's tasks at most; the tables that a stage wrote for itself are deleted then.

Cases, for every stage: null text counts as empty. Empty texts are scored like any other, are one group of exact copies,
and become sequences of one end token. Null ids are kept; rows that repeat an id are rows of their own (equal ones are
exact copies). Nulls in other columns don't matter. Columns named like one that a stage uses inside stay as they are. Very
long texts are read whole; the last stage cuts them. Of equal texts the largest id stays, and of near ones the first row by
id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamloom.llm._shared import Scratch, documents, release, tied
from beamloom.llm.exact_dedup import drop_exact_copies
from beamloom.llm.mixing import mix_documents
from beamloom.llm.near_dedup import drop_near_copies
from beamloom.llm.packing import pack
from beamloom.llm.quality import fit_labels, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 5)."""
    return keep_good(docs, fit_labels(spark, docs, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id (operator 10)."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the row with the smallest doc_id (operator 1)."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources and shuffled (operator 8)."""
    return mix_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens (operator 7)."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]

#: A classifier trained in numpy decides in the first stage, which SQL cannot express; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = scratch.table(made, name)
        release(made)  # the stage's own tables
    return tied(STAGES[-1][1](spark, docs, sf_dir), scratch)
