"""Partitions that grow with the input, so that what a task sorts doesn't.

Spark deals a shuffle to a fixed number of partitions, so on larger tables each one is larger. Where rows of an acquisition
are shuffled whole, their number is taken from the size of the files that the rows come from. Small inputs are left to Spark.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 32 << 20  # bytes of files up to which nothing is changed
EACH = 2 << 20  # bytes of files for one partition


def partitions(table: DataFrame) -> int | None:
    """How many partitions the rows of a table need; None for small ones, streams and tables without files."""
    if table.isStreaming or not (files := table.inputFiles()):
        return None
    read = table.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True)  # no partition columns
    size = read.load([unquote(f) for f in files]).agg(F.sum("length")).first()[0] or 0
    return None if size <= SMALL else max(-(-size // EACH), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sorted_beside(table: DataFrame) -> DataFrame:
    """A table of lists that grows with the input, to be joined by sorting. Spark would broadcast it where its files are small,
    and repeated lists are packed so well that a few MB of files fill a GB in every executor and in the driver."""
    return table.hint("merge")


def spread(table: DataFrame, *keys: Column | str, times: int = 1) -> DataFrame:
    """Rows with equal keys together, in as many partitions as their files need; ``times`` as many for rows that were multiplied."""
    n = partitions(table)
    return table.repartition(n * times, *keys) if n else table
