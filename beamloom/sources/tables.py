"""Plan and acquisition views over the star-schema tables, for queries and benchmarks.

Parts are plan spots, 500 to an acquisition; line items are the samples of their part's spot. Everything is arithmetic
on keys, and the only order that is needed, that of the samples within an acquisition, is a window over acq_id. So the
views scale with the number of acquisitions. The same views in SQL are ``PLAN_SQL`` and ``ACQ_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partitions import spread

SPOTS = 500  # of an acquisition

PLAN_SQL = f"""SELECT CAST(floor(p_partkey / {SPOTS}) AS BIGINT) AS acq_id, p_partkey % {SPOTS} AS spot_idx,
  CAST(p_partkey % 5 AS DOUBLE) * CAST(5 AS DOUBLE) - CAST(10 AS DOUBLE) AS x,
  CAST(floor((p_partkey % 25) / 5) AS DOUBLE) * CAST(5 AS DOUBLE) - CAST(10 AS DOUBLE) AS y,
  CAST(230 AS DOUBLE) - CAST(7.5 AS DOUBLE) * CAST(floor((p_partkey % {SPOTS}) / 25) AS DOUBLE) AS energy, p_retailprice AS mu,
  CASE WHEN p_size % 7 <> 0 THEN CAST(3 AS DOUBLE) + CAST(p_size AS DOUBLE) / CAST(10 AS DOUBLE) END AS fwhm_x,
  CASE WHEN p_size % 7 <> 0 THEN CAST(4 AS DOUBLE) + CAST(p_size AS DOUBLE) / CAST(20 AS DOUBLE) END AS fwhm_y FROM part"""

_ACQ = f"CAST(floor(l_partkey / {SPOTS}) AS BIGINT)"
_CELLS = f"""CASE WHEN l_linenumber <> 7 THEN CAST(floor((l_partkey % 25) / 5) AS DOUBLE) * CAST(5 AS DOUBLE) - CAST(10 AS DOUBLE) + (l_discount - CAST(0.05 AS DOUBLE)) * CAST(60 AS DOUBLE) END AS a,
  CASE WHEN l_linenumber <> 6 THEN CAST(l_partkey % 5 AS DOUBLE) * CAST(5 AS DOUBLE) - CAST(10 AS DOUBLE) + (l_tax - CAST(0.04 AS DOUBLE)) * CAST(60 AS DOUBLE) END AS b,
  l_quantity AS channel, l_extendedprice / CAST(1000 AS DOUBLE) AS fit_a, l_extendedprice / CAST(2000 AS DOUBLE) AS fit_b,
  CAST(1 AS DOUBLE) + l_discount * CAST(10 AS DOUBLE) AS sigma_a, CASE WHEN l_linenumber <> 5 THEN CAST(1 AS DOUBLE) + l_tax * CAST(10 AS DOUBLE) END AS sigma_b,
  CAST(2 * (l_partkey % {SPOTS}) + 1 AS INTEGER) AS gate FROM lineitem"""

#: The samples of a spot without their order, so that files of them can be read as they come.
SAMPLE_SQL = f"SELECT {_ACQ} AS acq_id, {_CELLS}"

ACQ_SQL = f"""SELECT acq_id, row_idx, CAST(row_idx AS DOUBLE) * CAST(0.001 AS DOUBLE) + CAST(spot AS DOUBLE) * CAST(0.5 AS DOUBLE) AS t, a, b, channel, fit_a, fit_b, sigma_a, sigma_b, gate, spot
FROM (SELECT {_ACQ} AS acq_id, l_partkey % {SPOTS} AS spot,
  CAST(row_number() OVER (PARTITION BY {_ACQ} ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS BIGINT) - 1 AS row_idx,
  {_CELLS})"""


def _over(source: DataFrame, table: str, sql: str) -> DataFrame:
    return source.sparkSession.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=source)


def plans_of(part: DataFrame) -> DataFrame:
    return _over(part, "part", PLAN_SQL)


def acquisitions_of(lineitem: DataFrame) -> DataFrame:
    return _over(spread(lineitem, F.expr(_ACQ)), "lineitem", ACQ_SQL)


def samples_of(lineitem: DataFrame) -> DataFrame:
    """Samples without row numbers, of a table or a stream."""
    return _over(lineitem, "lineitem", SAMPLE_SQL)


def plan_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans_of(spark.read.parquet(f"{sf_dir}/part.parquet"))


def acquisition_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisitions_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
