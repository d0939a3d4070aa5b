"""Helpers that every operator of this subpackage uses: shared scratch tables, row keys, text columns."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode, where it is unset, a temporary folder stands in; on a cluster that is an error.
    """
    global _OWN_DIR
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", master := spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} has no folder that its driver and executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="beamloom-")
    return f"file://{_OWN_DIR}"


#: What workers keep between tasks, by operator: functions that forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(name: str, forget: Callable[[], None]) -> None:
    _KEPT[name] = forget


def task_of(name: str) -> None:
    """Called where a task begins: a worker that is used again forgets what other operators kept."""
    for other, forget in _KEPT.items():
        if other != name:
            forget()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Folders that are still in use. What is left when the driver ends is deleted then.
_OPEN: set[Scratch] = set()


@atexit.register
def _close_all() -> None:
    for s in list(_OPEN):
        with contextlib.suppress(Exception):  # the JVM may be gone
            s.close()


class Scratch:
    """Tables in the shared folder. They cut lineage (a lost executor costs a re-read) and go with ``close()``."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/beamloom-{uuid.uuid4().hex}", 0
        _OPEN.add(self)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        _OPEN.discard(self)
        _delete(self.spark, self.root)


def tied(result: DataFrame, scratch: Scratch) -> DataFrame:
    """``result`` with its scratch tables noted on it; ``release(result)`` deletes them when it is used up."""
    result._beamloom_scratch = [*getattr(result, "_beamloom_scratch", []), scratch]
    return result


def release(result: DataFrame) -> None:
    for s in getattr(result, "_beamloom_scratch", []):
        s.close()
    result._beamloom_scratch = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(text_col: str = "text"):
    """The text, null as the empty string."""
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores put after it until no column of ``docs`` is named so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a long that names each row once, and that column's name.

    It is the id where ids are whole numbers, unique and not null. Else (repeated rows, null ids) the rows are
    written once to the shared folder with a row number, so that every later read sees the same key.
    """
    kind, key = dict(docs.dtypes)[id_col], free_name(docs, "key")
    if kind in ("bigint", "int", "smallint", "tinyint"):
        ids = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("i")).groupBy("i").count()
        if not ids.filter("i is null or count > 1").limit(1).collect():
            return docs.withColumn(key, F.col(f"`{id_col}`").cast("bigint")), key
    return scratch.table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def plain_name(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` whose columns named like one that an operator adds are renamed with the suffix ``_input``."""
    low = {a.lower() for a in added}
    for c in docs.columns:
        if c.lower() in low:
            docs = docs.withColumnRenamed(c, f"{c}_input")
    return docs
