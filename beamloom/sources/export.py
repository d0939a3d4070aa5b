"""The combined table of measured spots as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rows as R


def export_cells(df: DataFrame) -> DataFrame:
    """The export's columns in order, numbers that are not finite as missing."""
    kinds = dict(df.dtypes)
    return df.select(*[(R.finite(F.col(c)) if kinds[c] == "double" else F.col(c)).alias(c) for c in K.EXPORT_COLUMNS])


def write_export(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, written in parallel; missing values are empty. No row at all is an error."""
    if not df.head(1):
        raise ValueError("nothing to export")
    export_cells(df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_export_file(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> int:
    """One CSV file with a preamble of "# key: value" lines, for one acquisition; rows stream through the driver.

    No row at all is an error, and no file is written then.
    """
    n = 0
    rows = export_cells(df.orderBy("spot_index"))
    if not rows.head(1):
        raise ValueError("nothing to export")
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.writelines(f"# {k}: {v}\n" for k, v in (metadata or {}).items())
        out.write(",".join(K.EXPORT_COLUMNS) + "\n")
        for r in rows.toLocalIterator():
            out.write(",".join("" if v is None else str(v) for v in r) + "\n")
            n += 1
    return n
