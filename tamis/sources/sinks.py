"""Writers: append-only audit lines, reports, slim copies of state."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_audit(rows: DataFrame, path: str) -> None:
    """One JSON line a change."""
    rows.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """A Parquet table, parted by a column of few values where one is given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Lines of a ranked report, bounded by its top-k, as one text file."""
    rows.coalesce(1).write.mode("overwrite").text(path)
