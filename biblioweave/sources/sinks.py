"""Writers: key tables, record dumps, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

RECORDS_PER_FILE = 10_000


def write_key_table(
    df: DataFrame, path: str, *, table: str | None = None, key: str | None = None, buckets: int = 0
) -> None:
    """Parquet table; with ``buckets`` a bucketed, sorted table for joins on ``key``."""
    if buckets:
        (
            df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
            .option("path", path).format("parquet").saveAsTable(table)
        )
    else:
        df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str, *, column: str = "json") -> None:
    """One JSON record per line, gzip, at most 10,000 records per file."""
    (
        df.select(column).write.mode("overwrite").option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


def write_report_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated audit report without header."""
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_classes_csv(df: DataFrame, path: str, *, level: str = "level") -> None:
    """One folder of CSV files with header per class.

    Rows are dealt by class first, so a class is in few files; a class too large
    for one task is split by adaptive execution.
    """
    df.hint("rebalance", level).write.mode("overwrite").partitionBy(level).option("header", True).option(
        "escape", '"'
    ).csv(path)


def write_oa_hits(df: DataFrame, path: str) -> None:
    """Open-access hits as JSON lines."""
    df.write.mode("overwrite").json(path)
