"""Incremental updates as a stream of landed record files.

A table is a folder with ``base/upto=<batch>`` (compacted state) and
``changes/batch=<batch>`` (one folder per applied batch).  A replayed batch
overwrites its own folder, so applying it twice changes nothing; readers see
the latest row per key over both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from biblioweave.functions.ids import normalise_doi
from biblioweave.operators.keys import latest_per_key
from biblioweave.operators.records import (
    IGNORED_FIELDS, build_search_records, drop_ignored_fields, load_metrics, reject_incomplete,
)
from biblioweave.sources.works import parse_works

UPDATE_FILES = "[DG]*.json.gz"
# Batches between two compactions, unless told otherwise; 0 for none.
COMPACT_EVERY = 16


def _partitions(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished ``name=<n>`` folders below ``folder``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        child = status.getPath()
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS"))
        if done and child.getName().startswith(f"{name}="):
            found.append(int(child.getName().split("=")[1]))
    return sorted(found)


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    """All rows of a table: newest base and the changes after it, with ``batch``."""
    bases = _partitions(spark, f"{table}/base", "upto")
    upto = bases[-1] if bases else -1
    batches = [b for b in _partitions(spark, f"{table}/changes", "batch") if b > upto]
    parts = []
    if bases:
        parts.append(spark.read.parquet(f"{table}/base/upto={upto}"))
    if batches:
        changes = spark.read.option("basePath", f"{table}/changes").parquet(
            *[f"{table}/changes/batch={b}" for b in batches]
        )
        parts.append(changes.withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current_rows(
    spark: SparkSession, table: str, *, key: str, by_arrival: bool = False
) -> DataFrame | None:
    """Latest row per key: by index date, then arrival; or by arrival alone."""
    rows = read_table(spark, table)
    if rows is None:
        return None
    arrival = [F.col("batch").desc(), F.col("seq").desc()]
    order = arrival if by_arrival else [F.col("indexed_ts").desc_nulls_last(), *arrival]
    return latest_per_key(rows, key, order)


def compact(spark: SparkSession, table: str, *, key: str, by_arrival: bool = False) -> None:
    """Write the current rows as a new base; older folders stay until pruned."""
    batches = _partitions(spark, f"{table}/changes", "batch")
    if batches:
        rows = current_rows(spark, table, key=key, by_arrival=by_arrival)
        rows.write.mode("overwrite").parquet(f"{table}/base/upto={batches[-1]}")


def prune(spark: SparkSession, table: str) -> None:
    """Delete what the base before the newest one covers, and older bases.

    Readers that began with the base before may still use the changes after it.
    """
    bases = _partitions(spark, f"{table}/base", "upto")
    if len(bases) < 2:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    covered = [b for b in _partitions(spark, f"{table}/changes", "batch") if b <= bases[-2]]
    gone = [f"{table}/changes/batch={b}" for b in covered] + [f"{table}/base/upto={b}" for b in bases[:-2]]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _apply_and_compact(apply, every: int, by_arrival: bool, root: str, options: dict):
    """Batches applied by ``apply``; each ``every`` of them become a new base."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply(batch, batch_id, root, **options)
        if every and (batch_id + 1) % every == 0:
            for name, key in (("works", "doi"), ("search", "id")):
                compact(batch.sparkSession, f"{root}/{name}", key=key, by_arrival=by_arrival)
                prune(batch.sparkSession, f"{root}/{name}")

    return run


def apply_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    *,
    ignored_fields: tuple[str, ...] = IGNORED_FIELDS,
    default_source: str = "crossref",
) -> None:
    """Write the changes of one batch: works, search records, mark and metrics."""
    # the place of a line: file, split and order within the split
    known = {"file": F.lit(""), "part": F.lit(0)} | {c: F.col(c) for c in ("file", "part") if c in batch.columns}
    place = F.struct(
        known["file"].alias("file"), known["part"].cast("long").alias("part"),
        F.monotonically_increasing_id().alias("line"),
    )
    parsed = parse_works(batch.select("value", place.alias("seq"))).withColumn(
        "source", F.coalesce("source", F.lit(default_source))
    )
    parsed = parsed.persist()
    try:
        works = reject_incomplete(parsed, invalid="invalid").withColumns(
            {
                "doi": normalise_doi(F.col("doi")),
                "json": drop_ignored_fields(F.col("json"), ignored_fields),
            }
        ).drop("invalid")
        works = latest_per_key(
            works, "doi", [F.col("indexed_ts").desc_nulls_last(), F.col("seq").desc()]
        )
        here = f"changes/batch={batch_id}"
        works.write.mode("overwrite").parquet(f"{root}/works/{here}")
        written = batch.sparkSession.read.parquet(f"{root}/works/{here}")
        search = build_search_records(written, carry=("indexed_ts", "seq"))
        search.write.mode("overwrite").parquet(f"{root}/search/{here}")
        parsed.agg(F.max("indexed_ts").alias("last_indexed")).write.mode("overwrite").parquet(
            f"{root}/marks/{here}"
        )
        load_metrics(parsed, source="source", invalid="invalid").write.mode("overwrite").parquet(
            f"{root}/metrics/{here}"
        )
    finally:
        parsed.unpersist()


def stream_work_updates(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    *,
    files: str = UPDATE_FILES,
    files_per_batch: int | None = None,
    clean: bool = False,
    once: bool = True,
    apply: Callable[..., None] = apply_batch,
    compact_every: int = COMPACT_EVERY,
    by_arrival: bool = False,
    **options,
) -> StreamingQuery:
    """Apply landed update files as upserts while the tables stay readable.

    ``clean`` deletes applied files.  ``compact_every`` batches the changes are
    merged into a new base (by index date, or ``by_arrival``) and what it covers
    is deleted, so a reader opens at most twice as many folders.  With ``once`` the query stops after the
    files that are there.
    """
    reader = spark.readStream.format("text").option("pathGlobFilter", files).option(
        "recursiveFileLookup", True
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if clean:
        reader = reader.option("cleanSource", "delete")
    writer = (
        reader.load(landing).select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("part"),
        ).writeStream
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_apply_and_compact(apply, compact_every, by_arrival, root, options))
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()


def last_mark(spark: SparkSession, root: str) -> DataFrame:
    """One row: the latest index date over all applied batches."""
    return read_table(spark, f"{root}/marks").agg(F.max("last_indexed").alias("last_indexed"))


def run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row of counts over all applied batches."""
    rows = read_table(spark, f"{root}/metrics")
    names = ("seen", "stored", "rejected", "indexed", "failed")
    return rows.agg(*[F.sum(c).alias(c) for c in names])


def updates_since(records: DataFrame, mark: DataFrame, *, ts: str = "indexed_ts") -> DataFrame:
    """Records indexed at or after the mark, a one-row table with ``last_indexed``.

    Without a mark all records are due.
    """
    since = F.coalesce(mark.scalar(), F.lit("1970-01-01").cast("timestamp"))
    return records.filter(F.col(ts) >= since)


def updates_since_yesterday(records: DataFrame, *, ts: str = "indexed_ts", today=None) -> DataFrame:
    """Records indexed since yesterday 00:00."""
    day = F.current_date() if today is None else F.lit(today).cast("date")
    return records.filter(F.col(ts) >= F.date_sub(day, 1).cast("timestamp"))


def persist_high_water_mark(mark: DataFrame, path: str, *, run_finished: bool) -> None:
    """Store the mark: the run's time after an update, the records' own after a dump."""
    value = F.current_timestamp() if run_finished else F.col("last_indexed")
    mark.select(value.alias("last_indexed")).write.mode("append").parquet(path)


def read_high_water_mark(spark: SparkSession, path: str) -> DataFrame:
    """The latest stored mark; earlier ones never win."""
    return spark.read.parquet(path).agg(F.max("last_indexed").alias("last_indexed"))
