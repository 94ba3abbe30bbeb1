"""A search index kept current by batches of changes.

Each batch adds a folder to five tables below a root: ``postings`` of its records (packed,
one row for each record and field, so they are moved whole, not token by token),
``versions`` (their ids), ``gone`` (the versions of records that it replaces or
deletes: a delete vector), ``stats`` (how document frequencies change) and ``sizes``
(how numbers and lengths of records change).  Nothing that was written is touched;
statistics are sums of changes, and readers leave out the postings that are gone.

``sizes`` is written last.  Readers see only batches that have it, so all tables of a
batch or none; a replayed batch overwrites its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.operators.search import HOT_SHARE, Index, pack_postings, unpack_postings
from biblioweave.session import materialise
from biblioweave.streaming.updates import _partitions

TABLES = ("postings", "versions", "gone", "stats", "sizes")


def batches(spark: SparkSession, root: str, before: int | None = None) -> list[int]:
    """Numbers of the whole batches (below ``before``)."""
    found = _partitions(spark, f"{root}/sizes", "batch")
    return [b for b in found if before is None or b < before]


def _read(spark: SparkSession, root: str, table: str, numbers: list[int]) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/batch={b}" for b in numbers])
    return rows.withColumn("batch", F.col("batch").cast("long"))


def _live(spark: SparkSession, root: str, table: str, numbers: list[int]) -> DataFrame:
    """Rows of records that no later batch has replaced or deleted."""
    gone = _read(spark, root, "gone", numbers).select("id", F.col("version").alias("batch"))
    return _read(spark, root, table, numbers).join(gone, ["id", "batch"], "left_anti")


def apply_changes(
    records: DataFrame,
    batch: int,
    root: str,
    fields: dict[str, tuple[str, str]],
    *,
    id: str = "id",
    deleted: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> None:
    """Add or replace ``records`` (unique ids) and delete the ids in ``deleted``, as batch number ``batch``.

    A record that is both given and deleted is deleted first, so it stays.
    """
    spark = records.sparkSession
    fresh = materialise(pack_postings(records, fields, id=id, carry=carry), "fresh-postings")
    ids = records.select(F.col(id).alias("id")).distinct()
    touched = ids if deleted is None else ids.union(deleted.select(F.col(id).alias("id"))).distinct()
    earlier = batches(spark, root, batch)
    changed = fresh.select("field", "tokens", "doc_len", F.lit(1).alias("sign"))
    gone = spark.createDataFrame([], f"id {dict(ids.dtypes)['id']}, version long")
    if earlier:
        gone = materialise(
            _live(spark, root, "versions", earlier).join(touched, "id", "left_semi").select("id", F.col("batch").alias("version")), "gone-versions"
        )
        old = _read(spark, root, "postings", earlier).join(gone.withColumnRenamed("version", "batch"), ["id", "batch"], "left_semi")
        changed = changed.union(old.select("field", "tokens", "doc_len", F.lit(-1).alias("sign")))
    each = changed.select("field", "sign", F.explode("tokens").alias("token"))
    stats = each.groupBy("field", "token").agg(F.sum("sign").alias("df")).where("df <> 0")
    sizes = changed.groupBy("field").agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("doc_len")).alias("length"))
    for table, rows in zip(TABLES, (fresh, ids, gone, stats, sizes)):
        rows.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch}")


def current_index(spark: SparkSession, root: str) -> Index:
    """The index of all whole batches; equal in its results to one built from the current records."""
    numbers = batches(spark, root)
    if not numbers:
        raise ValueError(f"no batch has been applied below {root}")
    counts = _read(spark, root, "stats", numbers).groupBy("field", "token").agg(F.sum("df").alias("df")).where("df > 0")
    postings = counts.groupBy("field").agg(F.sum("df").alias("n_postings"))
    sums = _read(spark, root, "sizes", numbers).groupBy("field").agg(F.sum("docs").alias("n_docs"), F.sum("length").alias("length"))
    field_stats = sums.where("n_docs > 0").join(postings, "field").select("field", "n_docs", (F.col("length") / F.col("n_docs")).alias("avg_len"), "n_postings")
    field_stats = materialise(field_stats, "field-stats")
    # one row for each indexed field
    known = counts.join(F.broadcast(field_stats), "field")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    token_stats = known.select(
        "field", "token", "df", idf.alias("idf"), idf.alias("bound"),
        F.ceil(F.col("df") * HOT_SHARE / F.col("n_postings")).cast("int").alias("salts"),
    )
    packed = _live(spark, root, "postings", numbers).drop("batch").withColumn("copies", F.lit(1).cast("long"))
    carry = tuple(c for c in packed.columns if c not in ("id", "field", "doc_len", "tokens", "tfs"))
    stats = materialise(token_stats, "token-stats")
    return Index(unpack_postings(packed, *carry), stats, field_stats, packed=packed, carry=carry)


def compact_index(spark: SparkSession, root: str, target: str) -> None:
    """Write the current index below ``target`` as one batch, for further batches to follow there."""
    numbers = batches(spark, root)
    last = numbers[-1]
    none = _read(spark, root, "gone", numbers).limit(0).drop("batch")
    sums = lambda table, keys, columns: _read(spark, root, table, numbers).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])
    tables = (
        _live(spark, root, "postings", numbers).drop("batch"), _live(spark, root, "versions", numbers).drop("batch"), none,
        sums("stats", ("field", "token"), ("df",)).where("df <> 0"), sums("sizes", ("field",), ("docs", "length")),
    )
    for table, rows in zip(TABLES, tables):
        rows.write.mode("overwrite").parquet(f"{target}/{table}/batch={last}")
