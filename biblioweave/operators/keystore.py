"""Key tables kept for lookups: dealt into buckets by key and sorted within.

A join of requests with such a table moves the requests only: they are dealt into
the buckets of the table, whose rows, with their large JSON texts, stay where they
are.  A handful of requests reads only the buckets and row groups that can hold
their keys.  For tables that are not bucketed, ``only_requested`` tests their keys
against a bitmap of the request keys of bounded size before anything is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions.text import not_blank
from biblioweave.operators.keys import latest_per_key

ROWS_PER_BUCKET = 1_000_000
# So many distinct request keys are looked up one by one.
FEW_KEYS = 200
BITS_PER_KEY = 16
_CHUNK = 32_768  # bits of one row of bitmap_construct_agg
MAX_BITS = 1 << 27


@dataclass(frozen=True)
class KeyStore:
    """``rows`` of unique ``key``, bucketed and sorted by it, under a table name."""

    rows: DataFrame
    key: str
    buckets: int
    name: str

    def rows_for(self, requests: DataFrame, key: Column) -> DataFrame:
        """The rows to join with ``requests``: of all buckets, or of few keys only those that can match."""
        wanted = requests.select(key.cast("string").alias("k")).where("k IS NOT NULL").distinct().limit(FEW_KEYS + 1).collect()
        if len(wanted) > FEW_KEYS:
            return self.rows
        return self.rows.where(F.col(self.key).isin([r["k"] for r in wanted]))


def bucket_count(rows: int) -> int:
    """Buckets for so many rows: a power of two, so that stores of different sizes fit each other."""
    return 1 << max(0, (max(rows, 1) - 1) // ROWS_PER_BUCKET).bit_length()


def write_store(df: DataFrame, path: str, *, key: str, name: str, buckets: int | None = None) -> KeyStore:
    """Keep ``df``, whose string keys are unique and not blank, as a key store.

    Rows are dealt into the buckets before they are written, so each is one sorted file.
    """
    buckets = buckets or bucket_count(df.count())
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return KeyStore(df.sparkSession.table(name), key, buckets, name)


def open_store(spark: SparkSession, path: str, *, key: str, name: str, buckets: int) -> KeyStore:
    """A key store written by another session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return KeyStore(spark.table(name), key, buckets, name)


def merge_store(store: KeyStore, changes: DataFrame, path: str, *, name: str, order_by: list[Column]) -> KeyStore:
    """A new store at ``path`` with ``changes`` put in: of equal keys the first in ``order_by`` stays.

    Only the changes are dealt by key; the store is read bucket by bucket.
    """
    columns = store.rows.columns
    fresh = latest_per_key(changes.select(*columns), store.key, order_by)
    old = store.rows.select(F.col(store.key).alias("_key"), F.struct(*columns).alias("_old"))
    new = fresh.select(F.col(store.key).alias("_new_key"), F.struct(*columns).alias("_new"))
    both = old.join(new, F.col("_key") == F.col("_new_key"), "full_outer")
    merged = both.select(F.coalesce("_new", "_old").alias("r")).select("r.*")
    return write_store(merged, path, key=store.key, name=name, buckets=store.buckets)


def only_requested(table: DataFrame, table_key: str, requests: DataFrame, key: Column) -> DataFrame:
    """The rows of ``table`` whose key may be requested; all that are requested are among them.

    A row stays if the bit of its hashed key is set.  The bitmap has BITS_PER_KEY bits
    for each request key and at most MAX_BITS (16 MB, broadcast in rows of 4 KB);
    a full one lets more rows pass.
    """
    keys = requests.select(key.cast("string").alias("k")).where(not_blank(F.col("k"))).distinct()
    bits = _CHUNK
    while bits < min(BITS_PER_KEY * keys.count(), MAX_BITS):
        bits *= 2
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    chunk = lambda k: F.floor(slot(k) / _CHUNK)
    bitmap = keys.select(chunk(F.col("k")).alias("_chunk"), F.pmod(slot(F.col("k")), F.lit(_CHUNK)).alias("at"))
    bitmap = bitmap.groupBy("_chunk").agg(F.expr("bitmap_construct_agg(at)").alias("_bitmap"))
    own = F.col(table_key).cast("string")
    marked = table.withColumns({"_chunk": chunk(own), "_at": F.pmod(slot(own), F.lit(_CHUNK))}).join(F.broadcast(bitmap), "_chunk")
    byte = F.expr("cast(conv(hex(substring(_bitmap, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    shifted = marked.withColumn("_byte", byte).where("shiftright(_byte, cast(_at % 8 as int)) & 1 = 1")
    return shifted.drop("_chunk", "_at", "_bitmap", "_byte")
