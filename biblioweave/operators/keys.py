"""Shared join and dedupe helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.functions.text import not_blank
from biblioweave.session import materialise


def latest_per_key(df: DataFrame, key: str, order_by: list[Column]) -> DataFrame:
    """One row per non-blank key: the first in ``order_by``.

    The rank filter is applied map-side too, so at most one row per key and
    task is shuffled, however many copies a key has.
    """
    ranked = df.filter(not_blank(F.col(key).cast("string"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order_by))
    )
    return ranked.filter("_rank = 1").drop("_rank")


def last_written(df: DataFrame, key: str) -> list[Column]:
    """Later rows first by ``seq``, the place a reader gives them; tables without one
    get a fixed order: all other columns, descending."""
    if "seq" in df.columns:
        return [F.col("seq").desc_nulls_last()]
    return [F.col(c).desc_nulls_last() for c in df.columns if c != key]


def left_lookup(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    table_key: str,
    columns: dict[str, str],
    *,
    spread_by: str,
) -> DataFrame:
    """Left join to a table with unique keys, adding ``columns`` under new names.

    Rows without a key cannot match; they get distinct filler keys from
    ``spread_by`` so that they do not all land in one partition.
    """
    filler = F.concat(F.lit("\u0000"), F.xxhash64(spread_by).cast("string"))
    keyed = df.withColumn("_key", F.coalesce(key.cast("string"), filler))
    # a string key asked for as a column is moved once
    own = [c for c in columns if c == table_key and table.schema[c].dataType.typeName() == "string"]
    side = table.select(
        F.col(table_key).cast("string").alias("_table_key"),
        *[F.col(c).alias(name) for c, name in columns.items() if c not in own],
    )
    joined = keyed.join(side, keyed["_key"] == side["_table_key"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col("_table_key" if c in own else name).alias(name) for c, name in columns.items()],
    )


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``, dense from 0 in the given order; rows must differ in it.

    Partitions are ranges of the order and are numbered within; one row for each
    partition gives where its numbers begin.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    firsts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    rows = placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    return rows.withColumn("number", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_at")
