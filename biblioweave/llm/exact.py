"""Exact deduplication by progressive refinement.

Texts are equal when they are identical without white space.  Three rounds narrow
down which rows can have an equal: by the length of the bare text, then by a hash
of its first characters, then by a hash of the whole.  A round sees only what the
one before left with company, and only those rows are hashed as a whole.

The rows that go on to the last round are told by a bitmap over the hashed keys of
the groups left: a row whose bit is not set is alone for certain.  The bitmap has
``BITS_PER_KEY`` bits a group and at most ``MAX_BITS`` bits (16 MB), which bounds
its broadcast; when it is full, more lone rows are hashed as a whole and nothing
else changes.  Texts are not shuffled (unless kept): groups are summed within tasks first, and
the groups that hold many rows (fewer than ``HOT_SHARE`` can) are looked up by
broadcast.

Null text: empty.  Empty texts and those of white space only are equal to each
other.  Of equal texts the row with the longest original text stays, then the
smallest id, a null id last; of rows equal in that too, one.  Columns to keep are
carried in a struct, so no name clashes.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.llm.common import SPACE, whole
from biblioweave.session import materialise

PREFIX_CHARS = 256
BITS_PER_KEY = 16
_BITMAP_BITS = 32_768  # of one row of bitmap_construct_agg
MAX_BITS = 1 << 27
HOT_SHARE = 2_000
_KEY = ["size", "start", "full"]


def bare(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def _sized(docs: DataFrame, text: str, normal) -> DataFrame:
    """The given columns with the normal text, its length in bytes and the hash of its first characters."""
    plain = docs.withColumn("_normal", normal(whole(F.col(text))))
    start = F.xxhash64(F.substring("_normal", 1, PREFIX_CHARS))
    return plain.withColumns({"size": F.octet_length("_normal").cast("long"), "start": start})


def _crowded(sized: DataFrame) -> DataFrame:
    """Keys (size, start) that two rows or more share: first by size, then by both."""
    keys = materialise(sized.groupBy("size", "start").agg(F.count("*").alias("rows")), "exact-keys")
    sizes = keys.groupBy("size").agg(F.sum("rows").alias("n")).where("n > 1").select("size")
    left = keys.join(sizes, "size", "left_semi")
    return materialise(left.where("rows > 1").select("size", "start"), "exact-crowded")


def _place(bits: int) -> tuple[Column, Column]:
    """Row of the bitmap and bit in it of a key."""
    slot = F.pmod(F.xxhash64("size", "start"), F.lit(bits))
    return F.floor(slot / _BITMAP_BITS), F.pmod(slot, F.lit(_BITMAP_BITS))


def _bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """One bit for each hashed key, in rows of 4 KB; and the number of bits."""
    bits = _BITMAP_BITS
    while bits < min(BITS_PER_KEY * keys.count(), MAX_BITS):
        bits *= 2
    chunk, at = _place(bits)
    return keys.select(chunk.alias("chunk"), at.alias("at")).groupBy("chunk").agg(F.expr("bitmap_construct_agg(at)").alias("bitmap")), bits


def refine(docs: DataFrame, *, doc_id="doc_id", text="text", keep: list[str] | None = None, normal=bare, longest=True, extra=None) -> DataFrame:
    """One row per document: ``row`` (the columns to keep), keep_id, group_size, kept and ``extra``.

    ``normal`` maps the text to what is compared.  With ``longest`` the row with
    the most characters stays, else the one with the smallest id.  ``extra`` makes
    a further column from the normal text.
    """
    carried = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sized = _sized(carried, "text", normal)
    bitmap, bits = _bitmap(_crowded(_sized(docs.select(F.col(text).alias("text")), "text", normal)))
    chunk, at = _place(bits)
    # at most MAX_BITS bits in all
    marked = sized.withColumns({"chunk": chunk, "at": at}).join(F.broadcast(bitmap), "chunk", "left")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("_byte", byte).withColumn(
        "_shared", F.coalesce(F.expr("shiftright(_byte, cast(at % 8 as int)) & 1") == 1, F.lit(False))
    )
    length = F.length(whole(F.col("text"))).cast("long") if longest else F.lit(0).cast("long")
    placed = materialise(
        marked.select(
            "row",
            "size",
            "start",
            F.when(F.col("_shared"), F.sha2("_normal", 256)).alias("full"),
            F.struct((-length).alias("length"), F.col("id").isNull().alias("none"), "id", F.monotonically_increasing_id().alias("at")).alias("rank"),
            (F.lit(None) if extra is None else extra(F.col("_normal"))).alias("extra"),
        ),
        "exact-rows",
    )
    alone = placed.where(F.col("full").isNull()).select(
        "row", F.col("rank.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "extra"
    )
    shared = placed.where(F.col("full").isNotNull())
    groups = materialise(shared.groupBy(*_KEY).agg(F.count("*").alias("group_size"), F.min("rank").alias("first")), "exact-groups")
    return alone.unionByName(_with_groups(shared, groups))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group's first row and size; groups of many rows are broadcast, fewer than HOT_SHARE."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT_SHARE > total
    renamed = groups.select(*_KEY, F.col("group_size").alias("_size"), F.col("first").alias("_first"), hot.alias("_hot"))
    many = rows.join(F.broadcast(renamed.where("_hot")), _KEY, "left")
    found = many.where("_hot")
    rest = many.where(F.col("_hot").isNull()).select(*rows.columns).join(renamed.where("NOT _hot"), _KEY)
    return found.unionByName(rest.select(*found.columns)).select(
        "row", F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("rank") == F.col("_first")).alias("kept"), "extra"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay; columns as given."""
    return refine(docs, **options).where("kept").select("row.*")
