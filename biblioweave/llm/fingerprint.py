"""Document fingerprints by winnowing, with DataFrame functions only.

A text is read as tokens: words, with long runs cut into stretches and each
ideograph alone.  Hashes of k neighbouring tokens roll over the text; of each
window of w of them the least is chosen, the rightmost on ties, with its
position.  Two texts that share k + w - 1 tokens in a row share a fingerprint
hash, and one shared hash means k shared tokens.

Null texts are empty.  A text of fewer tokens than k or w is one gram or one
window; an empty text has no hashes.  The likeness of two fingerprints is the
share of their distinct hashes that they have in common (1 for two empty ones).
Equal texts have equal fingerprints.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioweave.llm.common import SPACE, whole

GRAM_TOKENS = 4
WINDOW_GRAMS = 4
TOKEN = rf"[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]|[^{SPACE}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]{{1,16}}"
# Hashes are below this prime, so that a product with the multiplier is below 2**58,
# and a hash with a position below 2**32 fits a long.
PRIME = 268_435_399
MULTIPLIER = 131_071
_PLACES = 1 << 32


def _double(df: DataFrame, name: str, by: int, combine) -> DataFrame:
    """Each value combined with the one ``by`` places later, in a projection of its own.

    A list too short for that is folded into one value.
    """
    keep = F.size(name) - by
    shifted = F.zip_with(F.slice(name, F.lit(1), keep), F.slice(name, F.lit(by + 1), keep), combine)
    rest = F.slice(name, F.lit(2), F.greatest(F.size(name) - 1, F.lit(0)))
    folded = F.when(F.size(name) == 0, F.slice(name, 1, 0)).otherwise(F.array(F.aggregate(rest, F.element_at(name, 1), combine)))
    return df.withColumn(name, F.when(F.size(name) > by, shifted).otherwise(folded))


def _roll(power: int):
    return lambda a, b: (a * power + b) % PRIME


def winnow(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the chosen grams in order of position.

    Each is a long: the hash in the upper half, in the lower 2**32 - 1 less the
    position (grams count from 0), so that the least is the rightmost of equals.
    """
    # md5 gives 28 bits of a token's hash, as any SQL engine can
    hashed = F.transform(
        F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)),
        lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long") % PRIME,
    )
    df = df.withColumn(name, hashed)
    step = 1
    while step < GRAM_TOKENS:  # hashes of 2, 4, ... tokens roll into those of twice as many
        df = _double(df, name, step, _roll(pow(MULTIPLIER, step, PRIME)))
        step *= 2
    # least hash first, then the rightmost position
    df = df.withColumn(name, F.transform(name, lambda h, i: h * _PLACES + (_PLACES - 1 - i)))
    step = 1
    while step < WINDOW_GRAMS:
        df = _double(df, name, step, lambda a, b: F.least(a, b))
        step *= 2
    return df.withColumn(name, F.array_distinct(name))


def _hash(chosen: Column) -> Column:
    return F.shiftright(chosen, 32)


def _position(chosen: Column) -> Column:
    return F.lit(_PLACES - 1) - chosen.bitwiseAND(F.lit(_PLACES - 1))


def digest(chosen: Column) -> Column:
    """A fingerprint as text: hash:position, comma-joined."""
    return F.array_join(F.transform(chosen, lambda c: F.concat(_hash(c).cast("string"), F.lit(":"), _position(c).cast("string"))), ",")


def with_likeness(df: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """Column ``name``: the distinct hashes shared by two fingerprints over all of theirs."""
    df = df.withColumns({"_a": F.array_distinct(F.transform(one, _hash)), "_b": F.array_distinct(F.transform(other, _hash))})
    df = df.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    every = F.size("_a") + F.size("_b") - F.col("_both")
    return df.withColumn(name, F.when(every == 0, F.lit(1.0)).otherwise(F.col("_both") / every)).drop("_a", "_b", "_both")


BUCKETS = 256


def with_next(docs: DataFrame, doc_id="doc_id", text="text", keep: list[str] | None = None) -> DataFrame:
    """row (all columns of ``docs``), _text, _chosen (its fingerprint), next_text and next_chosen: those of the
    next row by descending id, and of the first row after the last.

    Rows are dealt to ranges of ids whose bounds are ids themselves (at most
    BUCKETS numbers).  The row that begins a range is also sent to the range
    before it, so each range finds its last row's successor on its own.  Equal
    ids are ordered by text; null ids come last.
    """
    placed = docs.select(
        F.struct(*(keep or docs.columns)).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_order"),
        whole(F.col(text)).alias("_text"),
    )
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    row = placed.agg(F.max("_order").alias("top"), F.percentile_approx("_order", shares, 10_000).alias("bounds")).first()
    if row["top"] is None:
        return winnow(placed, "_text", "_chosen").withColumns({"next_text": F.col("_text"), "next_chosen": F.col("_chosen")}).drop("_order")
    bounds = sorted({row["top"], *row["bounds"]}, reverse=True)
    begins = F.array(*[F.lit(b) for b in bounds])
    # number of the range: how many bounds are at or above the id, less one
    own = F.size(F.filter(begins, lambda b: b >= F.col("_order"))) - 1
    before = F.when(own > 0, own - 1).otherwise(len(bounds) - 1)
    is_first = F.array_contains(begins, F.col("_order"))
    wraps = is_first & (own == 0)
    homes = F.when(
        is_first,
        F.array(
            F.struct(own.alias("range"), F.lit(0).alias("late"), F.lit(True).alias("home")),
            F.struct(before.alias("range"), F.when(wraps, 2).otherwise(1).alias("late"), F.lit(False).alias("home")),
        ),
    ).otherwise(F.array(F.struct(own.alias("range"), F.lit(0).alias("late"), F.lit(True).alias("home"))))
    dealt = winnow(placed, "_text", "_chosen").withColumn("_home", F.explode(homes))
    order = Window.partitionBy("_home.range").orderBy("_home.late", F.desc("_order"), "_text")
    following = {"next_text": F.lead("_text").over(order), "next_chosen": F.lead("_chosen").over(order)}
    return dealt.withColumns(following).where("_home.home").drop("_home", "_order")


def compare_edited(docs: DataFrame, doc_id="doc_id", text="text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns in ``keep``, or all) with n_chars, edited_text (its last third replaced by the start of the next text), the
    fingerprints of both, and the likeness of its own to the edited one's and to the next document's."""
    rows = with_next(docs, doc_id, text, keep).withColumn("n_chars", F.length("_text").cast("long"))
    rows = rows.withColumn("_third", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn(
        "edited_text", F.concat(F.left("_text", (F.col("n_chars") - F.col("_third")).cast("int")), F.left("next_text", F.col("_third")))
    ).drop("_text", "next_text", "_third")
    rows = winnow(rows, "edited_text", "_edited")
    rows = with_likeness(rows, "_chosen", "_edited", "near_edited")
    rows = with_likeness(rows, "_chosen", "next_chosen", "near_next")
    return rows.withColumns({"fingerprint": digest(F.col("_chosen")), "edited_fingerprint": digest(F.col("_edited"))})
