"""Quality rules: base counts of a text and cross-document line frequency.

Lines of any length are normalised and hashed; a line found in more distinct
documents of a host than the limit allows is boilerplate and is removed, and a
document that loses nearly all of its words is rejected.  Only DataFrame
functions are used.

Documents are distinct if their normalised lines differ, so copies of a text count
once per host, with any case, digits or marks.  Copies with changed words are
documents of their own: more of them than the limit are boilerplate to each
other.  Texts without a word do not count.  Null text: no words, rejected.  Null
host: one host of its own.  Equal rows get equal results.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.llm.common import SPACE, whole, with_new_text, words
from biblioweave.session import materialise

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW_WORDS = 8
# A line is boilerplate beyond this share of its host's distinct documents, and
# beyond this number of them.
LINE_SHARE = 0.005
LINE_DOCS = 20
DEPLETED_SHARE = 0.8


def _with_windows(df: DataFrame, name: str) -> DataFrame:
    """The word hashes in column ``name`` replaced by hashes of eight words, by doubling.

    Each step is a projection of its own, so that no array is computed twice.
    """
    for by in (1, 2, 4):
        keep = F.greatest(F.size(name) - by, F.lit(0))
        pair = F.zip_with(F.slice(name, F.lit(1), keep), F.slice(name, F.lit(by + 1), keep), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(name, pair)
    return df


def _with_covered(df: DataFrame, windows: str, name: str) -> DataFrame:
    """``name``: number of places covered by windows whose hash occurs twice or more.

    Only texts with a repeated window are sorted; for the others it is 0.
    """
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(repeated, placed))
    last = F.size("_placed") - 1
    pairs = F.zip_with(
        F.slice("_placed", F.lit(1), last),
        F.slice("_placed", F.lit(2), last),
        lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])),
    )
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    df = df.withColumn("_starts", F.when(F.col("_placed").isNotNull(), found))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["total"] + s + WINDOW_WORDS - F.greatest(acc["end"], s)).alias("total"),
            (s + WINDOW_WORDS).alias("end"),
        ),
        lambda acc: acc["total"],
    )
    return df.withColumn(name, F.coalesce(covered, F.lit(0)).cast("long")).drop("_placed", "_starts")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows of eight words are compared by a 64-bit hash of their words.
    """
    full = whole(F.col(text))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    parts = docs.withColumns(
        {
            "_words": words(full),
            "n_symbols": (F.length(full) - F.length(F.regexp_replace(full, r"[#*$%&|<>]+", ""))).cast("long"),
            "_lines": lines,
        }
    )
    counted = parts.select(
        *docs.columns,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_windows"),
    )
    counted = _with_windows(counted, "_windows")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return _with_covered(counted, "_windows", "n_repeat_words").drop("_windows").withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, each run of other characters as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}0]+", " "))


def _keyed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    full = whole(F.col(text))
    return docs.withColumns(
        {
            "_id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
            "_host": F.coalesce(F.col(host).cast("string"), F.lit("")),
            "_key": F.xxhash64(full),
            "_text": full,
        }
    )


def _line_rows(keyed: DataFrame) -> DataFrame:
    """Written table, one row per line with a word: _id, _host, _key, _same (equal for like documents), place, _hash, _n (its words)."""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    split = keyed.select("_id", "_host", "_key", lines.alias("_lines"))
    hashed = split.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(normal_line(x))))
    sizes = F.transform("_lines", lambda x: F.size(words(x)))
    both = F.zip_with("_hashes", sizes, lambda h, n: F.struct(h.alias("_hash"), n.alias("_n")))
    placed = hashed.select("_id", "_host", "_key", F.xxhash64("_hashes").alias("_same"), F.posexplode(both).alias("_place", "_line"))
    return materialise(placed.select("_id", "_host", "_key", "_same", "_place", "_line.*"), "lines")


def frequent_lines(docs: DataFrame, doc_id="doc_id", text="text", host="source", line_share=LINE_SHARE, line_docs=LINE_DOCS) -> DataFrame:
    """Every place of a boilerplate line: _id, _host, _key, _place, _hash, _n (its words); once for equal rows."""
    rows = _line_rows(_keyed(docs, doc_id, text, host))
    hosts = rows.groupBy("_host").agg(F.count_distinct("_same").alias("_docs"))
    often = rows.groupBy("_host", "_hash").agg(F.count_distinct("_same").alias("_in")).where(F.col("_in") > line_docs)
    over = often.join(hosts, "_host").where(F.col("_in") > line_share * F.col("_docs")).select("_host", "_hash")
    return rows.join(materialise(over, "frequent-lines"), ["_host", "_hash"], "left_semi").drop("_same").distinct()


def _depleted(removed: Column, share: float) -> Column:
    return removed > share * F.col("n_words")


def quality_rules(docs: DataFrame, doc_id="doc_id", text="text", host="source", depleted_share=DEPLETED_SHARE, **limits) -> DataFrame:
    """One row per document: its id, the base counts, removed_words and kept.

    ``limits``: line_share and line_docs of ``frequent_lines``.
    """
    same = ["_id", "_host", "_key"]
    removed = frequent_lines(docs, doc_id, text, host, **limits).groupBy(*same).agg(F.sum("_n").alias("removed_words"))
    copies = _keyed(docs, doc_id, text, host).select(*same, F.col(doc_id).alias("doc_id"), "_text")
    joined = base_counts(copies, "_text").drop("_text").join(removed, same, "left").fillna({"removed_words": 0})
    return joined.drop(*same).withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("removed_words"), depleted_share))


def clean_documents(docs: DataFrame, doc_id="doc_id", text="text", host="source", depleted_share=DEPLETED_SHARE, **limits) -> DataFrame:
    """The kept documents without their boilerplate lines; columns as given, n_chars renewed if there."""
    same = ["_id", "_host", "_key"]
    gone = frequent_lines(docs, doc_id, text, host, **limits).groupBy(*same).agg(F.collect_set("_hash").alias("_gone"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), *[F.col(c).alias(f"_given_{i}") for i, c in enumerate((doc_id, text, host))])
    keyed = _keyed(packed, "_given_0", "_given_1", "_given_2").select("_row", *same, "_text")
    counts = base_counts(keyed, "_text")
    joined = counts.join(gone, same, "left")
    lines = F.split("_text", "\n")
    left = F.filter(lines, lambda x: ~F.array_contains("_gone", F.xxhash64(normal_line(x))))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    # judged in one pass and written, since a filter above the counts would be computed from the text again
    judged = joined.withColumn("_clean", kept)
    stays = ~F.col("base_failed") & ~_depleted(F.col("n_words") - F.size(words(F.col("_clean"))), depleted_share)
    judged = materialise(judged.select("_row", "_clean", stays.alias("_stays")), "judged-documents").where("_stays")
    return with_new_text(judged, docs.columns, text)
