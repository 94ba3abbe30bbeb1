"""Counting tokens within a record's row."""

from collections import Counter

from biblioweave import session
from biblioweave.catalog import Tables, matching
from biblioweave.functions.text import ENGLISH_STOP_WORDS, WORD, fold_ascii
from biblioweave.operators import search
from pyspark.sql import functions as F

TEXTS = ["The cat, THE dog and the Cat 9x", "b a b a b", "Straße ÉTÉ été ǅ x₂ 東京 3½", "İstanbul K café_bar", "the", " \n", "", None, "...", "á b"]


def test_packed_tokens_are_the_counted_words(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    packed = search.pack_postings(df, {"bibliographic": ("text", "words_stop")}).collect()
    every = F.regexp_extract_all(fold_ascii(F.lower("text"), lowered=True), F.lit(WORD), F.lit(0))
    wanted = {}
    for row in df.select("id", every.alias("words")).collect():
        words = [w for w in row["words"] or [] if w not in ENGLISH_STOP_WORDS]
        if words:
            wanted[row["id"]] = (len(words), Counter(words))
    assert {r["id"]: (r["doc_len"], dict(zip(r["tokens"], r["tfs"]))) for r in packed} == wanted
    assert all(len(set(r["tokens"])) == len(r["tokens"]) == len(r["tfs"]) for r in packed)


def test_token_stats_do_not_look_for_copies(spark):
    """They are sums over all records; finding copies moves and writes tables for nothing."""
    before = len(session._written)
    rows = matching.token_stats(Tables(spark, "/root/testdata/sf0.001"))
    assert rows.count() > 0
    assert "members" not in {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._written[before:]}
