"""The dealt operators as queries over the test tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.llm import bpe, exact, fingerprint, html, interactions, language, lm, neardup, oracles, packing, phrases, privacy, quality, toxicity
from biblioweave.llm.common import crc_fold
from biblioweave.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(tune(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_quality_rules", oracles.quality())
def op8(spark, folder):
    return quality.quality_rules(table(spark, folder, "documents"))


@query("quality_low_limits", oracles.quality(line_docs=2, line_share=0.02))
def quality_low_limits(spark, folder):
    """The rules with limits that small tables reach too."""
    return quality.quality_rules(table(spark, folder, "documents"), line_docs=2, line_share=0.02)


@query("op7_language_id")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 4)
    found = language.identify(docs, fold != 2, keep=["doc_id"])
    held_out = crc_fold(F.col("row.doc_id"), 4) == 2
    return found.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _sha(data: str) -> Column:
    return F.sha2(data, 256)


@query("op1_byte_bpe")
def op1(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return coded.select(
        "row.doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        _sha("ids").alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"),
    )


@query("op3_main_text")
def op3(spark, folder):
    found = html.extract(table(spark, folder, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_packing")
def op2(spark, folder):
    return packed(table(spark, folder, "documents").select("doc_id", "source", "text"))


@query("op5_fingerprints", oracles.FINGERPRINTS)
def op5(spark, folder):
    found = fingerprint.compare_edited(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_chars", _sha("edited_text").alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op4_toxicity")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learn = crc_fold(F.col("doc_id"), 5) != 0
    network = toxicity.train(*toxicity.labelled_sample(docs, table(spark, folder, "labels"), learn, toxicity.Sample()))
    found = toxicity.score(docs, network, keep=["doc_id"])
    held_out = crc_fold(F.col("row.doc_id"), 5) == 0
    return found.select("row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_near_duplicates")
def op9(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size", "similarity")


@query("op6_personal_data")
def op6(spark, folder):
    found = privacy.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.col("_base")
    return found.select(
        "doc_id",
        *[privacy.count_of(base, kind).alias(f"n_{kind}") for kind in privacy.KINDS],
        F.sha2(privacy.as_text(base).cast("binary"), 256).alias("base_sha256"),
        privacy.as_text(F.concat(base, "_extra")).alias("spans"),
    )


@query("op10_language_model")
def op10(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    fold = crc_fold(F.col("doc_id"), 7)
    found = lm.score(docs, fold != 2, fold == 3, keep=["doc_id"])
    held_out = crc_fold(F.col("row.doc_id"), 7) == 2
    return found.select("row.doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_exact_dedup", oracles.EXACT)
def op11(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = exact.refine(docs, keep=["doc_id"], extra=lambda bare: F.sha2(bare, 256))
    return found.select("row.doc_id", "keep_id", "group_size", "kept", F.col("extra").alias("text_sha256"))


@query("op12_filter_audit", oracles.INTERACTIONS)
def op12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = interactions.audit(docs, table(spark, folder, "labels"), interactions.text_filters(), "E")
    return found.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


@query("op13_phrases", oracles.PHRASES)
def op13(spark, folder):
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"))
