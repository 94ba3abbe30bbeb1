"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept;
all but the last return the columns of documents.  ``run`` writes each stage's
result as Parquet in the shared scratch folder and reads it again, so a lost
executor costs the running stage only.

Null texts count as empty and go with the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.llm import language, neardup, packing, privacy, quality
from biblioweave.session import materialise, release_scratch, tune


# Rows of an Arrow batch: some 2 MB of text, which a task holds in the JVM and again in Python.
ROWS_PER_BATCH = 1000


def _prepared(spark: SparkSession) -> SparkSession:
    """Session settings of a stage."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that fail the rules or lose nearly all of their words."""
    return quality.clean_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be determined go."""
    _prepared(spark)
    release_scratch(spark, ("judged-documents",))  # the stage before is written
    return language.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    _prepared(spark)
    return neardup.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and so are terms that disclose it."""
    release_scratch(spark, ("involved-texts",))  # the stage before is written
    return privacy.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences: where they lie, and a checksum of their ids."""
    _prepared(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

# No stage after the first can be said in SQL; tests/llm compares the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
