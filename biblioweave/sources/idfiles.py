"""Readers for identifier maps, open-access files and selections.

Tables in which later rows win carry ``seq``, the place of the row (see works).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.functions.ids import strip_doi_resolver
from biblioweave.functions.text import not_blank, null_if_blank
from biblioweave.schemas import ENRICHMENT_RECORD, EXPORT_COLUMNS, ISTEX_RECORD, OA_RECORD
from biblioweave.sources.works import line_place


def read_pmid_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV of PMID, PMC id and DOI; the header and rows with more fields are skipped."""
    rows = spark.read.schema("pmid string, pmcid string, doi string, extra string").csv(path)
    rows = rows.select("*", line_place())
    return rows.filter(
        F.col("extra").isNull() & ~F.coalesce(F.upper("pmid") == "PMID", F.lit(False))
    ).select(
        null_if_blank(F.col("pmid")).alias("pmid"),
        null_if_blank(F.col("pmcid")).alias("pmcid"),
        strip_doi_resolver(F.col("doi")).alias("doi"),
        F.lit(None).cast("string").alias("license"),
        F.lit(None).cast("string").alias("subpath"),
        "seq",
    )


def read_oa_file_list(
    spark: SparkSession, path: str, *, license_at: int = 0, pmc_at: int = 2, subpath_at: int = 4
) -> DataFrame:
    """Tab-separated open-access file list; short rows are skipped."""
    parts = F.split("value", "\t", -1)
    return (
        spark.read.text(path).select("value", line_place())
        .filter(F.size(parts) > max(license_at, pmc_at, subpath_at))
        .select(
            F.get(parts, F.lit(license_at)).alias("license"),
            F.get(parts, F.lit(pmc_at)).alias("pmcid"),
            F.get(parts, F.lit(subpath_at)).alias("subpath"),
            "seq",
        )
    )


def read_oa_locations(spark: SparkSession, path: str) -> DataFrame:
    """Open-access location records, one JSON object per line; bad lines dropped."""
    return spark.read.schema(OA_RECORD).option("mode", "DROPMALFORMED").json(path)


def read_istex_ids(spark: SparkSession, path: str) -> DataFrame:
    """Archive id records that carry at least one DOI."""
    rows = spark.read.schema(ISTEX_RECORD).json(path).select("*", line_place()).filter(F.size("doi") > 0)
    return rows.withColumnsRenamed({"corpusName": "corpus_name", "istexId": "istex_id"})


def read_mesh_selection(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exactly four fields: three class levels and a descriptor id."""
    schema = "level1 string, level2 string, level3 string, descriptor string, extra string"
    rows = spark.read.schema(schema).csv(path)
    return rows.filter(F.col("descriptor").isNotNull() & F.col("extra").isNull()).drop("extra")


def read_enrichment_json(spark: SparkSession, path: str) -> DataFrame:
    """Array of enrichment entries; ``entry_no`` is the file and the place in it, in order."""
    rows = spark.read.schema(ENRICHMENT_RECORD).option("multiLine", True).json(path)
    # a multi-line file is one split, so its row ids increase in one task
    return rows.select("*", line_place()).withColumnRenamed("seq", "entry_no")


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported records with their header line."""
    schema = ", ".join(f"`{name}` string" for name in EXPORT_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(
        path, multiLine=True
    )
    return rows.filter(not_blank(F.concat_ws("", *[F.col(f"`{c}`") for c in rows.columns])))
