"""Load a dump and audit a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioweave.operators.audit import audit_duplicates, audit_missing_doi, audit_summary
from biblioweave.operators.records import (
    IGNORED_FIELDS, build_search_records, high_water_mark, load_metrics,
)
from biblioweave.operators.reports import export_records_csv, select_by_mesh
from biblioweave.operators.search import build_index
from biblioweave.operators.tables import build_works
from biblioweave.session import materialise
from biblioweave.sources.sinks import (
    write_classes_csv, write_key_table, write_report_tsv,
)
from biblioweave.sources.works import read_works


def load_dump(
    spark: SparkSession, path: str, out: str, *, ignored_fields: tuple[str, ...] = IGNORED_FIELDS,
    default_source: str | None = "crossref",
) -> DataFrame:
    """Read a dump, write ``works``, ``search`` and ``state``; returns the metrics row."""
    raw = read_works(spark, path)
    if default_source:
        raw = raw.withColumn("source", F.coalesce("source", F.lit(default_source)))
    parsed = materialise(raw, "parsed-works")
    works = build_works(parsed, ignored_fields=ignored_fields, invalid="invalid")
    write_key_table(works.drop("invalid"), f"{out}/works")
    stored = spark.read.parquet(f"{out}/works")
    write_key_table(build_search_records(stored), f"{out}/search")
    write_key_table(high_water_mark(parsed), f"{out}/state")
    return load_metrics(parsed, source="source", invalid="invalid")


def audit_collection(records: DataFrame, out: str, **options) -> DataFrame:
    """Write both audit reports and return the summary row."""
    index = build_index(
        records.withColumn("has_doi", F.col("doi").isNotNull()),
        {"bibliographic": ("bibliographic", "words_stop")},
        carry=("has_doi", "source"),
    )
    missing = materialise(audit_missing_doi(records, index, **options), "missing-doi")
    duplicates = materialise(audit_duplicates(records, index, **options), "duplicates")
    write_report_tsv(missing, f"{out}/missing_doi")
    write_report_tsv(duplicates, f"{out}/duplicates")
    return audit_summary(records, missing, duplicates)


def export_mesh_corpus(
    biblio: DataFrame, mesh_table: DataFrame, selection: DataFrame, out: str, *,
    only_pmc: bool = False,
) -> None:
    """Write the export columns of selected records, one CSV folder per class."""
    hits = select_by_mesh(mesh_table, selection, only_pmc=only_pmc).withColumnRenamed(
        "pmid", "_pmid"
    )
    ids = mesh_table.select(
        F.col("pmid").alias("_mpmid"), F.col("doi").alias("_doi"), F.col("pmc").alias("_pmc")
    )
    completed = biblio.join(ids, biblio["pmid"] == ids["_mpmid"], "left").withColumns(
        {"doi": F.coalesce("doi", "_doi"), "pmc": F.coalesce("pmc", "_pmc")}
    )
    rows = export_records_csv(completed)
    joined = hits.join(rows, hits["_pmid"] == rows["pmid"])
    write_classes_csv(joined.select("level", *[f"`{c}`" for c in rows.columns]), out)
