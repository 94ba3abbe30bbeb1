"""Readers and writers: a whole table is written in a source's shape and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog.shapes import S
from biblioweave.operators.tables import build_pmid_maps, build_works
from biblioweave.session import scratch_path
from biblioweave.sources import idfiles, sinks, works

ITEMS_PER_FILE = 1000


def _record(t: Tables) -> DataFrame:
    """Events as work records, one JSON text each."""
    record = F.struct(
        F.concat(F.lit("10.9/E"), S("event_id")).alias("DOI"),
        F.col("event_type").alias("type"),
        F.array(F.concat(F.lit("Event "), S("event_id"))).alias("title"),
        S("user_id").alias("volume"),
        F.struct(F.array(F.lit(1)).alias("items")).alias("license"),
    )
    return t.events.select("event_id", F.to_json(record).alias("value"))


def _lines(t: Tables) -> str:
    path = scratch_path(t.spark, "landed-lines")
    sinks.write_jsonl(_record(t), path, column="value")
    return path


def _arrays(t: Tables) -> str:
    """Array files of at most ITEMS_PER_FILE records."""
    path = scratch_path(t.spark, "landed-arrays")
    files = _record(t).groupBy(F.floor(F.col("event_id") / ITEMS_PER_FILE)).agg(
        F.concat(F.lit('{"items":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value")
    )
    files.select("value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


WORK_ROWS = """SELECT '10.9/E' || event_id AS doi, event_type AS type, 'Event ' || event_id AS title,
    CAST(user_id AS VARCHAR) AS volume, false AS invalid FROM events"""


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select("doi", "type", F.get("title", F.lit(0)).alias("title"), "volume", "invalid")


@query("S1_read_works_jsonl", WORK_ROWS)
def read_works_jsonl(t: Tables):
    return _fields(works.read_works_jsonl(t.spark, _lines(t)))


@query("S2_read_works_array", WORK_ROWS)
def read_works_array(t: Tables):
    return _fields(works.read_works_array(t.spark, _arrays(t)))


@query(
    "S3_detect_works_format",
    "SELECT DISTINCT unnest(['array', 'lines']) AS format, true AS known FROM events",
)
def detect_works_format(t: Tables):
    root = scratch_path(t.spark, "landed-files")
    for name, value in (("lines", _record(t)), ("arrays", t.spark.read.text(_arrays(t), wholetext=True))):
        value.select("value").write.option("compression", "gzip").text(f"{root}/{name}")
    found = works.detect_works_format(t.spark, f"{root}/lines").unionByName(
        works.detect_works_format(t.spark, f"{root}/arrays")
    )
    expected = F.col("path").contains("/lines/") == (F.col("format") == "lines")
    return found.groupBy("format").agg(F.bool_and(expected).alias("known"))


@query("S4_read_works", WORK_ROWS)
def read_works(t: Tables):
    return _fields(works.read_works(t.spark, _arrays(t)))


@query(
    "S1_last_record_wins",
    """SELECT '10.9/u' || user_id AS doi, 'Event ' || event_id AS title FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""",
)
def last_record_wins(t: Tables):
    """Records without index date: the later line of the only file wins."""
    path = scratch_path(t.spark, "landed-lines")
    record = F.struct(
        F.concat(F.lit("10.9/U"), S("user_id")).alias("DOI"), F.concat(F.lit("Event "), S("event_id")).alias("title"),
        F.lit("event").alias("type"), F.lit("own").alias("source"),
    )
    # files are named in the order of their rows
    rows = t.events.select("event_id", F.to_json(record).alias("value")).sort("event_id").select("value")
    rows.write.text(path)
    found = build_works(works.read_works_jsonl(t.spark, path), invalid="invalid")
    return found.select("doi", F.get("title", F.lit(0)).alias("title"))


@query(
    "S5_read_pmid_map",
    """SELECT CAST(o_orderkey AS VARCHAR) AS pmid,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'PMC' || o_custkey END AS pmcid,
    CASE WHEN o_orderkey % 2 = 0 THEN '10.1/o' || o_orderkey END AS doi FROM orders""",
)
def read_pmid_map(t: Tables):
    return idfiles.read_pmid_map(t.spark, _pmid_file(t)).select("pmid", "pmcid", "doi")


def _pmid_file(t: Tables) -> str:
    path = scratch_path(t.spark, "landed-ids")
    t.orders.select(
        S("o_orderkey").alias("PMID"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("PMC"), S("o_custkey"))).alias("PMCID"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/o"), S("o_orderkey"))).alias("DOI"),
    ).sort("PMID").write.option("header", True).csv(path)
    return path


@query(
    "S5_last_pmid_wins",
    """SELECT 'PMC' || o_custkey AS pmcid, max(CAST(o_orderkey AS VARCHAR)) AS pmid FROM orders
    WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey""",
)
def last_pmid_wins(t: Tables):
    return build_pmid_maps(idfiles.read_pmid_map(t.spark, _pmid_file(t)))["pmcid"].select("pmcid", "pmid")


@query(
    "S6_read_oa_file_list",
    """SELECT l_returnflag AS license, 'PMC' || l_orderkey AS pmcid, 'p/' || l_partkey AS subpath FROM lineitem
    WHERE l_linenumber > 1""",
)
def read_oa_file_list(t: Tables):
    """Lines of the first items are too short and are skipped."""
    path = scratch_path(t.spark, "landed-oa")
    full = F.concat_ws("\t", "l_returnflag", F.lit("c"), F.concat(F.lit("PMC"), S("l_orderkey")), F.lit("x"), F.concat(F.lit("p/"), S("l_partkey")))
    t.lineitem.select(F.when(F.col("l_linenumber") > 1, full).otherwise("short\tline").alias("value")).write.text(path)
    return idfiles.read_oa_file_list(t.spark, path).drop("seq")


@query(
    "S7_read_oa_locations",
    """SELECT '10.1/C' || c_custkey AS doi, CASE WHEN c_acctbal > 0 THEN 'https://oa.example.org/' || c_custkey END AS url
    FROM customer""",
)
def read_oa_locations(t: Tables):
    path = scratch_path(t.spark, "landed-locations")
    link = F.when(F.col("c_acctbal") > 0, F.struct(F.concat(F.lit("https://oa.example.org/"), S("c_custkey")).alias("url_for_pdf")))
    t.customer.select(F.concat(F.lit("10.1/C"), S("c_custkey")).alias("doi"), link.alias("best_oa_location")).write.json(path)
    return idfiles.read_oa_locations(t.spark, path).select("doi", F.col("best_oa_location.url_for_pdf").alias("url"))


@query(
    "S8_read_istex_ids",
    """SELECT 'I' || s_suppkey AS istex_id, '10.1/s' || s_nationkey AS doi, 'corpus' AS corpus_name FROM supplier
    WHERE s_acctbal > 0""",
)
def read_istex_ids(t: Tables):
    """Records without DOI are left out."""
    path = scratch_path(t.spark, "landed-archive")
    dois = F.array(F.concat(F.lit("10.1/s"), S("s_nationkey")))
    t.supplier.select(
        F.lit("corpus").alias("corpusName"), F.concat(F.lit("I"), S("s_suppkey")).alias("istexId"),
        F.when(F.col("s_acctbal") > 0, dois).otherwise(F.slice(dois, 1, 0)).alias("doi"),
    ).write.json(path)
    return idfiles.read_istex_ids(t.spark, path).select("istex_id", F.get("doi", F.lit(0)).alias("doi"), "corpus_name")


@query(
    "W4_write_classes_csv",
    "SELECT c_mktsegment AS level, c_custkey, c_name FROM customer",
)
def write_classes_csv(t: Tables):
    path = scratch_path(t.spark, "classes")
    sinks.write_classes_csv(t.customer.select(F.col("c_mktsegment").alias("level"), "c_custkey", "c_name"), path)
    return t.spark.read.schema("c_custkey long, c_name string, level string").option("header", True).csv(path)


@query("W3_write_report_tsv", "SELECT o_orderkey, o_orderpriority FROM orders")
def write_report_tsv(t: Tables):
    path = scratch_path(t.spark, "report")
    sinks.write_report_tsv(t.orders.select("o_orderkey", "o_orderpriority"), path)
    return t.spark.read.schema("o_orderkey long, o_orderpriority string").option("sep", "\t").csv(path)
