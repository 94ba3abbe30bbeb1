"""Sources in XML and JSON, key stores and writers: whole tables in their shape, read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog import shapes as T
from biblioweave.catalog.files import ITEMS_PER_FILE, WORK_ROWS, _fields, _record
from biblioweave.catalog.lookups import NOT_FOUND, outcome
from biblioweave.functions.ids import normalise_doi
from biblioweave.operators import keystore
from biblioweave.operators import lookup as L
from biblioweave.session import scratch_path
from biblioweave.sources import idfiles, sinks, works, xml
from biblioweave.streaming.updates import current_rows, stream_work_updates

S = T.S
RECORDS_PER_UPDATE = 100_000


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file that may be one row group, dealt to some tasks for each core before each is parsed.

    The number is given, as adaptive execution would put small rows into few tasks.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def _landed(df: DataFrame, label: str, **options) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).text(path)
    return path


def _pages(rows: DataFrame, page: Column, order: str, head: str, tail: str, label: str) -> str:
    """``value`` of the rows of a page as one file, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda r: r["value"])
    files = rows.groupBy(page.alias("page")).agg(_text(head, F.array_join(ordered, "\n"), tail).alias("file"))
    return _landed(files.select(F.col("file").alias("value")), label, maxRecordsPerFile=1, compression="gzip")


OAI = ("<OAI-PMH><ListRecords>", "<resumptionToken>t</resumptionToken></ListRecords></OAI-PMH>")


def _tei(hal_id: Column, doi: Column, title: Column, journal: Column, volume: Column, date: Column) -> Column:
    """A repository record; a null id leaves the element out."""
    own = F.coalesce(_text('<idno type="halId">', hal_id, "</idno>"), F.lit(""))
    return _text(
        '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><listBibl><biblFull><publicationStmt>', own,
        "</publicationStmt><sourceDesc><biblStruct><analytic><title>First title</title><title>", title, "</title></analytic>"
        '<monogr><title level="j">', journal, '</title><imprint><biblScope unit="volume">', volume, "</biblScope>"
        '<date type="datePub">', date, '</date></imprint></monogr><idno type="doi">', doi, "</idno></biblStruct></sourceDesc>"
        '<profileDesc><langUsage><language ident="fra">French</language></langUsage></profileDesc>'
        "</biblFull></listBibl></body></text></TEI>",
    )


def _supplier_tei(t: Tables) -> DataFrame:
    """Suppliers as repository records; those without a balance have no id."""
    key = S("s_suppkey")
    tei = _tei(
        F.when(F.col("s_acctbal") > 0, _text("hal-", key)), _text("10.1/S", key), _text("Paper <i>", key, "</i> of"), F.col("s_name"),
        S("s_nationkey"), F.lit("2019-05-03"),
    )
    return t.supplier.select("s_suppkey", tei.alias("tei"))


HAL_SQL = """SELECT 'hal-' || s_suppkey AS hal_id, '10.1/S' || s_suppkey AS doi, 'Paper ' || s_suppkey || ' of' AS article_title,
    s_name AS title, CAST(s_nationkey AS VARCHAR) AS volume, 2019 AS year, 'fr' AS language FROM supplier"""
HAL_COLUMNS = ("hal_id", "doi", "article_title", "title", "volume")


def _hal(rows: DataFrame) -> DataFrame:
    return rows.select(*HAL_COLUMNS, F.col("publication_date.year").alias("year"), "language")


def _hal_pages(t: Tables) -> str:
    """Response pages of at most ITEMS_PER_FILE records, one file each."""
    doc = F.to_json(F.struct(F.col("tei").alias("label_xml")))
    pages = _supplier_tei(t).groupBy(F.floor(F.col("s_suppkey") / ITEMS_PER_FILE)).agg(
        _text('{"response":{"docs":[', F.array_join(F.collect_list(doc), ","), "]}}").alias("value")
    )
    return _landed(pages.select("value"), "landed-hal", maxRecordsPerFile=1)


@query("S9_read_hal_pages", f"{HAL_SQL} WHERE s_acctbal > 0")
def read_hal_pages(t: Tables):
    return _hal(xml.read_hal_pages(t.spark, _hal_pages(t)))


@query(
    "S9_count_hal_pages",
    "SELECT count(*) FILTER (s_acctbal > 0) AS accepted, count(*) FILTER (s_acctbal <= 0) AS invalid FROM supplier",
)
def count_hal_pages(t: Tables):
    return xml.count_hal_pages(t.spark, _hal_pages(t))


def _oai_pages(t: Tables) -> str:
    prefixed = F.regexp_replace(F.regexp_replace("tei", r"<(/?)(\w)", "<$1tei:$2"), "xmlns=", "xmlns:tei=")
    record = _text("<record><header><identifier>x</identifier></header><metadata>", prefixed, "</metadata></record>")
    rows = _supplier_tei(t).withColumn("value", record)
    return _pages(rows, F.floor(F.col("s_suppkey") / ITEMS_PER_FILE), "s_suppkey", *OAI, "landed-oai")


@query("S10_read_oai_pmh_pages", f"{HAL_SQL} WHERE s_acctbal > 0")
def read_oai_pmh_pages(t: Tables):
    return _hal(xml.read_oai_pmh_pages(t.spark, _oai_pages(t)))


@query("S10_last_record_wins", "SELECT 'n' || s_nationkey AS hal_id, max(s_suppkey) AS supplier FROM supplier GROUP BY s_nationkey")
def last_oai_record_wins(t: Tables):
    """Several records of one id in one file: the place tells which is the last."""
    tei = _tei(_text("n", S("s_nationkey")), F.lit("10.1/x"), F.lit("t"), F.lit("j"), S("s_suppkey"), F.lit("2019"))
    rows = t.supplier.withColumn("value", _text("<record><metadata>", tei, "</metadata></record>"))
    found = xml.read_oai_pmh_pages(t.spark, _pages(rows, F.col("s_nationkey") % 5, "s_suppkey", *OAI, "landed-oai"))
    return found.groupBy("hal_id").agg(F.max_by("volume", "seq").cast("long").alias("supplier"))


@query(
    "S11_read_medline",
    """SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CASE WHEN o_orderstatus = 'O' THEN '10.1/e' ELSE '10.1/a' END || o_orderkey AS doi,
    'PMC' || o_custkey AS pmc, 'Effects of ' || o_orderpriority AS article_title, 'J ' || o_orderstatus AS title,
    CAST(o_custkey AS VARCHAR) AS volume, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
    'One. Two.' AS abstract, 'en' AS language, 'Last' || o_custkey AS first_author, '101' AS start_page, '109' AS end_page,
    o_orderpriority AS mesh, o_orderkey % 2 = 0 AS major, 'Cited ' || o_custkey AS reference FROM orders""",
)
def read_medline(t: Tables):
    key, customer = S("o_orderkey"), S("o_custkey")
    valid = F.when(F.col("o_orderstatus") == "O", "Y").otherwise("N")
    article = _text(
        '<PubmedArticle><MedlineCitation><PMID Version="1">', key, "</PMID><Article><Journal><JournalIssue><Volume>", customer,
        "</Volume><PubDate><Year>", F.year("o_orderdate").cast("string"), "</Year><Month>", F.date_format("o_orderdate", "MM"),
        "</Month></PubDate></JournalIssue><Title>J ", F.col("o_orderstatus"), "</Title></Journal><ArticleTitle>Effects of <i>",
        F.col("o_orderpriority"), "</i></ArticleTitle><Pagination><MedlinePgn>101-9</MedlinePgn></Pagination>",
        '<ELocationID EIdType="doi" ValidYN="', valid, '">10.1/e', key, "</ELocationID><Abstract><AbstractText>One.</AbstractText>"
        "<AbstractText>Two.</AbstractText></Abstract><AuthorList><Author><LastName>Last", customer,
        "</LastName><ForeName>Fore</ForeName></Author></AuthorList><Language>eng</Language></Article><MeshHeadingList><MeshHeading>"
        '<DescriptorName UI="D', key, '" MajorTopicYN="', F.when(F.col("o_orderkey") % 2 == 0, "Y").otherwise("N"), '">',
        F.col("o_orderpriority"), "</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList>"
        '<ArticleId IdType="doi">10.1/a', key, '</ArticleId><ArticleId IdType="pmc">PMC', customer, "</ArticleId></ArticleIdList>"
        "<ReferenceList><Reference><Citation>Cited ", customer, "</Citation></Reference></ReferenceList></PubmedData></PubmedArticle>",
    )
    given = t.orders.withColumn("value", article)
    page = F.floor(F.col("o_orderkey") / ITEMS_PER_FILE)
    rows = xml.read_medline(t.spark, _pages(given, page, "o_orderkey", "<PubmedArticleSet>", "</PubmedArticleSet>", "landed-medline"))
    date, mesh = F.col("publication_date"), F.get("mesh", F.lit(0))["descriptor"]
    return rows.select(
        "pmid", "doi", "pmc", "article_title", "title", "volume", date["year"].alias("year"), date["month"].alias("month"), "abstract",
        "language", F.get("authors", F.lit(0))["last_name"].alias("first_author"), "start_page", "end_page",
        mesh["term"].alias("mesh"), mesh["majorTopic"].alias("major"), F.get("references", F.lit(0))["unstructured"].alias("reference"),
    )


@query(
    "S12_parse_hal_tei",
    """SELECT 'hal-' || p_partkey AS hal_id, '10.2/P' || p_partkey AS doi, 'On ' || p_brand AS article_title, p_type AS title,
    CAST(p_size AS VARCHAR) AS volume, 1950 + p_size AS year, 'fr' AS language FROM part""",
)
def parse_hal_tei(t: Tables):
    key = S("p_partkey")
    tei = _tei(_text("hal-", key), _text("10.2/P", key), _text("On <hi>", F.col("p_brand"), "</hi>"), F.col("p_type"), S("p_size"),
               _text((1950 + F.col("p_size")).cast("string"), "-04"))
    return _hal(xml.parse_hal_tei(_dealt(t.part, "p_partkey").select(tei.alias("tei")), "tei"))


@query(
    "S13_parse_citation_tei",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'On ' || c_mktsegment END AS title,
    CASE WHEN c_acctbal > 0 THEN 'A' || c_custkey END AS author, CASE WHEN c_acctbal <= 0 THEN 'M' || c_custkey END AS monograph_author,
    'J' || c_nationkey AS journal, CAST(1950 + c_nationkey AS VARCHAR) AS year FROM customer""",
)
def parse_citation_tei(t: Tables):
    """Customers with a balance cite articles, the others monographs."""
    name = lambda letter: _text(
        '<author><persName><forename type="first">F</forename><surname>', letter, S("c_custkey"), "</surname></persName></author>"
    )
    article = _text('<analytic><title level="a" type="main">On ', F.col("c_mktsegment"), "</title>", name("A"), "</analytic>")
    own = F.when(F.col("c_acctbal") > 0, article).otherwise("")
    monograph = F.when(F.col("c_acctbal") > 0, "").otherwise(name("M"))
    tei = _text("<biblStruct>", own, "<monogr>", monograph, '<title level="j">J', S("c_nationkey"), '</title><imprint><date when="',
                (1950 + F.col("c_nationkey")).cast("string"), '-05" /></imprint></monogr></biblStruct>')
    rows = xml.parse_citation_tei(_dealt(t.customer, "c_custkey").select("c_custkey", tei.alias("tei")), "tei")
    return rows.select("c_custkey", F.col("parsed_atitle").alias("title"), F.col("parsed_first_author").alias("author"),
                       F.col("parsed_monograph_author").alias("monograph_author"), F.col("parsed_jtitle").alias("journal"),
                       F.col("parsed_year").alias("year"))


def _api_pages(t: Tables) -> str:
    """Update pages of ITEMS_PER_FILE items; every tenth page has the cursor of the one before."""
    page = F.floor(F.col("event_id") / ITEMS_PER_FILE)
    cursor = F.when(F.col("page") % 10 == 9, F.col("page") - 1).otherwise(F.col("page"))
    pages = _record(t).groupBy(page.alias("page")).agg(F.array_join(F.collect_list("value"), ",").alias("items"))
    value = _text('{"message":{"next-cursor":"c', cursor.cast("string"), '","items":[', F.col("items"), "]}}")
    return _landed(pages.select(value.alias("value")), "landed-pages", maxRecordsPerFile=1)


@query("S14_read_api_pages", WORK_ROWS)
def read_api_pages(t: Tables):
    return _fields(works.read_api_pages(t.spark, _api_pages(t)))


@query(
    "S14_page_cursors",
    f"""WITH pages AS (SELECT event_id // {ITEMS_PER_FILE} AS page, count(*) AS items FROM events GROUP BY 1)
    SELECT 'c' || CASE WHEN page % 10 = 9 THEN page - 1 ELSE page END AS next_cursor, count(*) AS pages, CAST(sum(items) AS BIGINT) AS items,
    count(*) > 1 AS repeated FROM pages GROUP BY 1""",
)
def page_cursors(t: Tables):
    return works.page_cursors(t.spark, _api_pages(t)).drop("files")


@query(
    "S15_read_mesh_selection",
    """SELECT p_type AS level1, p_brand AS level2, p_name AS level3, 'D' || p_partkey AS descriptor FROM part WHERE p_size <= 25""",
)
def read_mesh_selection(t: Tables):
    """Rows of larger parts have a field too many and are skipped."""
    more = F.when(F.col("p_size") > 25, ",x").otherwise("")
    quoted = lambda c: _text('"', F.col(c), '"')
    line = F.concat(F.concat_ws(",", quoted("p_type"), quoted("p_brand"), quoted("p_name"), _text("D", S("p_partkey"))), more)
    return idfiles.read_mesh_selection(t.spark, _landed(t.part.select(line.alias("value")), "landed-selection"))


@query(
    "S16_read_enrichment_json",
    """SELECT '10.1/C' || c_custkey AS doi, c_mktsegment AS abstract, 'Lab ' || c_nationkey AS affiliation, c_name AS org FROM customer""",
)
def read_enrichment_json(t: Tables):
    """Array files of entries with ids, affiliations and funding."""
    entry = F.struct(
        F.array(F.struct(F.lit("doi").alias("type"), _text("10.1/C", S("c_custkey")).alias("value"))).alias("external_ids"),
        F.col("c_mktsegment").alias("abstract"),
        F.array(F.struct(F.array(F.struct(_text("Lab ", S("c_nationkey")).alias("name"))).alias("affiliations"))).alias("authors"),
        F.array(F.struct(F.col("c_name").alias("org"))).alias("funding"),
    )
    files = t.customer.groupBy(F.floor(F.col("c_custkey") / ITEMS_PER_FILE)).agg(
        _text("[", F.array_join(F.collect_list(F.to_json(entry)), ",\n"), "]").alias("value")
    )
    rows = idfiles.read_enrichment_json(t.spark, _landed(files.select("value"), "landed-enrichment", maxRecordsPerFile=1))
    first = lambda c: F.get(F.col(c), F.lit(0))
    return rows.select(first("external_ids")["value"].alias("doi"), "abstract",
                       F.get(first("authors")["affiliations"], F.lit(0))["name"].alias("affiliation"), first("funding")["org"].alias("org"))


@query(
    "S16_read_records_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS pmid, 'Part "' || p_name || '",' || chr(10) || p_brand AS title, p_type AS keywords FROM part""",
)
def read_records_csv(t: Tables):
    """Titles with quotes, commas and line breaks."""
    title = _text('Part "', F.col("p_name"), '",\n', F.col("p_brand"))
    given = {"pmid": S("p_partkey"), "title": title, "keywords": F.col("p_type")}
    rows = t.part.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in idfiles.EXPORT_COLUMNS])
    path = scratch_path(t.spark, "landed-records")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return idfiles.read_records_csv(t.spark, path).select("pmid", "title", "keywords")


def _store(df: DataFrame, label: str, key: str) -> keystore.KeyStore:
    """A key store that is written and opened again by its path."""
    path, name = scratch_path(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    written = keystore.write_store(df, path, key=key, name=name, buckets=8)
    return keystore.open_store(df.sparkSession, path, key=key, name=f"{name}_again", buckets=written.buckets)


@query("W1_write_key_table", f"WITH {T.WORKS_SQL} SELECT * FROM works")
def write_key_table(t: Tables):
    return _store(T.works(t), "stored-works", "doi").rows


@query(
    "W1_lookup_in_store",
    f"""WITH {T.WORKS_SQL}
    SELECT o_orderkey AS req_id, doi AS record_doi, json, CASE WHEN doi IS NULL THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN doi IS NULL THEN {NOT_FOUND} END AS reason
    FROM orders LEFT JOIN works ON doi = '10.1000/c' || o_custkey""",
)
def lookup_in_store(t: Tables):
    """The lookup by DOI with a store that stays in its buckets."""
    requests = t.orders.select(F.col("o_orderkey").alias("req_id"), _text("10.1000/C", S("o_custkey")).alias("doi"))
    store = _store(T.works(t), "stored-works", "doi")
    return outcome(L.lookup_by_doi(requests, store.rows_for(requests, normalise_doi(F.col("doi")))))


@query(
    "W1_merge_store",
    """SELECT '10.1000/c' || c_custkey AS doi, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders)
        THEN (SELECT 'order ' || max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) ELSE c_name END AS record_title FROM customer
    UNION ALL SELECT '10.1000/c' || o_custkey, 'order ' || max(o_orderkey) FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""",
)
def merge_store(t: Tables):
    """Customers' records, replaced by their latest order's."""
    base = _store(T.works(t).select("doi", F.col("record_title"), F.lit(0).cast("long").alias("version")), "stored-works", "doi")
    changes = t.orders.select(
        _text("10.1000/c", S("o_custkey")).alias("doi"), _text("order ", S("o_orderkey")).alias("record_title"), F.col("o_orderkey").cast("long").alias("version")
    )
    merged = keystore.merge_store(base, changes, scratch_path(t.spark, "merged-works"), name=f"merged_{uuid.uuid4().hex}", order_by=[F.col("version").desc()])
    return merged.rows.select("doi", "record_title")


@query(
    "W1_only_requested",
    "SELECT '10.1000/c' || c_custkey AS doi FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def only_requested(t: Tables):
    """Rows that pass the bitmap of request keys, then the join."""
    requests = t.orders.where("o_orderstatus = 'P'").select(_text("10.1000/c", S("o_custkey")).alias("wanted"))
    rows = keystore.only_requested(T.works(t).select("doi"), "doi", requests, F.col("wanted"))
    return rows.join(requests, F.col("doi") == F.col("wanted"), "left_semi")


@query(
    "W2_write_jsonl",
    """SELECT '10.1000/c' || c_custkey AS doi, c_name AS title FROM customer""",
)
def write_jsonl(t: Tables):
    path = scratch_path(t.spark, "chunks")
    sinks.write_jsonl(T.works(t), path)
    lines = t.spark.read.text(path).select(F.from_json("value", "title string").alias("w"))
    numbered = lines.select(F.col("w.title").alias("title"), F.regexp_extract("w.title", r"#0*(\d+)$", 1).alias("n"))
    return numbered.select(_text("10.1000/c", F.col("n")).alias("doi"), "title")


@query("W5_write_oa_hits", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'https://oa.example.org/' || o_custkey AS url FROM orders")
def write_oa_hits(t: Tables):
    path = scratch_path(t.spark, "hits")
    sinks.write_oa_hits(t.orders.select(S("o_orderkey").alias("id"), _text("https://oa.example.org/", S("o_custkey")).alias("url")), path)
    return t.spark.read.schema("id string, url string").json(path)


@query(
    "ST6_clean_applied_files",
    """SELECT '10.9/e' || event_id AS doi, event_type AS type, true AS cleaned FROM events""",
)
def clean_applied_files(t: Tables):
    """Events in three batches of files and an empty file; files of completed batches are deleted."""
    root = scratch_path(t.spark, "cleaned")
    landing = f"{root}/landing"
    # one task reads a gzip file, so files are bounded and a batch has more of them
    per_batch = max(1, math.ceil(t.events.count() / (3 * RECORDS_PER_UPDATE)))
    _record(t).repartition(3 * per_batch).select("value").write.option("compression", "gzip").text(landing)
    t.events.limit(0).select(F.lit("").alias("value")).coalesce(1).write.mode("append").option("compression", "gzip").text(landing)
    before = t.spark.read.format("binaryFile").load(landing).select("path").count()
    stream_work_updates(
        t.spark, landing, f"{root}/tables", f"{root}/checkpoint", files="*.gz", files_per_batch=per_batch, clean=True
    ).awaitTermination()
    left = t.spark.read.format("binaryFile").load(landing).select("path").count()
    rows = current_rows(t.spark, f"{root}/tables/works", key="doi")
    return rows.select("doi", "type", F.lit(left < before).alias("cleaned"))
