"""Key tables built from the test tables."""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog import shapes as T
from biblioweave.functions.dates import PARTIAL_DATE
from biblioweave.operators import records as R
from biblioweave.operators import tables as K
from biblioweave.session import materialise, scratch_root

S = T.S
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def event_records(t: Tables):
    """Events as versions of one record per user; errors are a filtered type."""
    return t.events.select(
        F.concat(F.lit("10.9/U"), S("user_id")).alias("doi"),
        F.when(F.col("event_type") == "error", "component").otherwise(F.col("event_type")).alias("type"),
        F.to_json(F.struct("event_id", "event_type", F.col("props").alias("reference"))).alias("json"),
        F.col("ts").cast("timestamp").alias("indexed_ts"),
        F.col("event_id").alias("seq"),
    )


@query(
    "K1_build_works",
    """SELECT doi, type, seq, '{"event_id":' || seq || ',"event_type":"' || type || '"}' AS json
    FROM (SELECT '10.9/u' || user_id AS doi, event_type AS type, event_id AS seq, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
        FROM events WHERE event_type <> 'error') WHERE n = 1""",
)
def build_works(t: Tables):
    rows = K.build_works(event_records(t), ignored_fields=R.IGNORED_FIELDS)
    return rows.select("doi", "type", "seq", "json")


@query(
    "K2_build_oa_links",
    """SELECT doi, oa_url FROM (SELECT lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS doi,
        url AS oa_url, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^https?://([^/]+)', 1))
        ORDER BY page_id DESC) AS n FROM pages WHERE url LIKE 'https%') WHERE n = 1""",
)
def build_oa_links(t: Tables):
    url = F.col("url")
    rows = t.pages.select(
        F.upper(F.regexp_extract(url, "^https?://([^/]+)", 1)).alias("doi"),
        F.struct(F.when(url.startswith("https"), url).otherwise("").alias("url_for_pdf")).alias(
            "best_oa_location"
        ),
        F.col("page_id").alias("updated"),
    )
    return K.build_oa_links(rows)


@query(
    "K3_build_pmid_maps",
    f"""WITH {T.PMID_SQL}
    SELECT 'doi' AS keyed_by, pmid, pmcid, doi FROM by_doi
    UNION ALL SELECT 'pmid', pmid, pmcid, doi FROM ids
    UNION ALL SELECT 'pmcid', pmid, pmcid, doi FROM ids WHERE pmcid IS NOT NULL""",
)
def build_pmid_maps(t: Tables):
    parts = [
        df.select(F.lit(key).alias("keyed_by"), "pmid", "pmcid", "doi")
        for key, df in K.build_pmid_maps(T.pmid_rows(t)).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def oa_files(t: Tables):
    """Line items as the open-access file list."""
    return t.lineitem.select(
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("license"),
        F.concat(F.lit("PMC"), S("l_orderkey")).alias("pmcid"),
        F.concat(F.lit("oa/"), S("l_partkey")).alias("subpath"),
    )


@query(
    "K4_enrich_pmid_with_oa_files",
    f"""WITH {T.PMID_SQL},
    f AS (SELECT 'PMC' || l_orderkey AS pmcid, max(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS license,
          max('oa/' || l_partkey) AS subpath FROM lineitem GROUP BY 1)
    SELECT i.pmid, i.pmcid, f.license, f.subpath FROM ids i LEFT JOIN f USING (pmcid)""",
)
def enrich_pmid(t: Tables):
    rows = K.enrich_pmid_with_oa_files(T.pmid_rows(t), oa_files(t))
    return rows.select("pmid", "pmcid", "license", "subpath")


@query(
    "K4_count_unknown_pmc",
    f"""WITH {T.PMID_SQL} SELECT count(*) AS unknown_pmc FROM lineitem
    WHERE 'PMC' || l_orderkey NOT IN (SELECT pmcid FROM ids WHERE pmcid IS NOT NULL)""",
)
def count_unknown_pmc(t: Tables):
    return K.count_unknown_pmc(T.pmid_rows(t), oa_files(t))


@query(
    "K5_build_istex_maps",
    f"""WITH {T.ISTEX_SQL}
    SELECT 'doi' AS keyed_by, key, istex_id FROM istex_by_doi
    UNION ALL SELECT 'pii', lower(pii), istex_id FROM istex
    UNION ALL SELECT 'istex_id', istex_id, istex_id FROM istex""",
)
def build_istex_maps(t: Tables):
    parts = [
        df.select(F.lit(name).alias("keyed_by"), "key", "istex_id")
        for name, df in K.build_istex_maps(T.istex_rows(t)).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "K6_add_missing_istex",
    """SELECT o_custkey AS key, 'old' AS origin, o_orderkey FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_custkey, 'new', o_orderkey FROM orders WHERE o_orderstatus <> 'F'
        AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def add_missing_istex(t: Tables):
    def rows(chosen, origin):
        return t.orders.filter(chosen).select(
            F.col("o_custkey").alias("key"), F.lit(origin).alias("origin"), "o_orderkey"
        )

    return K.add_missing_istex(rows("o_orderstatus = 'F'", "old"), rows("o_orderstatus <> 'F'", "new"))


@query(
    "K7_build_hal_works",
    """SELECT 'hal-' || s_suppkey AS hal_id, '10.1000/c' || s_nationkey AS doi,
    '{"source":"hal","DOI":"10.1000/c' || s_nationkey || '","prefix":"10.1000","URL":"http://dx.doi.org/10.1000/c'
    || s_nationkey || '","title":["' || s_name || '"],"halId":"HAL-' || s_suppkey || '"}' AS json,
    CASE WHEN row_number() OVER (PARTITION BY s_nationkey ORDER BY 'hal-' || s_suppkey DESC) = 1
         THEN 1 ELSE 0 END AS is_doi_owner FROM supplier""",
)
def build_hal_works(t: Tables):
    rows = T.biblio(
        t,
        hal_id=F.concat(F.lit("HAL-"), S("s_suppkey")),
        doi=F.concat(F.lit("10.1000/c"), S("s_nationkey")),
        article_title=F.col("s_name"),
    )(t.supplier)
    works, doi_hal = K.build_hal_works(rows)
    owners = doi_hal.select("hal_id", F.lit(1).alias("is_doi_owner"))
    return works.join(owners, "hal_id", "left").withColumn(
        "is_doi_owner", F.coalesce("is_doi_owner", F.lit(0))
    )


WORK_JSON_SQL = """'{"source":"pubmed"'
    || coalesce(',"DOI":"' || doi || '","prefix":"10.1000","URL":"http://dx.doi.org/' || doi || '"', '')
    || ',"type":"' || o_orderstatus || '","publisher":"Orders","volume":"' || year(o_orderdate)
    || '","journal-issue":{"issue":"' || month(o_orderdate) || '"},"issue":"' || month(o_orderdate)
    || '","page":"' || CASE WHEN o_orderkey = o_custkey THEN '' || o_orderkey ELSE o_orderkey || '-' || o_custkey END
    || '","title":["[Order of ' || o_orderpriority || '].'
    || '"],"container-title":["' || o_orderpriority || '"],"author":[{"given":"Ann","family":"Customer'
    || o_custkey || '","sequence":"first"},{"given":"Bob C","family":"' || o_orderpriority
    || '","sequence":"additional"}],"published":{"date-parts":[' || year(o_orderdate) || ','
    || month(o_orderdate) || ',' || day(o_orderdate) || '],"date-time":"'
    || strftime(o_orderdate, '%Y-%m-%d') || '"}'"""

MESH_JSON_SQL = """',"mesh":[{"descriptor":{"term":"' || o_orderpriority || '","meshId":"'
    || substr(o_orderpriority, 1, 1) || '","majorTopic":"' || (o_orderstatus = 'O')
    || '"},"qualifiers":[{"qualifier":{"term":"q","meshId":"Q1","majorTopic":"' || (o_orderstatus = 'F')
    || '"}}]}]'"""

REF_JSON_SQL = """',"reference-count":2,"reference":[{"unstructured":"ref ' || o_orderkey || '","pmid":"'
    || o_custkey || '"},{"unstructured":"second","DOI":"10.1000/c' || o_custkey || '"}]}'"""

ORDER_IDS_SQL = """o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN '10.1000/c' || o_custkey END AS doi,
    CASE WHEN o_orderstatus = 'P' THEN 'PMC' || o_orderkey END AS pmc FROM orders)"""


@query(
    "K8_biblio_to_work",
    f"""WITH {ORDER_IDS_SQL}
    SELECT o_orderkey AS pmid, {WORK_JSON_SQL} || ',"pmid":"' || o_orderkey || '"'
    || coalesce(',"pmcid":"' || pmc || '"', '') || {MESH_JSON_SQL}
    || coalesce(',"link":[{{"URL":"https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmc
                || '/pdf/","content-type":"application/pdf"}}]', '')
    || {REF_JSON_SQL} AS json FROM o""",
)
def biblio_to_work(t: Tables):
    rows = K.biblio_to_work(T.order_biblio(t), source="pubmed")
    return rows.select(F.col("pmid").cast("long").alias("pmid"), "json")


@query(
    "K9_fill_missing_ids",
    f"""WITH {T.PMID_SQL},
    q AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS rec,
        CASE WHEN l_returnflag = 'A' THEN CAST(l_orderkey AS VARCHAR) END AS pmid,
        CASE WHEN l_returnflag = 'N' THEN '10.1000/c' || l_partkey END AS doi,
        CASE WHEN l_returnflag = 'R' THEN 'PMC' || l_orderkey END AS pmc FROM lineitem),
    d AS (SELECT q.rec, q.pmid, q.pmc, coalesce(q.doi, a.doi, b.doi) AS doi, a.pmcid AS pmc1, b.pmid AS pmid2
          FROM q LEFT JOIN ids a ON a.pmid = q.pmid LEFT JOIN ids b ON b.pmcid = q.pmc)
    SELECT d.rec, d.doi, coalesce(d.pmid, c.pmid, d.pmid2) AS pmid, coalesce(d.pmc, d.pmc1, c.pmcid) AS pmc
    FROM d LEFT JOIN by_doi c ON c.doi = d.doi""",
)
def fill_missing_ids(t: Tables):
    flag, key = F.col("l_returnflag"), S("l_orderkey")
    rows = t.lineitem.select(
        F.concat_ws("-", key, S("l_partkey"), S("l_suppkey"), S("l_linenumber")).alias("rec"),
        F.when(flag == "A", key).alias("pmid"),
        F.when(flag == "N", F.concat(F.lit("10.1000/c"), S("l_partkey"))).alias("doi"),
        F.when(flag == "R", F.concat(F.lit("PMC"), key)).alias("pmc"),
    )
    maps = K.build_pmid_maps(T.pmid_rows(t))
    return K.fill_missing_ids(rows, maps, spread_by="rec").select("rec", "doi", "pmid", "pmc")


@query(
    "K9_fill_reference_ids",
    f"""WITH {T.PMID_SQL}
    SELECT o.o_orderkey AS pmid, '' || o_custkey || '|' || coalesce(r.doi, '') || '|' || coalesce(r.pmcid, c1.pmcid, '')
        || '#' || coalesce(c.pmid, '') || '|' || '10.1000/c' || o_custkey || '|'
        || coalesce(c.pmcid, '') AS refs
    FROM orders o LEFT JOIN ids r ON r.pmid = CAST(o.o_custkey AS VARCHAR)
    LEFT JOIN by_doi c1 ON c1.doi = r.doi
    LEFT JOIN by_doi c ON c.doi = '10.1000/c' || o.o_custkey""",
)
def fill_reference_ids(t: Tables):
    rows = K.fill_reference_ids(T.order_biblio(t), K.build_pmid_maps(T.pmid_rows(t)))
    text = F.transform(
        "references",
        lambda r: F.concat_ws(
            "|", *[F.coalesce(r[c], F.lit("")) for c in ("pmid", "doi", "pmc")]
        ),
    )
    return rows.select(F.col("pmid").cast("long").alias("pmid"), F.array_join(text, "#").alias("refs"))


def part_works(t: Tables):
    """Parts as works of three sources; one part type is a filtered type."""
    kind = F.col("p_type")
    none = F.lit(None).cast("string")
    author = lambda name, seq: F.struct(
        none.alias("given"), name.alias("family"), F.lit(seq).alias("sequence")
    )
    return t.part.select(
        F.concat(F.lit("10.3/"), S("p_partkey")).alias("doi"),
        F.concat(F.lit("hal-"), S("p_partkey")).alias("hal_id"),
        F.when(kind == "ECONOMY", "HAL").when(kind == "PROMO", "other")
        .when(kind == "LARGE", none).otherwise("Crossref").alias("source"),
        F.when(kind == "STANDARD", "component").otherwise("article").alias("type"),
        F.array(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n  part")), F.lit("  ")).alias("title"),
        F.array(author(F.col("p_type"), "additional"), author(F.col("p_brand"), "first")).alias("author"),
        F.concat(S("p_size"), F.lit("-99")).alias("page"),
        F.array(F.concat(F.lit("Journal of  "), F.col("p_type"))).alias("container_title"),
        F.array(F.lit(" ")).alias("short_container_title"),
        S("p_size").alias("volume"),
        F.lit("").alias("issue"),
        (F.col("p_size") + 1950).cast("string").alias("year"),
    )


@query(
    "K10_build_search_records",
    """SELECT CASE WHEN p_type = 'ECONOMY' THEN 'hal:hal-' || p_partkey ELSE 'crossref:10.3/' || p_partkey END AS id,
    ' ' || p_name || ' part' AS title, p_brand AS first_author, p_type || ' ' || p_brand AS author,
    CAST(p_size AS VARCHAR) AS first_page, 'Journal of ' || p_type AS journal,
    p_type || ' ' || p_brand || '  ' || p_name || ' part Journal of ' || p_type || ' ' || p_size || ' ' || p_size
    || ' ' || (p_size + 1950) AS bibliographic FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM')""",
)
def build_search_records(t: Tables):
    rows = R.build_search_records(part_works(t))
    return rows.select(
        "id", F.array_join("title", "|").alias("title"), "first_author", "author", "first_page",
        F.array_join("journal", "|").alias("journal"), "bibliographic",
    )


@query(
    "K11_build_pubmed_mesh_table",
    f"""WITH {T.PMID_SQL}, {ORDER_IDS_SQL}
    SELECT o.o_orderkey AS pmid, coalesce(o.doi, i.doi) AS doi,
        coalesce(o.pmc, c.pmcid) AS pmc, substr(o_orderpriority, 1, 1) AS mesh_id
    FROM o JOIN ids i ON i.pmid = CAST(o.o_orderkey AS VARCHAR) LEFT JOIN by_doi c ON c.doi = i.doi""",
)
def build_pubmed_mesh_table(t: Tables):
    rows = K.build_pubmed_mesh_table(T.order_biblio(t), K.build_pmid_maps(T.pmid_rows(t)))
    return rows.select(
        F.col("pmid").cast("long").alias("pmid"), "doi", "pmc",
        F.get("mesh", F.lit(0))["descriptor"]["meshId"].alias("mesh_id"),
    )


@query(
    "K12_upsert_works",
    """SELECT '10.9/u' || user_id AS doi, event_id AS seq, event_type AS type FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error')
    WHERE n = 1""",
)
def upsert_works(t: Tables):
    rows = R.reject_incomplete(event_records(t)).withColumn("doi", F.lower("doi"))
    current = rows.filter(F.col("type").isin("view", "click"))
    updates = rows.filter(~F.col("type").isin("view", "click"))
    return K.upsert_works(current, updates).select("doi", "seq", "type")


@query("K13_drop_column_and_reindex", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_column_and_reindex(t: Tables):
    return K.drop_column_and_reindex(t.documents, "text")


@query("K13_drop_components", "SELECT doc_id, lang, source FROM documents WHERE lang <> 'de'")
def drop_components(t: Tables):
    return K.drop_components(
        t.documents.select("doc_id", "lang", "source"), kind="lang", dropped=("de",)
    )


@query(
    "K14_correct_records",
    """WITH s AS (SELECT o_custkey AS k, max(o_orderpriority) AS title, count(*) AS n,
        max(CASE WHEN o_orderstatus = 'P' THEN '10.1000/n' || o_custkey END) AS doi,
        max(year(o_orderdate)) AS y FROM orders GROUP BY 1)
    SELECT c_custkey AS pmid, coalesce(s.title, c_name) AS title, coalesce(s.doi, 'old') AS doi,
        CASE WHEN s.k IS NOT NULL THEN 'new,list' ELSE 'old' END AS authors,
        CASE WHEN c_acctbal < 0 AND s.k IS NOT NULL THEN s.y
             WHEN c_acctbal < 0 THEN NULL ELSE 2001 END AS year
    FROM customer LEFT JOIN s ON s.k = c_custkey""",
)
def correct_records(t: Tables):
    """Customers corrected by what their orders say."""
    old = t.customer.select(
        F.col("c_custkey").alias("pmid"), F.col("c_name").alias("title"), F.lit("old").alias("doi"),
        F.array(F.lit("old")).alias("authors"),
        F.when(
            F.col("c_acctbal") >= 0,
            F.struct(F.lit(2001).alias("year"), F.lit(2).alias("month"), F.lit(None).cast("int").alias("day")),
        ).cast(PARTIAL_DATE).alias("publication_date"),
    )
    new = t.orders.groupBy(F.col("o_custkey").alias("pmid")).agg(
        F.max("o_orderpriority").alias("title"),
        F.max(
            F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("10.1000/n"), S("o_custkey")))
        ).alias("doi"),
        F.max(F.year("o_orderdate")).alias("y"),
    ).select(
        "pmid", "title", "doi", F.array(F.lit("new"), F.lit("list")).alias("authors"),
        F.struct(
            F.col("y").alias("year"), F.lit(None).cast("int").alias("month"),
            F.lit(None).cast("int").alias("day"),
        ).cast(PARTIAL_DATE).alias("publication_date"),
    )
    rows = K.correct_records(old, new, key="pmid")
    return rows.select(
        "pmid", "title", "doi", F.array_join("authors", ",").alias("authors"),
        F.col("publication_date.year").alias("year"),
    )


@query(
    "P1_reject_incomplete",
    "SELECT event_id AS seq, event_type AS type FROM events WHERE event_type <> 'error'",
)
def reject_incomplete(t: Tables):
    return R.reject_incomplete(event_records(t)).select("seq", "type")


@query(
    "A6_load_metrics",
    """SELECT count(*) AS seen, count(*) FILTER (WHERE event_type <> 'error') AS stored,
    count(*) FILTER (WHERE event_type = 'error') AS rejected,
    count(*) FILTER (WHERE event_type IN ('view', 'click')) AS indexed,
    count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS failed FROM events""",
)
def load_metrics(t: Tables):
    rows = event_records(t).withColumn(
        "source", F.when(F.col("type") == "view", "HAL").when(F.col("type") == "click", "crossref").otherwise("x")
    )
    return R.load_metrics(rows, source="source")


@query("A7_high_water_mark", f"SELECT max({TS_SQL}) AS last_indexed FROM events")
def high_water_mark(t: Tables):
    rows = R.high_water_mark(event_records(t))
    return rows.select(F.date_format("last_indexed", TS).alias("last_indexed"))


@query(
    "ST2_update_window_start",
    """SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE user_id =
        (SELECT max(user_id) FROM events))""",
)
def update_window(t: Tables):
    """Events since the last one of the newest user."""
    from biblioweave.streaming.updates import updates_since

    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("indexed_ts"))
    # the greatest (user, time) pair holds the newest user's last time
    mark = rows.agg(F.max(F.struct("user_id", "indexed_ts"))["indexed_ts"].alias("last_indexed"))
    return updates_since(rows, mark).select("event_id")


@query("ST3_persist_high_water_mark", f"SELECT max({TS_SQL}) AS last_indexed FROM events")
def persist_mark(t: Tables):
    """Marks of every event type stored one after the other; the latest counts."""
    import uuid

    from biblioweave.streaming import updates as U

    path = f"{scratch_root(t.spark)}/marks-{uuid.uuid4().hex}"
    rows = event_records(t)
    early = R.high_water_mark(rows.filter("type = 'component'"))
    U.persist_high_water_mark(R.high_water_mark(rows), path, run_finished=False)
    U.persist_high_water_mark(early, path, run_finished=False)
    return U.read_high_water_mark(t.spark, path).select(
        F.date_format("last_indexed", TS).alias("last_indexed")
    )


def _streamed(t: Tables) -> str:
    """Land the events as update files, stream them into tables; the table folder."""
    import uuid

    from biblioweave.streaming.updates import stream_work_updates

    root = f"{scratch_root(t.spark)}/stream-{uuid.uuid4().hex}"
    lines = t.events.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("10.9/U"), S("user_id")).alias("DOI"),
                F.when(F.col("event_type") == "error", "component").otherwise(F.col("event_type")).alias("type"),
                F.concat(F.lit("Event "), S("event_id")).alias("title"),
                F.struct(
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("date-time")
                ).alias("indexed"),
            )
        ).alias("value")
    )
    lines.write.option("compression", "gzip").text(f"{root}/landing")
    stream_work_updates(
        t.spark, f"{root}/landing", f"{root}/tables", f"{root}/checkpoint", files="*.gz"
    ).awaitTermination()
    return f"{root}/tables"


@query(
    "ST1_stream_work_updates",
    """SELECT '10.9/u' || user_id AS doi, 'Event ' || event_id AS title FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1""",
)
def stream_work_updates(t: Tables):
    from biblioweave.streaming.updates import current_rows

    rows = current_rows(t.spark, f"{_streamed(t)}/works", key="doi")
    return rows.select("doi", F.get("title", F.lit(0)).alias("title"))


@query(
    "ST4_stream_search_records",
    """SELECT 'crossref:10.9/u' || user_id AS id, 'Event ' || event_id AS bibliographic FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events
        WHERE event_type <> 'error') WHERE n = 1""",
)
def stream_search_records(t: Tables):
    from biblioweave.streaming.updates import current_rows

    rows = current_rows(t.spark, f"{_streamed(t)}/search", key="id")
    return rows.select("id", "bibliographic")


@query(
    "ST5_stream_metrics",
    """SELECT count(*) AS seen, count(*) FILTER (WHERE event_type <> 'error') AS stored,
    count(*) FILTER (WHERE event_type = 'error') AS rejected,
    count(*) FILTER (WHERE event_type <> 'error') AS indexed, 0 AS failed FROM events""",
)
def stream_metrics(t: Tables):
    from biblioweave.streaming.updates import run_metrics

    return run_metrics(t.spark, _streamed(t))
