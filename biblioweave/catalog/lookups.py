"""Identifier lookups over orders, customers and line items."""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog import shapes as T
from biblioweave.operators import lookup as L
from biblioweave.operators import search as X
from biblioweave.operators import tables as K
from biblioweave.plans.matching import Store, resolve_requests, route_column
from biblioweave.session import materialise

S = T.S
NOT_FOUND = "'No bibliographical record found'"
LINE_ID = "l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"


def line_id():
    return F.concat_ws("-", S("l_orderkey"), S("l_partkey"), S("l_suppkey"), S("l_linenumber"))


def outcome(rows, *columns):
    return rows.select("req_id", *columns, "record_doi", "json", "status", "reason")


@query(
    "L1_lookup_by_doi",
    f"""WITH {T.WORKS_SQL}
    SELECT o_orderkey AS req_id, doi AS record_doi, json,
        CASE WHEN doi IS NULL THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN doi IS NULL THEN {NOT_FOUND} END AS reason
    FROM orders LEFT JOIN works ON doi = '10.1000/c' || o_custkey""",
)
def lookup_by_doi(t: Tables):
    requests = t.orders.select(
        F.col("o_orderkey").alias("req_id"), F.concat(F.lit("10.1000/C"), S("o_custkey")).alias("doi")
    )
    return outcome(L.lookup_by_doi(requests, T.works(t)))


@query(
    "L2_lookup_by_halid",
    f"""SELECT o_orderkey AS req_id, CAST(NULL AS VARCHAR) AS record_doi,
        '{{"title":"' || s_name || '"}}' AS json,
        CASE WHEN s_suppkey IS NULL THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN s_suppkey IS NULL THEN {NOT_FOUND} END AS reason
    FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""",
)
def lookup_by_halid(t: Tables):
    requests = t.orders.select(
        F.col("o_orderkey").alias("req_id"), F.concat(F.lit("HAL-"), S("o_custkey")).alias("halid")
    )
    return outcome(L.lookup_by_halid(requests, T.hal_works(t)))


def _mapped_sql(key: str, join: str, message: str) -> str:
    return f"""WITH {T.WORKS_SQL}, {T.PMID_SQL}
    SELECT {LINE_ID} AS req_id, works.doi AS record_doi, json,
        CASE WHEN works.doi IS NULL THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN ids.doi IS NULL THEN '{message} ' || {key}
             WHEN works.doi IS NULL THEN {NOT_FOUND} END AS reason
    FROM lineitem LEFT JOIN ids ON {join} LEFT JOIN works ON works.doi = ids.doi"""


@query(
    "L3_lookup_by_pmid",
    _mapped_sql(
        "l_orderkey", "ids.pmid = CAST(l_orderkey AS VARCHAR)",
        "Cannot find bibliographical record with PMID",
    ),
)
def lookup_by_pmid(t: Tables):
    requests = t.lineitem.select(line_id().alias("req_id"), S("l_orderkey").alias("pmid"))
    maps = K.build_pmid_maps(T.pmid_rows(t))
    return outcome(L.lookup_by_pmid(requests, maps["pmid"], T.works(t)))


PMC_KEY = "CASE WHEN l_returnflag = 'N' THEN 'PMC' ELSE '' END || l_orderkey"


@query(
    "L4_lookup_by_pmc",
    _mapped_sql(
        PMC_KEY, "ids.pmcid = 'PMC' || l_orderkey", "Cannot find bibliographical record with PMC ID"
    ),
)
def lookup_by_pmc(t: Tables):
    prefix = F.when(F.col("l_returnflag") == "N", "PMC").otherwise("")
    requests = t.lineitem.select(
        line_id().alias("req_id"), F.concat(prefix, S("l_orderkey")).alias("pmc")
    )
    maps = K.build_pmid_maps(T.pmid_rows(t))
    return outcome(L.lookup_by_pmc(requests, maps["pmcid"], T.works(t)))


def _archive_sql(key: str, message: str) -> str:
    return f"""WITH {T.WORKS_SQL}, {T.ISTEX_SQL}
    SELECT {LINE_ID} AS req_id, istex.istex_id AS archive_id, works.doi AS record_doi, json,
        CASE WHEN works.doi IS NULL THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN doi1 IS NULL THEN '{message} ' || {key}
             WHEN works.doi IS NULL THEN {NOT_FOUND} END AS reason
    FROM lineitem LEFT JOIN istex ON istex.pii = 'S' || l_partkey LEFT JOIN works ON works.doi = doi1"""


@query("L5_lookup_by_pii", _archive_sql("'s' || l_partkey", "Cannot find bibliographical record by PII"))
def lookup_by_pii(t: Tables):
    requests = t.lineitem.select(
        line_id().alias("req_id"), F.concat(F.lit("s"), S("l_partkey")).alias("pii")
    )
    maps = K.build_istex_maps(T.istex_rows(t))
    return outcome(L.lookup_by_pii(requests, maps["pii"], T.works(t)), "archive_id")


@query(
    "L6_lookup_by_istexid",
    _archive_sql(
        "'IX' || lpad(CAST(l_partkey AS VARCHAR), 12, '0')",
        "Cannot find bibliographical record by ISTEX ID",
    ),
)
def lookup_by_istexid(t: Tables):
    requests = t.lineitem.select(
        line_id().alias("req_id"),
        F.concat(F.lit("IX"), F.lpad(S("l_partkey"), 12, "0")).alias("istexid"),
    )
    maps = K.build_istex_maps(T.istex_rows(t))
    return outcome(L.lookup_by_istexid(requests, maps["istex_id"], T.works(t)), "archive_id")


@query(
    "L7_post_validate",
    f"""WITH {T.WORKS_SQL}
    SELECT o_orderkey AS req_id,
        CASE WHEN doi IS NULL OR o_orderstatus = 'P' THEN 'not_found' ELSE 'found' END AS status,
        CASE WHEN doi IS NULL THEN {NOT_FOUND} WHEN o_orderstatus = 'P' THEN
            'Best bibliographical record did not passed the post-validation' END AS reason
    FROM orders LEFT JOIN works ON doi = '10.1000/c' || o_custkey""",
)
def post_validate(t: Tables):
    """Orders that name their customer's title rightly, wrongly or not at all."""
    requests = t.orders.select(
        F.col("o_orderkey").alias("req_id"),
        F.concat(F.lit("10.1000/c"), S("o_custkey")).alias("doi"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit("CUSTOMER#"), F.lpad(S("o_custkey"), 9, "0")),
        ).when(F.col("o_orderstatus") == "P", "zzz").alias("atitle"),
        F.lit("").alias("first_author"),
    )
    found = L.lookup_by_doi(requests, T.works(t), columns=("record_title", "record_author"))
    return L.post_validate(found).select("req_id", "status", "reason")


def _enriched(t: Tables, requests):
    maps, archive = K.build_pmid_maps(T.pmid_rows(t)), K.build_istex_maps(T.istex_rows(t))
    return L.enrich_ids(
        requests, doi="doi", istex_by_doi=archive["doi"], pmid_by_doi=maps["doi"],
        doi_hal=T.doi_hal(t), oa_links=K.build_oa_links(T.oa_locations(t)),
    )


ENRICH_SQL = f"""WITH {T.PMID_SQL}, {T.ISTEX_SQL}, {T.OA_SQL}, {T.HAL_SQL},
e AS (SELECT p_partkey AS req_id, x.istex_id AS "istexId", x.ark, coalesce(x.pmid, m.pmid) AS pmid,
    m.pmcid, x.pii, h.hal_id AS "halId", oa.oa_url AS "oaLink"
    FROM part LEFT JOIN istex_by_doi x ON x.key = '10.1000/c' || p_partkey
    LEFT JOIN by_doi m ON m.doi = '10.1000/c' || p_partkey
    LEFT JOIN doi_hal h ON h.doi = '10.1000/c' || p_partkey
    LEFT JOIN oa ON oa.doi = '10.1000/c' || p_partkey)"""


def part_requests(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("req_id"),
        F.concat(F.lit("crossref:10.1000/C"), S("p_partkey")).alias("doi"),
        F.concat(F.lit('{"a": "'), F.col("p_name"), F.lit('"}')).alias("json"),
    )


@query("L8_enrich_ids", ENRICH_SQL + 'SELECT req_id, "istexId", ark, pmid, pmcid, pii, "halId", "oaLink" FROM e')
def enrich_ids(t: Tables):
    return _enriched(t, part_requests(t)).select(
        "req_id", "istexId", "ark", "pmid", "pmcid", "pii", "halId", "oaLink"
    )


@query(
    "L8_inject_ids",
    ENRICH_SQL + """SELECT req_id, '{"a": "' || p_name || '"'
    || coalesce(', "istexId":"' || "istexId" || '"', '')
    || coalesce(CASE WHEN "istexId" IS NULL THEN ', ' ELSE ',' END || '"ark":"' || ark || '"', '')
    || coalesce(CASE WHEN "istexId" IS NULL THEN ', ' ELSE ',' END || '"pmid":"' || pmid || '"', '')
    || coalesce(',"pmcid":"' || pmcid || '"', '') || coalesce(',"pii":"' || pii || '"', '')
    || coalesce(CASE WHEN "istexId" IS NULL AND pmid IS NULL THEN ', ' ELSE ',' END || '"halId":"' || "halId" || '"', '')
    || coalesce(CASE WHEN "istexId" IS NULL AND pmid IS NULL AND "halId" IS NULL THEN ', ' ELSE ',' END
        || '"oaLink":"' || "oaLink" || '"', '') || '}' AS json FROM e JOIN part ON p_partkey = req_id""",
)
def inject_ids(t: Tables):
    rows = _enriched(t, part_requests(t))
    return rows.select("req_id", L.inject_ids(F.col("json")).alias("json"))


def _oa_sql(parts: str) -> str:
    return f"""WITH {T.PMID_SQL}, {T.ISTEX_SQL}, {T.OA_SQL} {parts}"""


OA_BY_SQL = _oa_sql(
    """, q AS (
    SELECT 'doi' AS kind, CAST(o_custkey AS VARCHAR) AS k, o_orderkey AS req_id, '10.1000/c' || o_custkey AS doi,
        CAST(NULL AS VARCHAR) AS archive, 'DOI 10.1000/C' || o_custkey AS label FROM orders
    UNION ALL SELECT 'pmid', '', o_orderkey, i.doi, NULL, 'PMID ' || o_orderkey
        FROM orders JOIN ids i ON i.pmid = CAST(o_orderkey AS VARCHAR)
    UNION ALL SELECT 'pmc', '', o_orderkey, i.doi, NULL, 'PMC ID ' || o_orderkey
        FROM orders LEFT JOIN ids i ON i.pmcid = 'PMC' || o_orderkey
    UNION ALL SELECT 'pii', '', o_orderkey, x.doi1, x.istex_id, 'pii s' || o_orderkey
        FROM orders LEFT JOIN istex x ON x.pii = 'S' || o_orderkey)"""
)


def _oa_requests(t: Tables):
    key = S("o_orderkey")
    return {
        "doi": t.orders.select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("10.1000/C"), S("o_custkey")).alias("doi")),
        "pmid": t.orders.select(F.col("o_orderkey").alias("req_id"), key.alias("pmid")),
        "pmc": t.orders.select(F.col("o_orderkey").alias("req_id"), key.alias("pmc")),
        "pii": t.orders.select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("s"), key).alias("pii")),
    }


def _oa_ids(t: Tables):
    maps, archive = K.build_pmid_maps(T.pmid_rows(t)), K.build_istex_maps(T.istex_rows(t))
    return {"doi": None, "pmid": maps["pmid"], "pmc": maps["pmcid"], "pii": archive["pii"]}, archive


def _stack(parts):
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "L9_resolve_oa",
    OA_BY_SQL + """SELECT kind, req_id, oa_url,
    CASE WHEN oa_url IS NULL THEN 'not_found' ELSE 'found' END AS status,
    CASE WHEN oa_url IS NULL THEN 'Open Access URL was not found for ' || label END AS reason
    FROM q LEFT JOIN oa ON oa.doi = q.doi""",
)
def resolve_oa(t: Tables):
    links = K.build_oa_links(T.oa_locations(t))
    ids, _ = _oa_ids(t)
    return _stack(
        [
            L.resolve_oa(requests, by, links, ids=ids[by]).select(
                F.lit(by).alias("kind"), "req_id", "oa_url", "status", "reason"
            )
            for by, requests in _oa_requests(t).items()
        ]
    )


@query(
    "L10_resolve_oa_istex",
    OA_BY_SQL + """SELECT kind, req_id, oa_url,
    'https://api.istex.fr/document/' || coalesce(q.archive, x.istex_id) || '/fulltext/pdf' AS istex_url,
    CASE WHEN oa_url IS NULL AND coalesce(q.archive, x.istex_id) IS NULL THEN 'not_found' ELSE 'found' END AS status,
    CASE WHEN oa_url IS NULL AND coalesce(q.archive, x.istex_id) IS NULL
         THEN 'Open Access and Istex URL were not found for ' || label END AS reason
    FROM q LEFT JOIN oa ON oa.doi = q.doi LEFT JOIN istex_by_doi x ON x.key = q.doi""",
)
def resolve_oa_istex(t: Tables):
    links = K.build_oa_links(T.oa_locations(t))
    ids, archive = _oa_ids(t)
    return _stack(
        [
            L.resolve_oa_istex(requests, by, links, archive["doi"], ids=ids[by]).select(
                F.lit(by).alias("kind"), "req_id", "oa_url", "istex_url", "status", "reason"
            )
            for by, requests in _oa_requests(t).items()
        ]
    )


@query(
    "L11_map_ids",
    f"""WITH {T.PMID_SQL}, {T.ISTEX_SQL}
    SELECT {LINE_ID} AS req_id, by_doi.pmid, by_doi.pmcid, x.istex_id,
        CASE WHEN by_doi.doi IS NULL THEN 'not_found' ELSE 'found' END AS status
    FROM lineitem LEFT JOIN by_doi ON by_doi.doi = '10.1000/c' || l_partkey
    LEFT JOIN istex_by_doi x ON x.key = '10.1000/c' || l_partkey""",
)
def map_ids(t: Tables):
    requests = t.lineitem.select(
        line_id().alias("req_id"), F.concat(F.lit("10.1000/c"), S("l_partkey")).alias("doi")
    )
    archive = K.build_istex_maps(T.istex_rows(t))["doi"]
    maps = K.build_pmid_maps(T.pmid_rows(t))
    rows = L.map_ids(
        requests, archive, key="doi", table_key="key", columns={"istex_id": "istex_id"}
    ).drop("status", "reason")
    rows = L.map_ids(
        rows, maps["doi"], key="doi", table_key="doi", columns={"pmid": "pmid", "pmcid": "pmcid"}
    )
    return rows.select("req_id", "pmid", "pmcid", "istex_id", "status")


REQUEST_SQL = """req AS (SELECT o_orderkey AS req_id,
    CASE WHEN o_orderpriority LIKE '1%' THEN '10.1000/c' || o_custkey END AS doi,
    CASE WHEN o_orderpriority LIKE '2%' THEN 'hal-' || o_custkey END AS halid,
    CASE WHEN o_orderpriority LIKE '3%' THEN CAST(o_orderkey AS VARCHAR) END AS pmid,
    CASE WHEN o_orderpriority LIKE '4%' THEN CAST(o_orderkey AS VARCHAR) END AS pmc,
    CASE WHEN o_orderpriority LIKE '5%' AND o_orderstatus = 'F' THEN 's' || o_orderkey END AS pii,
    CASE WHEN o_orderstatus = 'O' THEN 'IX' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS istexid
    FROM orders)"""

ROUTE_SQL = """CASE WHEN doi IS NOT NULL THEN 'doi' WHEN halid IS NOT NULL THEN 'halid'
    WHEN pmid IS NOT NULL THEN 'pmid' WHEN pmc IS NOT NULL THEN 'pmc' WHEN pii IS NOT NULL THEN 'pii'
    WHEN istexid IS NOT NULL THEN 'istexid' ELSE 'none' END"""


def id_requests(t: Tables):
    """Orders that bring one or two kinds of identifier, or none."""
    key, priority = S("o_orderkey"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    text = ("biblio", "atitle", "first_author", "jtitle", "volume", "first_page", "year")
    return t.orders.select(
        F.col("o_orderkey").alias("req_id"),
        F.when(priority.startswith("1"), F.concat(F.lit("10.1000/c"), S("o_custkey"))).alias("doi"),
        F.when(priority.startswith("2"), F.concat(F.lit("hal-"), S("o_custkey"))).alias("halid"),
        F.when(priority.startswith("3"), key).alias("pmid"),
        F.when(priority.startswith("4"), key).alias("pmc"),
        F.when(
            priority.startswith("5") & (F.col("o_orderstatus") == "F"), F.concat(F.lit("s"), key)
        ).alias("pii"),
        F.when(
            F.col("o_orderstatus") == "O", F.concat(F.lit("IX"), F.lpad(key, 12, "0"))
        ).alias("istexid"),
        *[none.alias(c) for c in text],
    )


@query("L12_route", f"WITH {REQUEST_SQL} SELECT req_id, {ROUTE_SQL} AS route FROM req")
def route(t: Tables):
    return id_requests(t).select("req_id", route_column().alias("route"))


@query(
    "L12_resolve_requests",
    f"""WITH {T.WORKS_SQL}, {T.PMID_SQL}, {T.ISTEX_SQL}, {REQUEST_SQL},
    r AS (SELECT *, {ROUTE_SQL} AS route FROM req),
    m AS (SELECT r.req_id, r.route, s.s_suppkey,
        CASE r.route WHEN 'doi' THEN r.doi WHEN 'pmid' THEN a.doi WHEN 'pmc' THEN b.doi
             WHEN 'pii' THEN x.doi1 WHEN 'istexid' THEN y.doi1 END AS wanted
        FROM r LEFT JOIN supplier s ON r.halid = 'hal-' || s.s_suppkey
        LEFT JOIN ids a ON a.pmid = r.pmid LEFT JOIN ids b ON b.pmcid = 'PMC' || r.pmc
        LEFT JOIN istex x ON lower(x.pii) = r.pii LEFT JOIN istex y ON y.istex_id = r.istexid)
    SELECT req_id, route, CASE WHEN route = 'none' THEN 'bad_request'
        WHEN w.doi IS NOT NULL OR (route = 'halid' AND s_suppkey IS NOT NULL) THEN 'found'
        ELSE 'not_found' END AS status, w.doi AS doi
    FROM m LEFT JOIN works w ON w.doi = m.wanted""",
)
def resolve(t: Tables):
    maps, archive = K.build_pmid_maps(T.pmid_rows(t)), K.build_istex_maps(T.istex_rows(t))
    works = T.works(t)
    records = works.select(
        F.concat(F.lit("crossref:"), "doi").alias("id"), "doi",
        F.lit(None).cast("string").alias("hal_id"), F.array("record_title").alias("title"),
        F.col("record_author").alias("first_author"), F.array("record_author").alias("journal"),
        F.array("record_author").alias("abbreviated_journal"), F.lit("1").alias("volume"),
        F.lit("1").alias("first_page"), F.lit("2000").alias("year"),
        F.concat_ws(" ", "record_title", "record_author").alias("bibliographic"),
    )
    store = Store(
        works=works, hal_works=T.hal_works(t), pmid_maps=maps, istex_maps=archive,
        oa_links=K.build_oa_links(T.oa_locations(t)), doi_hal=T.doi_hal(t),
        records=records, index=X.build_index(records, carry=("volume", "first_page")),
    )
    return resolve_requests(id_requests(t), store).select("req_id", "route", "status", "doi")


@query(
    "L13_join_candidates_to_docs",
    f"""WITH {T.WORKS_SQL}
    SELECT o_orderkey AS id, coalesce(w.json, '{{"title":"' || s.s_name || '"}}') AS json
    FROM orders LEFT JOIN works w ON w.doi = '10.1000/c' || o_custkey
    LEFT JOIN supplier s ON s.s_suppkey = o_custkey WHERE w.doi IS NOT NULL OR s.s_suppkey IS NOT NULL""",
)
def join_candidates(t: Tables):
    candidates = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("10.1000/C"), S("o_custkey")).alias("doi"),
        F.concat(F.lit("hal-"), S("o_custkey")).alias("hal_id"),
    )
    return L.join_candidates_to_docs(candidates, T.works(t), T.hal_works(t)).select("id", "json")
