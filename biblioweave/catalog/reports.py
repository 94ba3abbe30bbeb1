"""Reports, coverage, mappings, exports and enrichment merges."""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog import shapes as T
from biblioweave.catalog.keytables import (
    MESH_JSON_SQL, ORDER_IDS_SQL, WORK_JSON_SQL,
)
from biblioweave.operators import audit as A
from biblioweave.operators import reports as R
from biblioweave.operators import tables as K
from biblioweave.schemas import EXPORT_COLUMNS

S = T.S


@query(
    "A4_table_sizes",
    f"""WITH {T.PMID_SQL}, {T.ISTEX_SQL}, {T.OA_SQL}
    SELECT 'works' AS table_name, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'pmid_by_doi', count(*) FROM by_doi
    UNION ALL SELECT 'istex_by_doi', count(*) FROM istex_by_doi
    UNION ALL SELECT 'oa_links', count(*) FROM oa""",
)
def table_sizes(t: Tables):
    return A.table_sizes(
        {
            "works": T.works(t),
            "pmid_by_doi": K.build_pmid_maps(T.pmid_rows(t))["doi"],
            "istex_by_doi": K.build_istex_maps(T.istex_rows(t))["doi"],
            "oa_links": K.build_oa_links(T.oa_locations(t)),
        }
    )


@query(
    "A5_sample_rows",
    f"WITH {T.OA_SQL} SELECT doi, oa_url FROM oa ORDER BY doi LIMIT 100",
)
def sample_rows(t: Tables):
    return A.sample_rows(K.build_oa_links(T.oa_locations(t)), "doi", n=100)


COVERAGE_SQL = f"""WITH {T.PMID_SQL}, {T.OA_SQL},
rows AS (SELECT 'archive' AS kind, '10.1000/c' || o_custkey AS doi FROM orders
         UNION ALL SELECT 'pmc', doi FROM ids
         UNION ALL SELECT 'list', '10.1000/c' || p_partkey FROM part)"""


def _coverage_inputs(t: Tables):
    return {
        "archive": T.istex_rows(t),
        "pmc": T.pmid_rows(t),
        "list": t.part.select(F.concat(F.lit("10.1000/C"), S("p_partkey")).alias("doi")),
    }


@query(
    "A8_oa_coverage",
    COVERAGE_SQL + """SELECT kind, count(*) AS total, count(oa_url) AS hits,
    round(count(oa_url) / count(*), 6) AS ratio FROM rows LEFT JOIN oa USING (doi) GROUP BY kind""",
)
def oa_coverage(t: Tables):
    links = K.build_oa_links(T.oa_locations(t))
    parts = [
        R.oa_coverage(ids, kind, links).withColumn("kind", F.lit(kind))
        for kind, ids in _coverage_inputs(t).items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "A8_oa_hits",
    f"""WITH {T.PMID_SQL}, {T.OA_SQL} SELECT ids.doi, pmid, pmcid, oa_url AS url_for_pdf
    FROM ids JOIN oa USING (doi)""",
)
def oa_hits(t: Tables):
    hits = R.oa_hits(T.pmid_rows(t), "pmc", K.build_oa_links(T.oa_locations(t)))
    return hits.select("doi", "pmid", "pmcid", "best_oa_location.url_for_pdf")


def _mapping_inputs(t: Tables):
    mesh = T.order_biblio(t).select("pmid", "mesh")
    return T.istex_rows(t), K.build_pmid_maps(T.pmid_rows(t))["doi"], mesh


MAPPED_SQL = f"""WITH {T.PMID_SQL}, {T.ISTEX_SQL},
m AS (SELECT istex.*, nullif(istex.pmid, '0') AS existing, by_doi.pmid AS mapped, by_doi.pmcid
      FROM istex LEFT JOIN by_doi ON by_doi.doi = doi1)"""


@query(
    "A9_map_istex_to_pubmed",
    MAPPED_SQL + """SELECT istex_id, coalesce(existing, mapped) AS pmid, coalesce(pmcid, '') AS pmc,
    substr(o_orderpriority, 1, 1) AS mesh_id FROM m
    JOIN orders ON o_orderkey = CAST(coalesce(existing, mapped) AS BIGINT)""",
)
def map_istex_to_pubmed(t: Tables):
    rows = R.map_istex_to_pubmed(*_mapping_inputs(t))
    return rows.select(
        "istex_id", F.get("pmid", F.lit(0)).alias("pmid"), F.array_join("pmc", "|").alias("pmc"),
        F.get("mesh", F.lit(0))["descriptor"]["meshId"].alias("mesh_id"),
    )


@query(
    "A10_istex_mapping_stats",
    MAPPED_SQL + """SELECT count(*) AS ids, count(mapped) AS pmids_found, count(pmcid) AS pmcs_found,
    count(existing) AS already_present, count(mapped) - count(existing) AS added,
    count(existing) AS present_kept, count(*) FILTER (WHERE existing IS NOT NULL AND mapped IS NULL)
        AS present_not_mapped,
    count(coalesce(existing, mapped)) AS ids_with_mesh, count(coalesce(existing, mapped)) AS mesh_classes,
    count(*) FILTER (WHERE existing <> mapped) AS conflicts, CAST(1 AS DOUBLE) AS mean_classes FROM m""",
)
def istex_mapping_stats(t: Tables):
    return R.istex_mapping_stats(R.map_istex(*_mapping_inputs(t)))


def part_mesh(t: Tables):
    """Parts with two MeSH classes each; brand and type are the descriptors."""
    return t.part.select(
        S("p_partkey").alias("pmid"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("PMC"), S("p_partkey"))).alias("pmc"),
        F.expr(
            "array(named_struct('descriptor', named_struct('term', p_name, 'meshId', p_brand, "
            "'majorTopic', p_size > 25), 'qualifiers', cast(null as "
            "array<struct<term:string,meshId:string,majorTopic:boolean>>), 'chemical', "
            "cast(null as struct<term:string,meshId:string,registry:string>)), "
            "named_struct('descriptor', named_struct('term', p_name, 'meshId', p_type, 'majorTopic', "
            "false), 'qualifiers', array(named_struct('term', 'q', 'meshId', 'Q', 'majorTopic', "
            "p_size < 20)), 'chemical', cast(null as struct<term:string,meshId:string,registry:string>)))"
        ).alias("mesh"),
    )


def mesh_selection(t: Tables):
    """All brands and part types as selected descriptors of a few classes."""
    brands = t.part.select("p_brand").distinct().select(
        F.lit("brand").alias("level1"), F.substring("p_brand", 1, 7).alias("level2"),
        F.col("p_brand").alias("level3"), F.col("p_brand").alias("descriptor"),
    )
    types = t.part.select("p_type").distinct().select(
        F.lit("brand").alias("level1"), F.substring("p_type", 1, 1).alias("level2"),
        F.col("p_type").alias("level3"), F.col("p_type").alias("descriptor"),
    )
    return brands.unionByName(types)


@query(
    "A11_select_by_mesh",
    """WITH h AS (SELECT p_partkey, substr(p_brand, 1, 7) AS l2 FROM part WHERE p_size > 25
              UNION ALL SELECT p_partkey, substr(p_type, 1, 1) FROM part WHERE p_size < 20 AND p_size > 10)
    SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS pmid, 'level1' AS level_kind, 'brand' AS level FROM h
    UNION ALL SELECT DISTINCT CAST(p_partkey AS VARCHAR), 'level2', l2 FROM h""",
)
def select_by_mesh(t: Tables):
    return R.select_by_mesh(part_mesh(t), mesh_selection(t), only_pmc=True)


@query(
    "A12_export_records_csv",
    f"""WITH {ORDER_IDS_SQL}
    SELECT CAST(o_orderkey AS VARCHAR) AS pmid, doi, pmc, 'Order  of ' || o_orderpriority AS title,
    CAST(NULL AS VARCHAR) AS abstract, o_orderpriority AS "MeSH Terms",
    strftime(o_orderdate, '%Y-%m-%d') AS "publication year",
    'Customer' || o_custkey || ' Ann, ' || o_orderpriority || ' Bob C' AS authors, CAST(NULL AS VARCHAR) AS keywords,
    'Orders' AS publisher, o_orderpriority AS host, '' AS affiliation, '' AS "author countries", '' AS grid,
    '' AS funding_organization, '' AS "funding country" FROM o""",
)
def export_records_csv(t: Tables):
    return R.export_records_csv(T.order_biblio(t))


@query(
    "A13_export_medline_as_works",
    f"""WITH {T.PMID_SQL}, o AS (SELECT o_.*, coalesce(own.doi, i.doi, c.doi) AS doi,
        coalesce(own.pmc, i.pmcid, dm.pmcid) AS pmc
        FROM orders o_ JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN '10.1000/c' || o_custkey END AS doi,
            CASE WHEN o_orderstatus = 'P' THEN 'PMC' || o_orderkey END AS pmc FROM orders) own ON own.k = o_.o_orderkey
        LEFT JOIN (SELECT pmid, pmcid, replace(doi, '/c', '/C') AS doi, doi AS ldoi FROM ids) i0
            ON i0.pmid = CAST(o_.o_orderkey AS VARCHAR)
        LEFT JOIN ids i ON i.pmid = CAST(o_.o_orderkey AS VARCHAR)
        LEFT JOIN ids c ON c.pmcid = own.pmc
        LEFT JOIN by_doi dm ON dm.doi = coalesce(own.doi, i.doi, c.doi)),
    r AS (SELECT o.*, a.doi AS rdoi, coalesce(a.pmcid, a2.pmcid) AS rpmc, b.pmid AS spmid, b.pmcid AS spmc FROM o
        LEFT JOIN ids a ON a.pmid = CAST(o_custkey AS VARCHAR) LEFT JOIN by_doi a2 ON a2.doi = a.doi
        LEFT JOIN by_doi b ON b.doi = '10.1000/c' || o_custkey)
    SELECT CAST(o_orderkey AS VARCHAR) AS pmid, doi, {WORK_JSON_SQL} || ',"pmid":"' || o_orderkey || '"'
    || coalesce(',"pmcid":"' || pmc || '"', '') || {MESH_JSON_SQL}
    || coalesce(',"link":[{{"URL":"https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmc
                || '/pdf/","content-type":"application/pdf"}}]', '')
    || ',"reference-count":2,"reference":[{{"unstructured":"ref ' || o_orderkey || '","pmid":"' || o_custkey || '"'
    || coalesce(',"DOI":"' || rdoi || '"', '') || coalesce(',"pmcid":"' || rpmc || '"', '')
    || '}},{{"unstructured":"second"' || coalesce(',"pmid":"' || spmid || '"', '')
    || ',"DOI":"10.1000/c' || o_custkey || '"' || coalesce(',"pmcid":"' || spmc || '"', '') || '}}]}}' AS json FROM r""",
)
def export_medline_as_works(t: Tables):
    return R.export_medline_as_works(T.order_biblio(t), K.build_pmid_maps(T.pmid_rows(t)))


def order_entries(t: Tables):
    """Orders as enrichment entries of their customer's DOI."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    address = lambda c: F.array(F.struct(c.alias("country_code")))

    def affiliation(name, grid):
        return F.struct(
            name.alias("name"), F.struct(grid.alias("id"), address(status).alias("addresses")).alias("grid")
        )

    first = affiliation(F.concat(priority, F.lit(".")), F.concat(F.lit("grid."), status))
    second = affiliation(priority, F.concat(F.lit("grid."), S("o_orderkey")))
    return t.orders.select(
        F.array(
            F.struct(F.lit("doi").alias("type"), F.concat(F.lit("10.1000/C"), S("o_custkey")).alias("value")),
            F.struct(F.lit("pmid").alias("type"), S("o_orderkey").alias("value")),
        ).alias("external_ids"),
        F.concat(F.lit("abstract "), S("o_orderkey")).alias("abstract"),
        F.array(
            F.struct(F.array(first, second).alias("affiliations")),
            F.struct(F.array(first).alias("affiliations")),
        ).alias("authors"),
        F.when(
            status != "P",
            F.array(F.struct(F.concat(F.lit("org "), priority).alias("org"), status.alias("country"))),
        ).alias("funding"),
        F.col("o_orderkey").alias("entry_no"),
    )


def customer_export(t: Tables):
    """Customers as exported records; some cells are filled already."""
    values = {
        "pmid": S("c_custkey"),
        "doi": F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("10.1000/c"), S("c_custkey"))),
        "title": F.col("c_name"),
        "abstract": F.when(F.col("c_acctbal") < 0, "own abstract"),
        "grid": F.when(F.col("c_acctbal") < 0, "own grid").otherwise(""),
    }
    return t.customer.select(*[values.get(c, F.lit("")).alias(c) for c in EXPORT_COLUMNS])


FIRST_SQL = """WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1),
c AS (SELECT customer.*, o_orderkey, o_orderstatus AS st, o_orderpriority AS pr FROM customer
      LEFT JOIN first ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING')"""


@query(
    "A14_merge_enrichment",
    FIRST_SQL + """SELECT CAST(c_custkey AS VARCHAR) AS pmid,
    CASE WHEN c_acctbal < 0 THEN 'own abstract' WHEN o_orderkey IS NOT NULL THEN 'abstract ' || o_orderkey END AS abstract,
    coalesce(pr, '') AS affiliation, coalesce(st, '') AS countries,
    CASE WHEN c_acctbal < 0 THEN 'own grid' ELSE coalesce('grid.' || st || ';grid.' || o_orderkey, '') END AS grid,
    CASE WHEN st <> 'P' THEN 'org ' || pr ELSE '' END AS funder,
    CASE WHEN st <> 'P' THEN st ELSE '' END AS funder_country FROM c""",
)
def merge_enrichment(t: Tables):
    rows = R.merge_enrichment(customer_export(t), order_entries(t))
    return rows.select(
        "pmid", "abstract", "affiliation", F.col("author countries").alias("countries"), "grid",
        F.col("funding_organization").alias("funder"), F.col("funding country").alias("funder_country"),
    )


@query(
    "A15_merge_enrichment_stats",
    FIRST_SQL + """SELECT count(*) AS records, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS with_doi,
    count(o_orderkey) AS matched, count(o_orderkey) AS countries, count(o_orderkey) AS affiliations,
    count(*) FILTER (WHERE st <> 'P') AS funders FROM c""",
)
def merge_enrichment_stats(t: Tables):
    return R.merge_enrichment_stats(customer_export(t), order_entries(t))
