"""The relational test tables in the shapes of bibliographic tables.

``*_SQL`` constants are the same shapes as common table expressions.
"""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables

S = lambda c: F.col(c).cast("string")


def works(t: Tables):
    """Customers as works."""
    return t.customer.select(
        F.concat(F.lit("10.1000/c"), S("c_custkey")).alias("doi"),
        F.to_json(
            F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("publisher"))
        ).alias("json"),
        F.col("c_name").alias("record_title"),
        F.col("c_mktsegment").alias("record_author"),
    )


WORKS_SQL = """works AS (SELECT '10.1000/c' || c_custkey AS doi,
    '{"title":"' || c_name || '","publisher":"' || c_mktsegment || '"}' AS json,
    c_name AS record_title, c_mktsegment AS record_author FROM customer)"""


def pmid_rows(t: Tables):
    """Orders as the id file: order key, PMC id when open, customer as DOI."""
    status = F.col("o_orderstatus")
    return t.orders.select(
        S("o_orderkey").alias("pmid"),
        F.when(status != "P", F.concat(F.lit("PMC"), S("o_orderkey"))).alias("pmcid"),
        F.when(status != "O", F.concat(F.lit("10.1000/C"), S("o_custkey"))).alias("doi"),
        F.lit(None).cast("string").alias("license"),
        F.lit(None).cast("string").alias("subpath"),
    )


PMID_SQL = """ids AS (SELECT CAST(o_orderkey AS VARCHAR) AS pmid,
    CASE WHEN o_orderstatus <> 'P' THEN 'PMC' || o_orderkey END AS pmcid,
    CASE WHEN o_orderstatus <> 'O' THEN '10.1000/c' || o_custkey END AS doi FROM orders),
by_doi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi
    ORDER BY pmid DESC, pmcid DESC NULLS LAST) AS n FROM ids WHERE doi IS NOT NULL) WHERE n = 1)"""


def istex_rows(t: Tables):
    """Orders as archive id records with one or two DOIs and a PII."""
    key = S("o_orderkey")
    first = F.concat(F.lit("10.1000/C"), S("o_custkey"))
    second = F.concat(F.lit("10.2000/"), key)
    return t.orders.select(
        F.col("o_orderpriority").alias("corpus_name"),
        F.concat(F.lit("IX"), F.lpad(key, 12, "0")).alias("istex_id"),
        F.when(F.col("o_orderstatus") == "F", F.array(first, second)).otherwise(F.array(first)).alias("doi"),
        F.when(F.col("o_orderstatus") == "F", F.array(key)).otherwise(F.array().cast("array<string>")).alias("pmid"),
        F.array().cast("array<string>").alias("pmc"),
        F.array(F.concat(F.lit("ark:/"), key)).alias("ark"),
        F.array().cast("array<string>").alias("mesh"),
        F.array(F.concat(F.lit("S"), key)).alias("pii"),
    )


ISTEX_SQL = """istex AS (SELECT o_orderpriority AS corpus_name,
    'IX' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS istex_id,
    '10.1000/c' || o_custkey AS doi1,
    CASE WHEN o_orderstatus = 'F' THEN '10.2000/' || o_orderkey END AS doi2,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS pmid,
    'ark:/' || o_orderkey AS ark, 'S' || o_orderkey AS pii FROM orders),
istex_by_doi AS (SELECT * FROM (SELECT key, istex_id, ark, pmid, pii, row_number() OVER (
    PARTITION BY key ORDER BY istex_id DESC) AS n FROM (
        SELECT doi1 AS key, * FROM istex UNION ALL
        SELECT doi2, * FROM istex WHERE doi2 IS NOT NULL)) WHERE n = 1)"""


def oa_locations(t: Tables):
    """Customers as open-access records; only those with a balance have a link."""
    return t.customer.select(
        F.upper(F.concat(F.lit("10.1000/c"), S("c_custkey"))).alias("doi"),
        F.struct(
            F.when(
                F.col("c_acctbal") > 1000,
                F.concat(F.lit("https://oa.example.org/"), S("c_custkey"), F.lit(".pdf")),
            ).otherwise(" ").alias("url_for_pdf")
        ).alias("best_oa_location"),
    )


OA_SQL = """oa AS (SELECT '10.1000/c' || c_custkey AS doi,
    'https://oa.example.org/' || c_custkey || '.pdf' AS oa_url FROM customer WHERE c_acctbal > 1000)"""


def doi_hal(t: Tables):
    return t.supplier.select(
        F.concat(F.lit("10.1000/c"), S("s_suppkey")).alias("doi"),
        F.concat(F.lit("hal-"), S("s_suppkey")).alias("hal_id"),
    )


HAL_SQL = """doi_hal AS (SELECT '10.1000/c' || s_suppkey AS doi, 'hal-' || s_suppkey AS hal_id
    FROM supplier)"""


def hal_works(t: Tables):
    return t.supplier.select(
        F.concat(F.lit("hal-"), S("s_suppkey")).alias("hal_id"),
        F.to_json(F.struct(F.col("s_name").alias("title"))).alias("json"),
        F.col("s_name").alias("record_title"),
        F.lit(None).cast("string").alias("record_author"),
    )


def biblio(t: Tables, **columns):
    """Rich rows with the given columns; all others are null."""
    from biblioweave.schemas import BIBLIO

    def make(df):
        return df.select(
            *[
                (columns[n] if n in columns else F.lit(None)).cast(k).alias(n)
                for n, k in BIBLIO.items()
            ]
        )

    return make


PERSONS = "array<struct<first_name:string,middle_name:string,last_name:string,suffix:string," \
    "initials:string,identifiers:array<struct<name:string,value:string>>,affiliations:array<string>>>"


def person(first, last, middle=None, orcid=None):
    none = F.lit(None).cast("string")
    ids = F.array() if orcid is None else F.array(
        F.struct(F.lit("ORCID").alias("name"), orcid.alias("value"))
    )
    return F.struct(
        first.alias("first_name"), (none if middle is None else middle).alias("middle_name"),
        last.alias("last_name"), none.alias("suffix"), none.alias("initials"),
        ids.cast("array<struct<name:string,value:string>>").alias("identifiers"),
        F.array().cast("array<string>").alias("affiliations"),
    )


def order_biblio(t: Tables):
    """Orders as MEDLINE-like rows, each with one or two authors and two references."""
    order, key = t.orders, S("o_orderkey")
    date = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    mesh_type = "struct<descriptor:struct<term:string,meshId:string,majorTopic:boolean>,"
    return biblio(
        t,
        pmid=key,
        doi=F.when(status == "F", F.concat(F.lit("10.1000/c"), S("o_custkey"))),
        pmc=F.when(status == "P", F.concat(F.lit("PMC"), key)),
        article_title=F.concat(F.lit("[Order  of "), F.col("o_orderpriority"), F.lit("].")),
        title=F.col("o_orderpriority"),
        volume=F.year(date).cast("string"),
        issue=F.month(date).cast("string"),
        start_page=key,
        end_page=S("o_custkey"),
        raw_type=status,
        publisher=F.lit("Orders"),
        publication_date=F.struct(
            F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day")
        ),
        authors=F.array(
            person(F.lit("Ann"), F.concat(F.lit("Customer"), S("o_custkey"))),
            person(F.lit("Bob"), F.col("o_orderpriority"), middle=F.lit("C")),
        ),
        mesh=F.array(
            F.expr("named_struct('descriptor', named_struct('term', o_orderpriority, 'meshId', "
                   "substr(o_orderpriority, 1, 1), 'majorTopic', o_orderstatus = 'O'), 'qualifiers', "
                   "array(named_struct('term', 'q', 'meshId', 'Q1', 'majorTopic', o_orderstatus = 'F')), "
                   "'chemical', cast(null as struct<term:string,meshId:string,registry:string>))")
        ),
        references=F.array(
            F.expr("named_struct('unstructured', concat('ref ', o_orderkey), 'pmid', "
                   "cast(o_custkey as string), 'doi', cast(null as string), 'pmc', "
                   "cast(null as string), 'pii', cast(null as string))"),
            F.expr("named_struct('unstructured', 'second', 'pmid', cast(null as string), 'doi', "
                   "concat('10.1000/c', o_custkey), 'pmc', cast(null as string), 'pii', cast(null as string))"),
        ),
    )(order)
