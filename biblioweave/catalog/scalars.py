"""Column expressions over the text and key columns of the test tables."""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables, query
from biblioweave.catalog import shapes as T
from biblioweave.catalog.matching_sql import FOLD, STOP, WORDS
from biblioweave.functions import codes, dates, ids, mesh, pages, people, text
from biblioweave.operators import records as R

S = T.S

# In the SQL texts: collapse spaces, and collapse plus trim plus outer quotes.
COLLAPSE = "regexp_replace(replace({0}, chr(10), ' '), ' +', ' ', 'g')"


@query(
    "P2_drop_ignored_fields",
    """SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","nested":' ||
    replace(props, ' ', '') || '}' AS json FROM events""",
)
def drop_ignored_fields(t: Tables):
    record = F.concat(
        F.lit('{"event_id":'), S("event_id"), F.lit(',"reference":[1,{"a":2}],"_id":{"x":1},"kind":"'),
        F.col("event_type"), F.lit('","abstract":"x","nested":'), F.col("props"), F.lit("}"),
    )
    return t.events.select("event_id", R.drop_ignored_fields(record).alias("json"))


@query(
    "P3_normalise_doi",
    r"""SELECT page_id, regexp_replace(lower(url), '^https?://', '') AS doi FROM pages""",
)
def normalise_doi(t: Tables):
    url = F.regexp_replace("url", "^https?://", "https://doi.org/")
    return t.pages.select("page_id", ids.normalise_doi(F.upper(url)).alias("doi"))


@query(
    "P4_normalise_pmc",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pmc' || o_orderkey
    ELSE 'PMC' || o_orderkey END AS pmc FROM orders""",
)
def normalise_pmc(t: Tables):
    status = F.col("o_orderstatus")
    raw = F.concat(
        F.when(status == "F", "pmc").when(status == "O", "PMC").otherwise(""), S("o_orderkey")
    )
    return t.orders.select("o_orderkey", ids.normalise_pmc(raw).alias("pmc"))


@query(
    "P5_clean_pubmed_id",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' OR o_orderpriority LIKE '4%' THEN NULL
        ELSE CAST(o_custkey AS VARCHAR) END AS pmid,
    CASE WHEN o_orderpriority LIKE '4%' THEN '10.1/' || o_custkey END AS doi,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'pmc' || o_custkey END AS pmc FROM orders""",
)
def clean_pubmed_id(t: Tables):
    priority, key = F.col("o_orderpriority"), S("o_custkey")
    raw = (
        F.when(priority.startswith("1"), F.concat(F.lit("PMID:"), key))
        .when(priority.startswith("2"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), key, F.lit("/")))
        .when(priority.startswith("3"), F.concat(key, F.lit("DOI")))
        .when(priority.startswith("4"), F.concat(F.lit("doi.org/10.1/"), key))
        .otherwise(F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/pmc"), key))
    )
    cleaned = ids.clean_pubmed_id(raw)
    return t.orders.select("o_orderkey", cleaned.alias("c")).select("o_orderkey", "c.pmid", "c.doi", "c.pmc")


@query(
    "P6_record_id",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN 'crossref:' || source WHEN lang = 'fr'
    THEN 'hal:' || doc_id END AS id FROM documents""",
)
def record_id(t: Tables):
    lang = F.col("lang")
    source = F.when(lang == "en", "Crossref").when(lang == "fr", "HAL").when(lang == "es", "other")
    return t.documents.select(
        "doc_id", ids.record_id(source, F.col("source"), S("doc_id")).alias("id")
    )


@query(
    "P7_clean_titles",
    f"SELECT doc_id, {COLLAPSE.format('text')} || '|' || lang AS titles FROM documents",
)
def clean_titles(t: Tables):
    titles = F.array("text", F.lit(" \n "), "lang")
    return t.documents.select("doc_id", F.array_join(text.clean_titles(titles), "|").alias("titles"))


def order_authors():
    """Two authors per order; which one is marked first depends on the status."""
    status = F.col("o_orderstatus")
    none = F.lit(None).cast("string")

    def author(family, sequence):
        return F.struct(none.alias("given"), family.alias("family"), sequence.alias("sequence"))

    return F.array(
        author(F.when(status != "P", F.col("o_orderpriority")), F.when(status == "F", "first")),
        author(S("o_custkey"), F.when(status == "F", "first").otherwise("additional")),
    )


@query(
    "P8_author_fields",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR)
        WHEN 'O' THEN o_orderpriority END AS first_author,
    CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR)
        ELSE o_orderpriority || ' ' || o_custkey END AS author FROM orders""",
)
def author_fields(t: Tables):
    authors = order_authors()
    return t.orders.select(
        "o_orderkey",
        people.first_author(authors).alias("first_author"),
        people.author_families(authors).alias("author"),
    )


@query(
    "P31_first_family_name",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR)
    ELSE o_orderpriority END AS family FROM orders""",
)
def first_family_name(t: Tables):
    return t.orders.select("o_orderkey", people.first_family_name(order_authors()).alias("family"))


@query(
    "P9_first_page",
    "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS first_page FROM orders",
)
def first_page(t: Tables):
    mark = F.when(F.col("o_orderstatus") == "F", "-").when(F.col("o_orderstatus") == "O", ",").otherwise(" ")
    raw = F.concat(F.lit(" "), S("o_custkey"), mark, S("o_orderkey"), F.lit(" "))
    return t.orders.select("o_orderkey", pages.first_page(raw).alias("first_page"))


@query(
    "P10_container_titles",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Journal of ' || p_name END AS journal FROM part""",
)
def container_titles(t: Tables):
    title = F.when(F.col("p_size") > 25, F.concat(F.lit("Journal\nof  "), F.col("p_name"))).otherwise("")
    return t.part.select(
        "p_partkey",
        F.array_join(R.container_titles(F.array(title, F.lit(" "))), "|").alias("journal"),
    )


@query(
    "P11_publication_year",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '1999'
    ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders""",
)
def publication_year(t: Tables):
    """Nested, flat and missing dates, the last falling back to the creation date."""
    year = F.year("o_orderdate").cast("string")
    json = (
        F.when(
            F.col("o_orderstatus") == "F",
            F.concat(F.lit('{"issued":{"date-parts":[['), year, F.lit(",1,2]]}}")),
        )
        .when(
            F.col("o_orderstatus") == "O",
            F.concat(F.lit('{"published-online":{"date-parts":['), year, F.lit(",3]}}")),
        )
        .otherwise(F.lit('{"issued":{"date-parts":[[null]]},"created":{"date-parts":[[1999]]}}'))
    )
    return t.orders.select("o_orderkey", dates.publication_year(json).alias("year"))


@query(
    "P12_bibliographic_text",
    """SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_size || ' ' || p_partkey
    || ' 2001' AS bibliographic FROM part""",
)
def bibliographic_text(t: Tables):
    none = F.lit(None).cast("string")
    line = R.bibliographic_text(
        F.lit(" "), F.col("p_brand"), F.array("p_name"), F.array("p_type"),
        F.lit(None).cast("array<string>"), S("p_size"), none, S("p_partkey"), F.lit("2001"),
    )
    return t.part.select("p_partkey", line.alias("bibliographic"))


@query(
    "P13_is_filtered_type",
    "SELECT event_id, event_type = 'error' AS filtered FROM events",
)
def is_filtered_type(t: Tables):
    kind = F.when(F.col("event_type") == "error", "component").when(
        F.col("event_type") != "view", F.col("event_type")
    )
    return t.events.select("event_id", R.is_filtered_type(kind).alias("filtered"))


@query(
    "P14_simple_clean",
    f"""SELECT doc_id, trim(regexp_replace(trim({COLLAPSE.format('text')}, ' '), '^"+|"+$', '', 'g'), ' ')
    AS cleaned FROM documents""",
)
def simple_clean(t: Tables):
    quoted = F.concat(F.lit(' ""'), F.col("text"), F.lit('" \n'))
    return t.documents.select("doc_id", text.simple_clean(quoted).alias("cleaned"))


@query(
    "P15_issn_and_isbn",
    """WITH b AS (SELECT o_orderkey, '978' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS body FROM orders),
    c AS (SELECT *, (10 - list_sum([CAST(substr(body, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END
              FOR i IN range(1, 13)]) % 10) % 10 AS digit FROM b)
    SELECT o_orderkey, substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 4) || '-' ||
        substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 5, 4) AS issn, body || digit AS isbn FROM c""",
)
def issn_and_isbn(t: Tables):
    digits = F.lpad(S("o_orderkey"), 9, "0")
    isbn = F.concat(F.substring(digits, 1, 1), F.lit("-"), F.substring(digits, 2, 8), F.lit("X"))
    return t.orders.select(
        "o_orderkey",
        ids.format_issn(F.lpad(S("o_orderkey"), 8, "0")).alias("issn"),
        ids.isbn10_to_13(isbn).alias("isbn"),
    )


@query(
    "P16_expand_page_range",
    """WITH p AS (SELECT o_orderkey, CAST(o_orderkey + 100 AS VARCHAR) AS a, CAST(o_custkey % 10 AS VARCHAR) AS b,
        o_orderstatus AS s FROM orders)
    SELECT o_orderkey, a AS first_page, CASE WHEN s = 'P' THEN a ELSE substr(a, 1, length(a) - 1) || b END AS last_page,
        CAST(a AS INT) AS first_int FROM p""",
)
def expand_page_range(t: Tables):
    start = (F.col("o_orderkey") + 100).cast("string")
    end = (F.col("o_custkey") % 10).cast("string")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Suppl: "), start, F.lit("-"), end))
        .when(F.col("o_orderstatus") == "O", F.concat(start, F.lit(","), end, F.lit(" passim")))
        .otherwise(F.concat(F.lit("CR "), start))
    )
    return t.orders.select("o_orderkey", pages.expand_page_range(raw).alias("p")).select(
        "o_orderkey", F.col("p.start").alias("first_page"), F.col("p.end").alias("last_page"),
        F.col("p.start_int").alias("first_int"),
    )


@query(
    "P17_page_range",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey = o_custkey
    THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderkey || '-' || o_custkey END AS page FROM orders""",
)
def page_range(t: Tables):
    start = F.when(F.col("o_orderstatus") != "P", S("o_orderkey"))
    return t.orders.select("o_orderkey", pages.page_range(start, S("o_custkey")).alias("page"))


PARTS_SQL = """year(o_orderdate) AS y, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS m,
    CASE WHEN o_orderstatus = 'F' THEN day(o_orderdate) END AS d"""


def order_date():
    """Partial order date: full, without day, or without month by status."""
    status = F.col("o_orderstatus")
    return F.struct(
        F.year("o_orderdate").alias("year"),
        F.when(status != "P", F.month("o_orderdate")).alias("month"),
        F.when(status == "F", F.dayofmonth("o_orderdate")).alias("day"),
    )


@query(
    "P18_partial_date",
    """SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS m,
    CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN month(o_orderdate) IN (4, 6, 9, 11) THEN 30
        WHEN month(o_orderdate) = 2 THEN 28 ELSE 31 END END AS d FROM orders""",
)
def partial_date(t: Tables):
    month = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MMM")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM")
    )
    made = dates.partial_date(F.year("o_orderdate").cast("string"), month, F.lit("31"))
    return t.orders.select("o_orderkey", made.alias("p")).select(
        "o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("d")
    )


@query(
    "P19_partial_date_text",
    f"""WITH p AS (SELECT o_orderkey, {PARTS_SQL} FROM orders),
    f AS (SELECT *, y || coalesce('-' || lpad(CAST(m AS VARCHAR), 2, '0'), '')
        || coalesce('-' || lpad(CAST(d AS VARCHAR), 2, '0'), '') AS ymd,
        coalesce(lpad(CAST(d AS VARCHAR), 2, '0') || '-', '') || coalesce(lpad(CAST(m AS VARCHAR), 2, '0') || '-', '')
        || y AS dmy FROM p)
    SELECT o_orderkey, ymd, dmy, ymd AS again_ymd, ymd AS again_dmy,
        strftime(make_date(y, coalesce(m, 1), coalesce(d, 1)), '%Y-%m-%d') AS full_date FROM f""",
)
def partial_date_text(t: Tables):
    p = order_date()
    ymd, dmy = dates.format_partial_date(p), dates.format_partial_date(p, day_first=True)
    rows = t.orders.select("o_orderkey", p.alias("p"), ymd.alias("ymd"), dmy.alias("dmy"))
    return rows.select(
        "o_orderkey", "ymd", "dmy",
        dates.format_partial_date(dates.parse_partial_date(F.col("ymd"))).alias("again_ymd"),
        dates.format_partial_date(dates.parse_partial_date(F.col("dmy"), day_first=True)).alias("again_dmy"),
        F.date_format(dates.partial_to_date(F.col("p")), "yyyy-MM-dd").alias("full_date"),
    )


@query(
    "P20_oldest_date",
    f"""WITH p AS (SELECT o_orderkey, o_orderstatus AS s, {PARTS_SQL} FROM orders)
    SELECT o_orderkey, CASE WHEN y < 1998 OR (y = 1998 AND (m IS NOT NULL AND (m < 6 OR (m = 6 AND d IS NOT NULL))))
        THEN 'printed' ELSE 'electronic' END AS older FROM p""",
)
def oldest_date(t: Tables):
    electronic = F.struct(
        F.lit(1998).alias("year"), F.lit(6).alias("month"), F.lit(None).cast("int").alias("day")
    )
    printed = order_date()
    chosen = dates.oldest_date(printed, electronic)
    return t.orders.select(
        "o_orderkey", F.when(chosen.eqNullSafe(printed) & ~printed.eqNullSafe(electronic), "printed").otherwise("electronic").alias("older")
    )


@query(
    "P21_person_names",
    """SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-O' || lower(c_name[2:]) AS normalised,
    c_mktsegment || ' ' || c_name AS full_name, c_mktsegment || ' ' || c_name || ', X' AS authors FROM customer""",
)
def person_names(t: Tables):
    raw = F.concat(F.col("c_mktsegment"), F.lit("-o"), F.expr("substr(c_name, 2)"))
    who = T.person(F.col("c_name"), F.col("c_mktsegment"))
    other = T.person(F.lit(""), F.lit("X"))
    return t.customer.select(
        "c_custkey",
        people.normalise_person_name(F.upper(raw)).alias("normalised"),
        people.full_name(who).alias("full_name"),
        people.author_list(F.array(who, other)).alias("authors"),
    )


@query(
    "P22_dedupe_authors",
    """SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_name || ',other' ELSE c_name || ',other,' || c_name END
    AS authors FROM customer""",
)
def dedupe_authors(t: Tables):
    name = F.col("c_name")
    given = lambda c: F.when(F.col("c_nationkey") < 10, "Ann").otherwise(c)
    persons = F.array(
        T.person(F.lit("Ann"), name), T.person(F.lit("Bob"), F.lit("other")),
        T.person(given(F.lit("Cid")), name), T.person(F.lit("Bob"), F.lit("other")),
        T.person(F.lit(""), F.lit("")),
    )
    kept = people.dedupe_authors(persons)
    return t.customer.select(
        "c_custkey", F.array_join(F.transform(kept, lambda p: p["last_name"]), ",").alias("authors")
    )


@query(
    "P23_lang3_to_lang2",
    "SELECT doc_id, lang AS code, CAST(NULL AS VARCHAR) AS unknown FROM documents",
)
def lang3_to_lang2(t: Tables):
    lang = F.col("lang")
    long = F.when(lang == "en", "eng").when(lang == "fr", "fra").when(lang == "de", "deu").otherwise("spa")
    return t.documents.select(
        "doc_id", codes.lang3_to_lang2(long).alias("code"), codes.lang3_to_lang2(F.lit("und")).alias("unknown")
    )


@query(
    "P24_map_document_type",
    """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'article' WHEN 'SMALL' THEN 'article'
        WHEN 'MEDIUM' THEN 'report' WHEN 'LARGE' THEN 'book' WHEN 'ECONOMY' THEN 'article' END AS document_type,
    CASE p_type WHEN 'STANDARD' THEN 'journal' WHEN 'SMALL' THEN 'proceedings' WHEN 'ECONOMY' THEN 'report' END
        AS host_type FROM part""",
)
def map_document_type(t: Tables):
    kind = F.col("p_type")
    code = (
        F.when(kind == "STANDARD", "ART").when(kind == "SMALL", "COMM").when(kind == "MEDIUM", "THESE")
        .when(kind == "LARGE", "OUV").when(kind == "ECONOMY", "CREPORT").otherwise("???")
    )
    return t.part.select("p_partkey", codes.map_document_type(code).alias("k")).select(
        "p_partkey", "k.document_type", "k.host_type"
    )


@query(
    "P25_doi_prefix_and_url",
    """SELECT page_id, split_part(url, '/', 1) AS prefix, 'http://dx.doi.org/' || url AS link FROM pages""",
)
def doi_prefix_and_url(t: Tables):
    return t.pages.select(
        "page_id", ids.doi_prefix(F.col("url")).alias("prefix"), ids.doi_url(F.col("url")).alias("link")
    )


@query(
    "P26_extract_doi",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '10.1000/' || o_orderkey || 'x' END AS doi FROM orders""",
)
def extract_doi(t: Tables):
    number = F.when(F.col("o_orderstatus") == "P", "10.1/").otherwise("10.1000/")
    json = F.concat(F.lit('{"a": 1, "DOI" : "'), number, S("o_orderkey"), F.lit('x", "DOI":"10.2000/yy"}'))
    first = ids.extract_doi(F.when(F.col("o_orderstatus") == "P", F.lit("{}")).otherwise(json))
    return t.orders.select("o_orderkey", first.alias("doi"))


@query(
    "P27_mesh_to_json",
    """SELECT p_partkey, '{"descriptor":{"term":"' || p_name || '","meshId":"' || p_brand || '","majorTopic":"'
    || (p_size > 25) || '"},"qualifiers":[{"qualifier":{"term":"' || p_type || '","meshId":"Q1","majorTopic":"true"}}]}'
    AS descriptor, '{"chemical":{"term":"' || p_name || '","meshId":"' || p_brand || '","chemicalRegistryNumber":"'
    || p_size || '"}}' AS chemical FROM part""",
)
def mesh_to_json(t: Tables):
    qualifier = F.array(
        F.struct(F.col("p_type").alias("term"), F.lit("Q1").alias("meshId"), F.lit(True).alias("majorTopic"))
    )
    rows = t.part.select(
        "p_partkey",
        mesh.mesh_struct(F.col("p_name"), F.col("p_brand"), F.col("p_size") > 25, qualifier).alias("d"),
        mesh.mesh_chemical(F.col("p_name"), F.col("p_brand"), S("p_size")).alias("c"),
    )
    return rows.select(
        "p_partkey", mesh.mesh_to_json(F.col("d")).alias("descriptor"), mesh.mesh_to_json(F.col("c")).alias("chemical")
    )


@query("P28_clean_article_title", "SELECT p_partkey, p_name AS title FROM part")
def clean_article_title(t: Tables):
    title = F.concat(F.lit("["), F.col("p_name"), F.lit("]."))
    return t.part.select("p_partkey", text.clean_article_title(title).alias("title"))


@query(
    "P29_clean_reference_string",
    r"""SELECT doc_id, trim(regexp_replace(text, '[\n\t ]+', ' ', 'g'), ' ') AS reference FROM documents""",
)
def clean_reference_string(t: Tables):
    raw = F.concat(F.lit("\t \n"), F.col("text"), F.lit("\n\t"))
    return t.documents.select("doc_id", text.clean_reference_string(raw).alias("reference"))


@query(
    "P30_analyze",
    f"""SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS words,
    array_to_string([x FOR x IN {WORDS.format('text')} IF x NOT IN ({STOP})], ' ') AS words_stop,
    {FOLD.format('text')} AS keyword_fold, lower(text) AS keyword FROM documents""",
)
def analyze(t: Tables):
    return t.documents.select(
        "doc_id",
        *[
            F.array_join(text.analyze(F.col("text"), name), " ").alias(name)
            for name in ("words", "words_stop", "keyword_fold", "keyword")
        ],
    )


@query(
    "P32_complete_date",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN year(o_orderdate) || '-12-31'
        WHEN 'O' THEN year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' ||
            CASE WHEN month(o_orderdate) = 2 THEN '28' WHEN month(o_orderdate) IN (4, 6, 9, 11) THEN '30' ELSE '31' END
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS full_date, '' AS too_old FROM orders""",
)
def complete_date(t: Tables):
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "P", F.concat(F.year("o_orderdate").cast("string"), F.lit("-")))
        .when(status == "O", F.date_format("o_orderdate", "yyyy-M"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    old = F.concat(F.lit("18"), F.date_format("o_orderdate", "yy"))
    return t.orders.select(
        "o_orderkey", dates.complete_date(raw).alias("full_date"), dates.complete_date(old).alias("too_old")
    )


@query(
    "P33_clean_field",
    "SELECT p_partkey, p_name || ' &amp;' AS field FROM part",
)
def clean_field(t: Tables):
    raw = F.concat(F.lit(", . ("), F.col("p_name"), F.lit(" &amp;), - ."))
    return t.part.select("p_partkey", text.clean_field(raw).alias("field"))


@query(
    "P34_clean_display_date",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CAST(year(o_orderdate) AS VARCHAR)
        WHEN 'O' THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%d-%m-%Y') END AS shown FROM orders""",
)
def clean_display_date(t: Tables):
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "P", F.concat(F.year("o_orderdate").cast("string"), F.lit("-00-00")))
        .when(status == "O", S("o_orderkey"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return t.orders.select("o_orderkey", dates.clean_display_date(raw).alias("shown"))
