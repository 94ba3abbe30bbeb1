"""Blocking, scoring and ranking of passages and pages."""

from pyspark.sql import functions as F

from biblioweave.catalog import Tables, gestalt_sql, query
from biblioweave.catalog.matching_sql import FOLD, PAGE_SQL, tokens_sql
from biblioweave.functions.similarity import ratcliff_obershelp
from biblioweave.functions.text import analyze
from biblioweave.operators import ranking as R
from biblioweave.operators import search as S
from biblioweave.operators.audit import (
    audit_duplicates, audit_missing_doi, audit_summary, candidate_fields,
)
from biblioweave.plans.matching import Store, resolve_requests
from biblioweave.session import materialise, spread

TEXT = {"bibliographic": ("text", "words_stop")}

DOC_INDEX_SQL = f"""
tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents),
post AS (SELECT token, doc_id, count(*) AS tf FROM tok GROUP BY token, doc_id),
dl AS (SELECT doc_id, count(*) AS doc_len FROM tok GROUP BY doc_id),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token)
"""

DOC_SCORES_SQL = f"""
{DOC_INDEX_SQL},
req AS (SELECT DISTINCT item_id, token FROM (
    SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark)),
score AS (
    SELECT r.item_id, p.doc_id, round(sum(
        ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
        * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / s.avg_len))), 6) AS score
    FROM req r JOIN df d USING (token) JOIN post p USING (token)
    JOIN dl l ON l.doc_id = p.doc_id CROSS JOIN stats s
    GROUP BY r.item_id, p.doc_id),
top AS (
    SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk FROM score)
    WHERE rnk <= 4)
"""


def doc_index(t: Tables, **options) -> S.Index:
    records = spread(t.documents.select("doc_id", "text"), "doc_id")
    return S.build_index(records, TEXT, id="doc_id", **options)


def passages(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("req_id"), F.col("text").alias("biblio"))


@query(
    "X1_build_postings",
    f"WITH {DOC_INDEX_SQL} SELECT token, p.doc_id, tf, doc_len FROM post p JOIN dl USING (doc_id)",
)
def build_postings(t: Tables):
    rows = S.build_postings(t.documents, TEXT, id="doc_id")
    return rows.select(
        "token", F.col("id").alias("doc_id"), F.col("tf").cast("long").alias("tf"),
        F.col("doc_len").cast("long").alias("doc_len"),
    )


@query(
    "X1_token_stats",
    f"""WITH {DOC_INDEX_SQL}
    SELECT token, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf
    FROM df CROSS JOIN stats""",
)
def token_stats(t: Tables):
    # copies count like other records, so nothing is gained by finding them first
    return doc_index(t, collapse=False).token_stats.select("token", "df", F.round("idf", 6).alias("idf"))


@query("X6_bm25", f"WITH {DOC_SCORES_SQL} SELECT item_id, doc_id, score FROM score")
def bm25(t: Tables):
    index = doc_index(t, collapse=False)
    terms = materialise(S.weighted_terms(S.request_tokens(passages(t), S.BIBLIO_FIELD), index), "request-terms")
    return S.all_scores(terms, index, ["bibliographic"]).select(
        F.col("req_id").alias("item_id"), F.col("id").alias("doc_id"),
        F.round("score", 6).alias("score"),
    )


def matched_passages(t: Tables, **options):
    return S.match_biblio(passages(t), doc_index(t), **options)


TOP_SQL = f"""WITH {DOC_SCORES_SQL}
SELECT item_id, doc_id, rnk AS "rank", score FROM top"""


def _top(rows):
    return rows.select(
        F.col("req_id").alias("item_id"), F.col("id").alias("doc_id"),
        F.col("blocking_rank").alias("rank"), F.col("raw_score").alias("score"),
    )


@query("X2_match_biblio", TOP_SQL)
def match_biblio(t: Tables):
    return _top(matched_passages(t))


@query("X6_bm25_pruned", TOP_SQL)
def match_biblio_pruned(t: Tables):
    return _top(matched_passages(t, pruned=True))


@query(
    "X7_top_candidates_minmax",
    f"""WITH {DOC_SCORES_SQL},
    b AS (SELECT *, least(min(score) OVER (PARTITION BY item_id), 1.0) AS lo,
                 greatest(max(score) OVER (PARTITION BY item_id), 0.0) AS hi FROM top)
    SELECT item_id, doc_id, rnk AS "rank",
           round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 5) AS blocking_score
    FROM b""",
)
def top_candidates(t: Tables):
    rows = S.minmax_blocking_score(matched_passages(t))
    return rows.select(
        F.col("req_id").alias("item_id"), F.col("id").alias("doc_id"),
        F.col("blocking_rank").alias("rank"), F.round("blocking_score", 5).alias("blocking_score"),
    )


@query(
    "X5_match_excluding_self",
    f"""WITH {DOC_INDEX_SQL},
    score AS (
        SELECT q.doc_id AS own, p.doc_id, round(sum(
            ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
            * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / s.avg_len))), 6) AS score
        FROM post q JOIN df d USING (token) JOIN post p USING (token)
        JOIN dl l ON l.doc_id = p.doc_id CROSS JOIN stats s
        WHERE q.doc_id <> p.doc_id GROUP BY q.doc_id, p.doc_id)
    SELECT own AS req_id, doc_id, score FROM (SELECT *, row_number() OVER (
        PARTITION BY own ORDER BY score DESC, doc_id) AS rnk FROM score) WHERE rnk <= 4""",
)
def match_excluding_self(t: Tables):
    requests = t.documents.select(
        F.col("doc_id").alias("req_id"), F.col("text").alias("biblio"),
        F.col("doc_id").alias("own_id"),
    )
    rows = S.match_biblio_conditional(requests, doc_index(t), exclude="own_id", pruned=True)
    return rows.select("req_id", F.col("id").alias("doc_id"), F.col("raw_score").alias("score"))


@query(
    "X5_match_with_label_only",
    f"""WITH {DOC_SCORES_SQL},
    kept AS (SELECT s.* FROM score s WHERE doc_id IN (SELECT doc_id FROM labels)),
    topk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk
             FROM kept)
    SELECT item_id, doc_id, score FROM topk WHERE rnk <= 4""",
)
def match_with_label_only(t: Tables):
    labelled = t.labels.select("doc_id", F.lit(True).alias("has_doi"))
    records = t.documents.join(labelled, "doc_id", "left").withColumn(
        "has_doi", F.coalesce("has_doi", F.lit(False))
    )
    index = S.build_index(records, TEXT, id="doc_id", carry=("has_doi",))
    rows = S.match_biblio_conditional(passages(t), index)
    return rows.select(
        F.col("req_id").alias("item_id"), F.col("id").alias("doc_id"),
        F.col("raw_score").alias("score"),
    )


@query(
    "X12_evaluate_matching",
    f"""WITH {DOC_SCORES_SQL},
    truth AS (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b
              JOIN documents d ON instr(d.text, b.text) > 0 GROUP BY b.item_id),
    c AS (SELECT count(*) AS attempted, count(p.doc_id) AS found,
                 count(*) FILTER (WHERE p.doc_id = t.doc_id) AS correct
          FROM truth t LEFT JOIN (SELECT * FROM top WHERE rnk = 1) p USING (item_id))
    SELECT attempted, found, correct, round(correct / found, 6) AS "precision",
           round(correct / attempted, 6) AS recall,
           round(2.0 * (correct / found) * (correct / attempted)
                 / ((correct / found) + (correct / attempted)), 6) AS f1 FROM c""",
)
def evaluate_matching(t: Tables):
    """Best match per passage against the first document that contains it verbatim.

    A document that contains a passage has every inner word of it, so the
    rarest inner word leads to all documents to check.
    """
    index = doc_index(t, collapse=False)
    tokens = S.request_tokens(passages(t), S.BIBLIO_FIELD)
    inner = S.weighted_terms(tokens, index).join(inner_tokens(t), ["req_id", "token"])
    rarest = inner.groupBy("req_id").agg(
        F.min_by(F.struct("field", "token"), F.struct("df", "token")).alias("t")
    ).select("req_id", "t.field", "t.token")
    pairs = rarest.join(index.postings, ["field", "token"]).select("req_id", F.col("id").alias("doc_id"))
    contained = (
        pairs.join(passages(t), "req_id").join(t.documents.select("doc_id", "text"), "doc_id")
        .filter(F.contains("text", "biblio"))
    )
    truth = contained.groupBy("req_id").agg(F.min("doc_id").alias("doc_id"))
    best = S.match_biblio(passages(t), index).filter("blocking_rank = 1").select(
        "req_id", F.col("id").alias("doc_id")
    )
    return R.evaluate_matching(best, truth, value="doc_id")


def inner_tokens(t: Tables):
    """Passage tokens that are whole words in any text around the passage: all but
    the first and last, which may be parts of longer words, unless there are no others."""
    words = analyze(F.col("biblio"), "words_stop")
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(words)
    return passages(t).select("req_id", F.explode(F.array_distinct(inner)).alias("token"))


def page_records(t: Tables):
    """Web pages in the shape of search records.

    Title from the page, host as journal, its last label but one as author,
    language as volume, path number as first page and year.  Pages served
    over https carry a DOI.
    """
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    labels = F.split(host, r"\.")
    lang = F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/", 1)
    number = F.regexp_extract(url, "^https?://[^/]+/[a-z]+/([0-9]+)", 1)
    hal_id = F.concat(F.lit("hal-"), F.col("page_id").cast("string"))
    fields = t.pages.select(
        "page_id",
        F.concat(F.lit("hal:"), hal_id).alias("id"),
        F.when(url.startswith("https:"), F.concat(F.lit("10.5555/p"), F.col("page_id").cast("string"))).alias("doi"),
        hal_id.alias("hal_id"),
        F.lit("hal").alias("source"),
        F.array(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"),
        F.get(labels, F.size(labels) - 3).alias("first_author"),
        F.array(host).alias("journal"),
        F.array(F.get(labels, F.lit(0))).alias("abbreviated_journal"),
        lang.alias("volume"),
        number.alias("first_page"),
        number.alias("year"),
    )
    text = F.concat_ws(
        " ", "first_author", F.get("title", F.lit(0)), F.get("journal", F.lit(0)), "volume", "first_page"
    )
    return fields.withColumn("bibliographic", text)


def page_store(t: Tables) -> Store:
    """All key tables of the page records, for the request router."""
    records = materialise(page_records(t), "page-records")
    json = F.to_json(F.struct(F.col("doi").alias("DOI"), "title", F.col("hal_id").alias("halId")))
    works = records.filter(F.col("doi").isNotNull()).select(
        "doi", json.alias("json"), F.get("title", F.lit(0)).alias("record_title"),
        F.col("first_author").alias("record_author"),
    )
    hal = records.select(
        "hal_id", "doi", json.alias("json"), F.get("title", F.lit(0)).alias("record_title"),
        F.col("first_author").alias("record_author"),
    )
    spark = t.spark
    ids = spark.createDataFrame([], "pmid string, pmcid string, doi string, license string, subpath string")
    archive = spark.createDataFrame(
        [], "key string, istex_id string, doi array<string>, ark array<string>, pmid array<string>,"
        " pmc array<string>, mesh array<string>, pii array<string>"
    )
    links = records.filter(F.col("doi").isNotNull()).select(
        "doi", F.concat(F.lit("https://pdf.example.org/"), F.col("hal_id")).alias("oa_url")
    )
    return Store(
        works=works, hal_works=hal,
        pmid_maps={k: ids for k in ("doi", "pmid", "pmcid")},
        istex_maps={k: archive for k in ("doi", "pii", "istex_id")},
        oa_links=links,
        doi_hal=records.filter(F.col("doi").isNotNull()).select("doi", "hal_id"),
        records=records,
        index=S.build_index(records, carry=("volume", "first_page")),
    )


@query(
    "X3_match_title_author",
    f"""WITH {PAGE_SQL},
    rec AS (SELECT *, string_split(host, '.')[-3] AS author FROM page),
    tok AS (
        SELECT page_id, 'title' AS field, unnest({tokens_sql('title')}) AS token FROM rec
        UNION ALL
        SELECT page_id, 'first_author', {FOLD.format('author')} FROM rec
        WHERE regexp_matches(author, '\\S')),
    post AS (SELECT field, token, page_id, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT field, page_id, count(*) AS doc_len FROM tok GROUP BY ALL),
    stats AS (SELECT field, count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl GROUP BY field),
    df AS (SELECT field, token, count(*) AS df FROM post GROUP BY ALL),
    usable AS (SELECT page_id FROM rec
               WHERE regexp_matches(title, '\\S') AND regexp_matches(author, '\\S')),
    req AS (SELECT DISTINCT page_id AS req_id, field, token FROM tok
            WHERE page_id IN (SELECT page_id FROM usable)),
    score AS (
        SELECT req_id, p.page_id, round(sum(
            ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
            * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / s.avg_len))), 6) AS score
        FROM req JOIN df d USING (field, token) JOIN post p USING (field, token)
        JOIN dl l ON l.page_id = p.page_id AND l.field = p.field
        JOIN stats s ON s.field = p.field GROUP BY ALL)
    SELECT req_id, page_id, score FROM (SELECT *, row_number() OVER (
        PARTITION BY req_id ORDER BY score DESC, page_id) AS rnk FROM score) WHERE rnk <= 4""",
)
def match_title_author(t: Tables):
    records = page_records(t)
    requests = records.select(
        F.col("page_id").alias("req_id"), F.get("title", F.lit(0)).alias("atitle"), "first_author"
    )
    fields = {f: (f, S.FIELD_ANALYZERS[f]) for f in ("title", "first_author")}
    index = S.build_index(records, fields, id="page_id")
    rows = S.match_title_author(requests, index, pruned=True)
    return rows.select("req_id", F.col("id").alias("page_id"), F.col("raw_score").alias("score"))


@query(
    "X4_match_journal",
    f"""WITH {PAGE_SQL},
    rec AS (SELECT *, string_split(host, '.')[-3] AS author FROM page),
    tok AS (
        SELECT page_id, 'journal' AS field, unnest({tokens_sql('host')}) AS token FROM rec
        UNION ALL SELECT page_id, 'abbreviated_journal', {FOLD.format("string_split(host, '.')[1]")} FROM rec
        UNION ALL SELECT page_id, 'volume', {FOLD.format('lang')} FROM rec WHERE lang <> ''
        UNION ALL SELECT page_id, 'first_page', num FROM rec WHERE num <> ''
        UNION ALL SELECT page_id, 'first_author', {FOLD.format('author')} FROM rec
        WHERE regexp_matches(author, '\\S')),
    post AS (SELECT field, token, page_id, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT field, page_id, count(*) AS doc_len FROM tok GROUP BY ALL),
    stats AS (SELECT field, count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl GROUP BY field),
    df AS (SELECT field, token, count(*) AS df FROM post GROUP BY ALL),
    pair AS (SELECT a.page_id AS req_id, b.page_id FROM rec a JOIN rec b
             ON a.lang = b.lang AND a.num = b.num WHERE a.lang <> '' AND a.num <> ''),
    req AS (SELECT DISTINCT page_id AS req_id, field, token FROM tok WHERE field <> 'abbreviated_journal'
            UNION SELECT page_id, 'abbreviated_journal', {FOLD.format('host')} FROM rec),
    score AS (
        SELECT pair.req_id, pair.page_id, round(sum(
            ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
            * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / s.avg_len))), 6) AS score
        FROM pair JOIN req ON req.req_id = pair.req_id
        JOIN df d USING (field, token)
        JOIN post p ON p.field = req.field AND p.token = req.token AND p.page_id = pair.page_id
        JOIN dl l ON l.page_id = p.page_id AND l.field = p.field
        JOIN stats s ON s.field = p.field GROUP BY ALL)
    SELECT req_id, page_id, score FROM (SELECT *, row_number() OVER (
        PARTITION BY req_id ORDER BY score DESC, page_id) AS rnk FROM score) WHERE rnk <= 4""",
)
def match_journal(t: Tables):
    records = page_records(t).drop("id").withColumnRenamed("page_id", "id")
    requests = records.select(
        F.col("id").alias("req_id"), F.get("journal", F.lit(0)).alias("jtitle"), "volume",
        "first_page", "first_author",
    )
    names = ("journal", "abbreviated_journal", "volume", "first_page", "first_author")
    index = S.build_index(
        records, {f: (f, S.FIELD_ANALYZERS[f]) for f in names}, carry=("volume", "first_page")
    )
    rows = S.match_journal(requests, index)
    return rows.select("req_id", F.col("id").alias("page_id"), F.col("raw_score").alias("score"))


@query("X8_ratcliff_obershelp", gestalt_sql.PAIR_SIMILARITY_SQL)
def similarity(t: Tables):
    """Title similarity of every page and its best other page by text relevance."""
    records = materialise(page_records(t), "page-records")
    requests = records.select(
        F.col("page_id").alias("req_id"), F.col("bibliographic").alias("biblio"),
        F.col("id").alias("own_id"), F.get("title", F.lit(0)).alias("atitle"),
    )
    index = S.build_index(records, {"bibliographic": ("bibliographic", "words_stop")})
    top = S.match_biblio_conditional(requests, index, exclude="own_id", pruned=True)
    pairs = candidate_fields(top, records).join(requests.select("req_id", "atitle"), "req_id")
    return pairs.select(
        "req_id", "id", F.round(ratcliff_obershelp(F.col("atitle"), F.col("c_title")), 6).alias("similarity")
    )


RANK_SQL = f"""WITH {DOC_SCORES_SQL},
b AS (SELECT *, least(min(score) OVER (PARTITION BY item_id), 1.0) AS lo,
             greatest(max(score) OVER (PARTITION BY item_id), 0.0) AS hi FROM top),
s AS (SELECT b.item_id, b.doc_id, b.rnk,
             CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS blocking,
             CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.0 END AS same_year
      FROM b JOIN documents d USING (doc_id)),
m AS (SELECT *, round((blocking + same_year) / 2, 6) AS matching_score,
             (blocking + same_year) / 2 AS exact_score FROM s),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
         ORDER BY round(exact_score, 6) DESC, rnk) AS mr FROM m))
"""


def _ranked(t: Tables):
    """Candidates ranked by relevance and equal language, wanted to be English."""
    scaled = S.minmax_blocking_score(matched_passages(t)).withColumnRenamed("id", "doc_id")
    pairs = scaled.join(t.documents.select("doc_id", F.col("lang").alias("c_year")), "doc_id")
    return R.pairwise_rank(
        pairs.withColumn("year", F.lit("en")), title=None, author=None, journal=None
    )


@query(
    "X9_pairwise_rank",
    RANK_SQL + "SELECT item_id, doc_id, mr AS match_rank, matching_score FROM best",
)
def pairwise_rank(t: Tables):
    return _ranked(t).select(
        F.col("req_id").alias("item_id"), "doc_id", "match_rank",
        "matching_score",
    )


@query(
    "X10_accept",
    RANK_SQL + """SELECT item_id, doc_id, CASE WHEN round(exact_score, 6) >= 0.7 THEN 'found'
    ELSE 'not_found' END AS status, CASE WHEN round(exact_score, 6) < 0.7 THEN
    'Best bibliographical record did not passed the post-validation' END AS reason
    FROM best WHERE mr = 1""",
)
def accept(t: Tables):
    return R.accept(R.best_match(_ranked(t))).select(
        F.col("req_id").alias("item_id"), "doc_id", "status", "reason"
    )


@query(
    "X11_with_parsed_fields",
    """SELECT conv_id || '-' || turn AS req_id,
        CASE WHEN role = 'user' THEN text ELSE 'parsed ' || text END AS atitle,
        CASE WHEN role = 'user' THEN role ELSE 'monograph' END AS first_author,
        CAST(turn AS VARCHAR) AS jtitle, CAST(2000 + turn AS VARCHAR) AS year
    FROM conversations""",
)
def with_parsed_fields(t: Tables):
    """Conversation turns as requests; only user turns bring their own title."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    user = F.col("role") == "user"
    requests = t.conversations.select(
        key.alias("req_id"), F.when(user, F.col("text")).alias("atitle"),
        F.when(user, F.col("role")).otherwise("").alias("first_author"),
        F.lit(None).cast("string").alias("jtitle"), F.lit(" ").alias("year"),
    )
    parsed = t.conversations.select(
        key.alias("req_id"), F.concat(F.lit("parsed "), F.col("text")).alias("parsed_atitle"),
        F.lit("").alias("parsed_first_author"), F.lit("monograph").alias("parsed_monograph_author"),
        F.col("turn").cast("string").alias("parsed_jtitle"),
        (F.col("turn") + 2000).cast("string").alias("parsed_year"),
    )
    return R.with_parsed_fields(requests, parsed).select(
        "req_id", "atitle", "first_author", "jtitle", "year"
    )


@query("L12_resolve_text_requests")
def resolve_text_requests(t: Tables):
    """Every page asked for three ways: citation string, title and author, journal."""
    store = page_store(t)
    none = F.lit(None).cast("string")
    kinds = F.explode(F.array(F.lit("b"), F.lit("t"), F.lit("j")))
    rows = store.records.select("*", kinds.alias("kind"))
    on = lambda k, c: F.when(F.col("kind") == k, c)
    title = F.get("title", F.lit(0))
    requests = rows.select(
        F.concat_ws("-", "kind", F.col("page_id").cast("string")).alias("req_id"),
        *[none.alias(c) for c in ("doi", "halid", "pmid", "pmc", "pii", "istexid")],
        on("b", F.col("bibliographic")).alias("biblio"),
        F.when(F.col("kind") != "j", title).alias("atitle"),
        F.col("first_author"),
        on("j", F.get("journal", F.lit(0))).alias("jtitle"),
        on("j", F.col("volume")).alias("volume"),
        on("j", F.col("first_page")).alias("first_page"),
        on("b", F.col("year")).alias("year"),
    )
    return resolve_requests(requests, store)


def _page_audit_index(records):
    return S.build_index(
        records.withColumn("has_doi", F.col("doi").isNotNull()),
        {"bibliographic": ("bibliographic", "words_stop")}, carry=("has_doi", "source"),
    )


@query("A1_audit_missing_doi", gestalt_sql.MISSING_DOI_SQL)
def missing_doi(t: Tables):
    records = materialise(page_records(t), "page-records")
    return audit_missing_doi(records, _page_audit_index(records), pruned=True)


@query("A2_audit_duplicates", gestalt_sql.DUPLICATES_SQL)
def duplicates(t: Tables):
    records = materialise(page_records(t), "page-records")
    return audit_duplicates(records, _page_audit_index(records), pruned=True)


@query("A3_audit_summary", gestalt_sql.SUMMARY_SQL)
def summary(t: Tables):
    records = materialise(page_records(t), "page-records")
    index = _page_audit_index(records)
    return audit_summary(
        records,
        audit_missing_doi(records, index, pruned=True),
        audit_duplicates(records, index, pruned=True),
    )


@query("X1_index_kept_current", TOP_SQL)
def index_kept_current(t: Tables):
    """Passages matched in an index of four batches: stale texts, the right ones, more records, and their deletion."""
    from biblioweave.session import scratch_path
    from biblioweave.streaming.index import apply_changes, current_index

    root = scratch_path(t.spark, "index-log")
    docs = t.documents.select("doc_id", "text")
    stale = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("stale "), F.substring("text", 1, 200))).otherwise(F.col("text")))
    more = docs.withColumn("doc_id", -1 - F.col("doc_id"))
    apply_changes(stale, 0, root, TEXT, id="doc_id")
    apply_changes(docs.where("doc_id % 3 = 0"), 1, root, TEXT, id="doc_id")
    apply_changes(more, 2, root, TEXT, id="doc_id")
    apply_changes(docs.where("doc_id % 50 = 0"), 3, root, TEXT, id="doc_id", deleted=more.select("doc_id"))
    return _top(S.match_biblio(passages(t), current_index(t.spark, root)))
