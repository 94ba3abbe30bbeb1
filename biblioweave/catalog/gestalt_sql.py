"""The similarity and the page audits as SQL, for checks only."""

from biblioweave.catalog.matching_sql import PAGE_SQL, tokens_sql

# Similarity of all rows (x, y) of a relation ``pair``: common diagonals of the
# two texts, then the longest, leftmost block and both sides of it, over again.
SIMILARITY_SQL = """
p AS (SELECT row_number() OVER () AS id, x, y FROM (SELECT DISTINCT x, y FROM pair)),
todo AS (SELECT * FROM p WHERE x <> y AND regexp_matches(x, '\\S') AND regexp_matches(y, '\\S')),
cell AS (
    SELECT id, i, j FROM (SELECT id, unnest(range(1, length(x) + 1)) AS i, x, y FROM todo) a,
        LATERAL (SELECT unnest(range(1, length(y) + 1)) AS j) b
    WHERE substr(x, i, 1) = substr(y, j, 1)),
run AS (
    SELECT id, min(i) AS i0, i - j AS d, count(*) AS n FROM (
        SELECT *, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS g FROM cell)
    GROUP BY id, i - j, g),
seg AS (
    SELECT id, 1 AS alo, CAST(length(x) AS BIGINT) AS ahi, 1 AS blo, CAST(length(y) AS BIGINT) AS bhi,
           CAST(0 AS BIGINT) AS matched FROM todo
    UNION ALL
    SELECT id, CASE k WHEN 1 THEN alo WHEN 2 THEN s + l ELSE 0 END, CASE k WHEN 1 THEN s - 1 WHEN 2 THEN ahi ELSE 0 END,
           CASE k WHEN 1 THEN blo WHEN 2 THEN s - d + l ELSE 0 END,
           CASE k WHEN 1 THEN s - d - 1 WHEN 2 THEN bhi ELSE 0 END, CASE k WHEN 3 THEN l ELSE 0 END
    FROM (
        SELECT *, row_number() OVER (PARTITION BY id, alo, blo ORDER BY l DESC, s, s - d) AS rn FROM (
            SELECT seg.id, alo, ahi, blo, bhi, d, greatest(i0, alo, blo + d) AS s,
                   least(i0 + n - 1, ahi, bhi + d) - greatest(i0, alo, blo + d) + 1 AS l
            FROM seg JOIN run ON run.id = seg.id WHERE matched = 0 AND ahi >= alo AND bhi >= blo)
        WHERE l > 0), (VALUES (1), (2), (3)) AS v(k)
    WHERE rn = 1),
sim AS (
    SELECT p.x, p.y, CASE WHEN NOT (regexp_matches(p.x, '\\S') AND regexp_matches(p.y, '\\S')) THEN 0.0
        WHEN p.x = p.y THEN 1.0
        ELSE 2.0 * coalesce(m.total, 0) / (length(p.x) + length(p.y)) END AS similarity
    FROM p LEFT JOIN (SELECT id, sum(matched) AS total FROM seg GROUP BY id) m USING (id))
"""


def page_candidates_sql(requests: str, condition: str) -> str:
    """Top four pages per requesting page by relevance, with scaled scores."""
    return f"""
{PAGE_SQL},
rec AS (SELECT *, string_split(host, '.')[-3] AS author, string_split(host, '.')[1] AS abbr,
        concat_ws(' ', string_split(host, '.')[-3], title, host, lang, num) AS bib FROM page),
tok AS (SELECT page_id, unnest({tokens_sql('bib')}) AS token FROM rec),
post AS (SELECT token, page_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT page_id, count(*) AS doc_len FROM tok GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM dl),
df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
score AS (
    SELECT q.page_id AS req_id, p.page_id, round(sum(
        ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
        * p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.doc_len / s.avg_len))), 6) AS score
    FROM post q JOIN df d USING (token) JOIN post p USING (token)
    JOIN dl l ON l.page_id = p.page_id JOIN rec c ON c.page_id = p.page_id
    JOIN rec r ON r.page_id = q.page_id CROSS JOIN stats s
    WHERE {requests} AND {condition} GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY req_id ORDER BY score DESC, 'hal:hal-' || page_id) AS rnk FROM score) WHERE rnk <= 4),
scaled AS (SELECT req_id, page_id, rnk, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS blocking
    FROM (SELECT *, least(min(score) OVER (PARTITION BY req_id), 1.0) AS lo,
                 greatest(max(score) OVER (PARTITION BY req_id), 0.0) AS hi FROM top))"""


def audit_sql(requests: str, condition: str) -> str:
    """Accepted best candidate per requesting page as ``best``."""
    given = lambda c: f"regexp_matches(coalesce(r.{c}, ''), '\\S')"
    names = (("title", "title"), ("author", "author"), ("host", "host"), ("host", "abbr"))
    pairs = " UNION ALL ".join(
        f"SELECT coalesce(lower(r.{a}), '') AS x, coalesce(lower(c.{b}), '') AS y FROM scaled s "
        "JOIN rec r ON r.page_id = s.req_id JOIN rec c ON c.page_id = s.page_id"
        for a, b in names
    )
    joins = " ".join(
        f"JOIN sim s{i} ON s{i}.x = coalesce(lower(r.{a}), '') AND s{i}.y = coalesce(lower(c.{b}), '')"
        for i, (a, b) in enumerate(names)
    )
    return f"""WITH RECURSIVE {page_candidates_sql(requests, condition)},
pair AS ({pairs}),
{SIMILARITY_SQL},
m AS (
    SELECT s.req_id, s.page_id, s.rnk, r.author, round((blocking
        + CASE WHEN {given('title')} THEN s0.similarity ELSE 0 END
        + CASE WHEN {given('author')} THEN s1.similarity ELSE 0 END
        + CASE WHEN {given('host')} AND c.has_doi THEN greatest(s2.similarity, s3.similarity) ELSE 0 END
        + CASE WHEN {given('num')} AND r.num = c.num THEN 1 ELSE 0 END)
        / (1 + CAST({given('title')} AS INT) + CAST({given('author')} AS INT)
           + CAST({given('host')} AND c.has_doi AS INT) + CAST({given('num')} AS INT)), 6) AS score
    FROM scaled s JOIN rec r ON r.page_id = s.req_id JOIN rec c ON c.page_id = s.page_id {joins}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, rnk) AS mr FROM m)
    WHERE mr = 1 AND score >= 0.7 AND regexp_matches(coalesce(author, ''), '\\S'))"""


SELF = ("TRUE", "q.page_id <> p.page_id")
NO_DOI = ("NOT r.has_doi", "c.has_doi")

PAIR_SIMILARITY_SQL = f"""WITH RECURSIVE {page_candidates_sql(*SELF)},
pair AS (SELECT lower(r.title) AS x, lower(c.title) AS y FROM scaled s
    JOIN rec r ON r.page_id = s.req_id JOIN rec c ON c.page_id = s.page_id),
{SIMILARITY_SQL}
SELECT s.req_id, 'hal:hal-' || s.page_id AS id, round(similarity, 6) AS similarity FROM scaled s
JOIN rec r ON r.page_id = s.req_id JOIN rec c ON c.page_id = s.page_id
JOIN sim ON sim.x = lower(r.title) AND sim.y = lower(c.title)"""

MISSING_DOI_SQL = audit_sql(*NO_DOI) + """
SELECT 'hal-' || req_id AS hal_id, '10.5555/p' || page_id AS doi, score FROM best"""

DUPLICATES_SQL = audit_sql(*SELF) + """
SELECT 'hal-' || req_id AS hal_id, 'hal-' || page_id AS duplicate_of, score FROM best"""

SUMMARY_SQL = f"""SELECT visited, has_doi, visited - has_doi AS lookups, dois_found, duplicates FROM
(SELECT count(*) AS visited, count(*) FILTER (WHERE url LIKE 'https:%') AS has_doi FROM pages),
(SELECT count(*) AS dois_found FROM ({MISSING_DOI_SQL})),
(SELECT count(*) AS duplicates FROM ({DUPLICATES_SQL}))"""
