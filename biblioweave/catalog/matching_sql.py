"""SQL pieces shared by the checks of the matching queries."""

from biblioweave.functions.text import ENGLISH_STOP_WORDS

STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
FOLD = "strip_accents(replace(replace(replace(lower({0}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"
WORDS = "regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"


def tokens_sql(column: str) -> str:
    return f"[x FOR x IN {WORDS.format(column)} IF x NOT IN ({STOP})]"


PAGE_SQL = r"""
page AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
    regexp_extract(url, '^https?://([^/]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
    regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS num,
    url LIKE 'https:%' AS has_doi
  FROM pages)
"""
