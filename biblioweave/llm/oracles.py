"""SQL that says the same as some of the operators, for an independent check."""

_QUALITY = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM windows WHERE n > 1) GROUP BY doc_id),
base AS (
    SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM d LEFT JOIN covered USING (doc_id)),
normal AS (
    SELECT doc_id, host, ls, list_transform(ls, lambda x: trim(regexp_replace(
        regexp_replace(lower(x), '\p{N}', '0', 'g'), '[^\p{L}0]+', ' ', 'g'))) AS ns
    FROM d),
places AS (
    SELECT doc_id, host, array_to_string(ns, chr(10)) AS same, ns[i] AS line,
        len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM normal)),
hosts AS (SELECT host, count(DISTINCT same) AS docs FROM places GROUP BY host),
often AS (SELECT host, line, count(DISTINCT same) AS n FROM places GROUP BY host, line),
boilerplate AS (SELECT host, line FROM often JOIN hosts USING (host) WHERE n > $line_docs AND n > $line_share * docs),
lost AS (SELECT doc_id, sum(n) AS n FROM places JOIN boilerplate USING (host, line) GROUP BY doc_id)
SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(lost.n, 0) <= 0.8 * n_words AS kept
FROM base LEFT JOIN lost USING (doc_id)
"""


def quality(line_docs: int = 20, line_share: float = 0.005) -> str:
    return _QUALITY.replace("$line_docs", str(line_docs)).replace("$line_share", str(line_share))


# Winnowing of a text column: its chosen (position, hash) pairs in order of position.
_CHOSEN = r"""
    SELECT doc_id, list_sort(list_distinct(list_transform(ks, lambda k: {{'p': 4294967295 - k % 4294967296, 'h': k // 4294967296}}))) AS {name}
    FROM (SELECT doc_id, CASE WHEN len(gs) = 0 THEN [] WHEN len(gs) < 4 THEN [list_min(gs)]
            ELSE list_transform(range(1, len(gs) - 2), lambda i: list_min(gs[i:i + 3])) END AS ks
        FROM (SELECT doc_id, list_transform(gs, lambda g, i: g * 4294967296 + 4294967295 - (i - 1)) AS gs
            FROM (SELECT doc_id, CASE WHEN len(h) <= 1 THEN h WHEN len(h) = 2 THEN [(h[1] * 131071 + h[2]) % 268435399]
                    WHEN len(h) = 3 THEN [((h[1] * 131071 + h[2]) % 268435399 * 268176904
                        + (h[2] * 131071 + h[3]) % 268435399) % 268435399]
                    ELSE list_transform(range(1, len(h) - 2), lambda i: ((((h[i] * 131071 + h[i + 1]) % 268435399) * 131071 + h[i + 2])
                        % 268435399 * 131071 + h[i + 3]) % 268435399) END AS gs
                FROM (SELECT doc_id, list_transform(regexp_extract_all({text},
                    '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]|[^\x20\x09-\x0D\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}]{{1,16}}'),
                    lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) % 268435399) AS h FROM edited))))"""
_AS_TEXT = "array_to_string(list_transform({0}, lambda c: c.h || ':' || c.p), ',')"
_HASHES = "list_distinct(list_transform({0}, lambda c: c.h))"


def _likeness(a: str, b: str) -> str:
    one, other = _HASHES.format(a), _HASHES.format(b)
    both = f"len(list_intersect({one}, {other}))"
    return f"CASE WHEN len({one}) + len({other}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({one}) + len({other}) - {both}) END"


FINGERPRINTS = f"""
WITH placed AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(
        lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS following,
        coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id
    FROM documents WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edited AS (
    SELECT *, substr(t, 1, length(t) - length(t) // 3) || substr(following, 1, length(t) // 3) AS e FROM placed),
own AS ({_CHOSEN.format(name="f", text="t")}),
other AS ({_CHOSEN.format(name="g", text="e")})
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, {_AS_TEXT.format("f")} AS fingerprint,
    {_AS_TEXT.format("g")} AS edited_fingerprint, {_likeness("f", "g")} AS near_edited, {_likeness("f", "nf")} AS near_next
FROM edited JOIN own USING (doc_id) JOIN other USING (doc_id) JOIN (SELECT doc_id AS next_id, f AS nf FROM own) USING (next_id)
"""

EXACT = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)
"""

INTERACTIONS = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents),
failing AS (
    SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
    FROM d),
told AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
groups AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM failing LEFT JOIN told USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z
    WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
steps AS (
    SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[:step - 1] AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
cells AS (
    SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit,
        translate(fails, before, '') <> fails AS earlier, replace(fails, f, '') = '' AS lone
    FROM steps, groups),
summed AS (
    SELECT part, filter_order, step, f,
        CAST(coalesce(sum(n) FILTER (NOT hit AND NOT earlier), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (hit AND earlier), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (hit AND lone), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (hit AND NOT earlier), 0) AS BIGINT) AS toxic_lost
    FROM cells GROUP BY ALL)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""

# Any phrase of two words is in at most two candidates of three words at each of its places.
PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, ws FROM (
        SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (
            SELECT lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
grams AS (
    SELECT lang, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1])) AS g
    FROM pieces, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ws) >= n),
counts AS (SELECT lang, n AS size, g, count(*) AS f FROM grams GROUP BY lang, n, g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, g, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.size, c.g, c.a, x.f AS l, y.f AS r, k,
        CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_pairs AS (
    SELECT lang, g, max(a) AS a FROM (
        SELECT lang, g[1:2] AS g, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, g[2:3], a FROM candidates WHERE size = 3) GROUP BY lang, g),
kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN inner_pairs i ON i.lang = lowest.lang AND i.g = lowest.g
    WHERE i.a IS NULL OR 100 * i.a < 50 * lowest.a),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM named)
JOIN totals USING (lang) WHERE rank <= 2000
"""
