"""Blocking, similarity, ranking and audits against plain Python."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biblioweave.functions.similarity import gestalt_ratio, ratcliff_obershelp
from biblioweave.functions.text import ENGLISH_STOP_WORDS
from biblioweave.operators import audit, ranking, search
from biblioweave.operators.lookup import NOT_VALIDATED, post_validate


def ratio_by_recursion(a: str, b: str) -> float:
    """Similarity by trying every common block, longest and leftmost first."""

    def matched(x, y):
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        return n and n + matched(x[:i], y[:j]) + matched(x[i + n:], y[j + n:])

    return 2 * matched(a, b) / (len(a) + len(b))


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=14), st.text("abcd ", min_size=1, max_size=14))
def test_ratio_equals_recursion(a, b):
    assert gestalt_ratio(a, b) == pytest.approx(ratio_by_recursion(a, b))


def test_similarity_column(spark):
    rows = [("", "x"), ("ABC", "abc"), ("GESTALT", "gestalt theory"), (None, "x"), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(ratcliff_obershelp(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, pytest.approx(14 / 21), 0.0, 0.0]


def bm25_by_hand(docs: dict[int, str], requests: dict[int, str], k: int):
    """Top k per request over word tokens."""
    words = lambda s: [w for w in re.findall(r"[a-z0-9]+", s.lower()) if w not in ENGLISH_STOP_WORDS]
    tokens = {d: words(s) for d, s in docs.items()}
    tokens = {d: t for d, t in tokens.items() if t}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = set()
    for req, s in requests.items():
        scores = {}
        for w in set(words(s)):
            df = sum(w in t for t in tokens.values())
            idf = math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) if df else 0
            for d, t in tokens.items():
                if w in t:
                    tf = t.count(w)
                    norm = 1.2 * (0.25 + 0.75 * len(t) / mean)
                    scores[d] = scores.get(d, 0) + idf * tf / (tf + norm)
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]
        out |= {(req, d, round(s, 6)) for d, s in best}
    return out


def small_corpus(seed: int, hot: bool):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = {}
    for d in range(120):
        text = rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 12))
        if hot and d % 3 == 0:
            text += ["everywhere"] * rng.randint(1, 3)
        docs[d] = " ".join(text)
    return docs


@pytest.mark.parametrize("pruned", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_top_candidates_equal_brute_force(spark, pruned, hot):
    docs = small_corpus(7, hot)
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")})
    requests = df.select(F.col("id").alias("req_id"), F.col("text").alias("biblio"))
    got = search.match_biblio(requests, index, pruned=pruned)
    got = {(r.req_id, r.id, r.raw_score) for r in got.collect()}
    want = bm25_by_hand(docs, docs, 4)
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert {(a, b): s for a, b, s in got} == pytest.approx({(a, b): s for a, b, s in want}, abs=2e-6)


def test_hot_tokens_are_salted(spark):
    docs = [(i, "common " + f"own{i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "id long, text string")
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")})
    salts = {r.token: r.salts for r in index.token_stats.filter("salts > 1").collect()}
    assert set(salts) == {"common"} and salts["common"] > 100
    requests = spark.createDataFrame([(1, "common")], "req_id long, biblio string")
    got = search.match_biblio(requests, index, k=3).collect()
    assert sorted(r.id for r in got) == [0, 1, 2]


def test_repeated_request_tokens(spark):
    df = spark.createDataFrame([(1, "a1 a1 b1")], "id long, text string")
    fields = {"bibliographic": ("text", "words_stop")}
    plain = search.request_tokens(df, fields, req_id="id").collect()
    counted = search.request_tokens(df, fields, req_id="id", repeats=True).collect()
    assert sorted((r.token, r.weight) for r in plain) == [("a1", 1), ("b1", 1)]
    assert sorted((r.token, r.weight) for r in counted) == [("a1", 2), ("b1", 1)]


def test_minmax_blocking_score(spark):
    rows = [("one", 1, 5.0), ("two", 1, 5.0), ("two", 2, 3.0), ("flat", 1, 1.0), ("low", 1, 0.5), ("low", 2, 0.4)]
    df = spark.createDataFrame(rows, "req_id string, id long, raw_score double")
    got = {(r.req_id, r.id): r.blocking_score for r in search.minmax_blocking_score(df).collect()}
    assert got[("one", 1)] == 1.0
    assert got[("two", 1)] == 1.0 and got[("two", 2)] == pytest.approx((3 - 1) / (5 - 1))
    assert got[("flat", 1)] == 1.0
    assert got[("low", 1)] == 1.0 and got[("low", 2)] == 0.0


CANDIDATE = (
    "req_id string, id string, blocking_rank int, blocking_score double, atitle string, first_author string, "
    "jtitle string, year string, c_title string, c_first_author string, c_journal string, "
    "c_abbreviated_journal string, c_year string, c_doi string"
)


def rank(spark, *rows, **options):
    df = spark.createDataFrame(list(rows), CANDIDATE)
    ranked = ranking.pairwise_rank(df, has_strong_id=F.col("c_doi").isNotNull(), **options)
    return {(r.req_id, r.id): r for r in ranked.collect()}


def test_pairwise_rank_criteria(spark):
    got = rank(
        spark,
        # all five criteria, journal by its abbreviation
        ("a", "1", 1, 1.0, "T", "X", "J", "2001", "t", "x", "zzz", "j", "2001", "10.1/1"),
        # no strong id: the journal is not compared
        ("a", "2", 2, 0.0, "T", "X", "J", "2001", "t", "x", None, None, "2001", None),
        # blank request fields are skipped, missing candidate fields score 0
        ("b", "1", 1, 0.5, " ", "X", None, None, "t", None, None, None, None, "10.1/1"),
        # equal scores keep the blocking order
        ("c", "1", 2, 0.5, None, None, None, None, None, None, None, None, None, None),
        ("c", "2", 1, 0.5, None, None, None, None, None, None, None, None, None, None),
    )
    assert got[("a", "1")].matching_score == 1.0 and got[("a", "1")].match_rank == 1
    assert got[("a", "2")].matching_score == pytest.approx(3 / 4)
    assert got[("b", "1")].matching_score == 0.25
    assert got[("c", "2")].match_rank == 1 and got[("c", "1")].match_rank == 2


def test_accept_threshold_and_author(spark):
    rows = [("a", 0.7, "X"), ("b", 0.699999, "X"), ("c", 0.9, " ")]
    df = spark.createDataFrame(rows, "req_id string, matching_score double, first_author string")
    got = {r.req_id: (r.status, r.reason) for r in ranking.accept(df, author="first_author").collect()}
    assert got["a"] == ("found", None)
    assert got["b"] == ("not_found", NOT_VALIDATED)
    assert got["c"] == ("not_found", ranking.NO_METADATA)


def test_post_validate(spark):
    rows = [
        ("same", "A Title", "Doe", "a title", "doe"), ("title only", "A Title", None, "a title", "doe"),
        ("wrong author", "A Title", "Zzz", "a title", "doe"), ("nothing", None, " ", "t", "d"),
        ("no record author", None, "Doe", "t", None),
    ]
    df = spark.createDataFrame(
        rows, "req_id string, atitle string, first_author string, record_title string, record_author string"
    ).withColumns({"status": F.lit("found"), "reason": F.lit(None).cast("string")})
    loose = {r.req_id: r.status for r in post_validate(df).collect()}
    strict = {r.req_id: r.status for r in post_validate(df, strict=True).collect()}
    assert loose == {
        "same": "found", "title only": "found", "wrong author": "not_found", "nothing": "found",
        "no record author": "not_found",
    }
    assert strict == {**loose, "title only": "not_found"}


def test_evaluate_matching(spark):
    truth = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "req_id string, doi string")
    found = spark.createDataFrame([("a", "1"), ("b", "9")], "req_id string, doi string")
    row = ranking.evaluate_matching(found, truth).collect()[0]
    assert tuple(row) == (3, 2, 1, 0.5, 0.333333, 0.4)


def audit_records(spark):
    def record(key, doi, title, author, year, source="hal"):
        text = f"{author} {title} Journal {year}"
        return (f"{source}:{key}", doi, key, source, [title], author, ["Journal"], None, year, text)

    rows = [
        record("h1", None, "Deep sea corals of the north", "Smith", "2001"),
        record("h2", "10.1/h2", "Deep sea corals of the north", "Smith", "2001"),
        record("h3", None, "Entirely different matter", "Jones", "1999"),
        record("h4", "10.1/h4", "Quantum walks on graphs", "Kim", "2010"),
        record("h5", None, "Quantum walks on some graphs", "Kim", "2010"),
    ]
    schema = (
        "id string, doi string, hal_id string, source string, title array<string>, first_author string, "
        "journal array<string>, abbreviated_journal array<string>, year string, bibliographic string"
    )
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("pruned", [False, True])
def test_audits(spark, pruned):
    records = audit_records(spark)
    index = search.build_index(
        records.withColumn("has_doi", F.col("doi").isNotNull()),
        {"bibliographic": ("bibliographic", "words_stop")}, carry=("has_doi", "source"),
    )
    missing = audit.audit_missing_doi(records, index, pruned=pruned)
    assert {(r.hal_id, r.doi) for r in missing.collect()} == {("h1", "10.1/h2"), ("h5", "10.1/h4")}
    duplicates = audit.audit_duplicates(records, index, pruned=pruned)
    assert {(r.hal_id, r.duplicate_of) for r in duplicates.collect()} == {
        ("h1", "h2"), ("h2", "h1"), ("h4", "h5"), ("h5", "h4"),
    }
    row = audit.audit_summary(records, missing, duplicates).collect()[0]
    assert tuple(row) == (5, 2, 3, 2, 4)


def best_others(docs: dict[int, str], k: int):
    """Brute-force top k other records per record."""
    want = {}
    for r, d, s in bm25_by_hand(docs, docs, len(docs)):
        if r != d:
            want.setdefault(r, []).append((-s, d))
    return {(r, d) for r, rows in want.items() for _, d in sorted(rows)[:k]}


@pytest.mark.parametrize("pruned", [False, True])
def test_a_third_of_all_records_are_copies(spark, pruned):
    docs = small_corpus(3, hot=True)
    docs.update({1000 + i: "same words copied w1 w5" for i in range(60)})
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")})
    # copies are indexed once, under their smallest id
    assert index.postings.filter("id >= 1000").select("id").distinct().count() == 1
    assert index.members.filter("rep >= 1000").count() == search.BLOCK_SIZE + 1
    requests = df.select(F.col("id").alias("req_id"), F.col("text").alias("biblio"), F.col("id").alias("own"))
    plain = search.match_biblio(requests, index, pruned=pruned).collect()
    assert {(r.req_id, r.id) for r in plain} == {w[:2] for w in bm25_by_hand(docs, docs, 4)}
    others = search.match_biblio_conditional(requests, index, exclude="own", pruned=pruned).collect()
    assert {(r.req_id, r.id) for r in others} == best_others(docs, 4)


def test_index_keeps_enough_copies(spark):
    df = spark.createDataFrame([(1, "a1"), (2, "a1")], "id long, text string")
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")}, keep=2)
    requests = df.select(F.col("id").alias("req_id"), F.col("text").alias("biblio"))
    assert search.match_biblio(requests, index, k=2).count() == 4
    with pytest.raises(ValueError):
        search.match_biblio(requests, index, k=3)


def test_journal_match_in_a_hot_issue(spark):
    """One volume and page holds most records; few share the journal."""
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["Marine Notes", "Physics Letters", "Notes on Rivers", "Unrelated"]), "Mar",
         "7" if i % 5 else "8", "P1", rng.choice(["Smith", "Kim", "Roe"]))
        for i in range(80)
    ]
    schema = "id long, j string, abbreviated_journal string, volume string, first_page string, first_author string"
    records = spark.createDataFrame(rows, schema).withColumn("journal", F.array("j"))
    names = ("journal", "abbreviated_journal", "volume", "first_page", "first_author")
    index = search.build_index(
        records, {f: (f, search.FIELD_ANALYZERS[f]) for f in names}, carry=("volume", "first_page")
    )
    requests = spark.createDataFrame(
        [("a", "Physics Letters", "7", "p1", "kim"), ("b", "Nothing shared", "8", "p1", None), ("c", "mar", "7", "p1", "Zed")],
        "req_id string, jtitle string, volume string, first_page string, first_author string",
    )
    got = search.match_journal(requests, index).collect()

    def share(value, token, field):
        tokens = {r[0]: value(r) for r in rows}
        df = sum(token in t for t in tokens.values())
        mean = sum(map(len, tokens.values())) / len(tokens)
        idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
        return {
            i: idf * t.count(token) / (t.count(token) + 1.2 * (0.25 + 0.75 * len(t) / mean))
            for i, t in tokens.items() if token in t
        }

    journal = lambda r: [w for w in r[1].lower().split() if w != "on"]
    exact = lambda n: lambda r: [r[n].lower()]
    for req in requests.collect():
        inside = {r[0] for r in rows if r[3] == req.volume}
        scores = dict.fromkeys(inside, 0.0)
        wanted = [(journal, w) for w in req.jtitle.lower().split()] + [
            (exact(2), req.jtitle.lower()), (exact(3), req.volume), (exact(4), req.first_page)
        ]
        if req.first_author:
            wanted.append((exact(5), req.first_author.lower()))
        for value, token in wanted:
            for i, s in share(value, token, None).items():
                if i in inside:
                    scores[i] += s
        best = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:4]
        assert [r.id for r in sorted(got, key=lambda r: r.blocking_rank) if r.req_id == req.req_id] == best


def skewed_records(spark, n=4_000):
    """Texts of frequent words, and of some rare ones that make up a topic."""
    import random

    pick, rows = random.Random(7), []
    for i in range(n):
        words = [f"common{min(int(pick.expovariate(0.3)), 20)}" for _ in range(pick.randint(5, 60))]
        rows.append((f"d{i:05d}", " ".join([*words, *(f"topic{i % 500}x{k}" for k in range(4))])))
    return spark.createDataFrame(rows, "id string, text string"), rows


def test_blocks_are_left_out_and_nothing_else_changes(spark):
    from biblioweave.operators import blocks

    df, rows = skewed_records(spark)
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")})
    requests = spark.createDataFrame([(i, rows[i * 37][1]) for i in range(40)], "req_id int, biblio string")
    best = [sorted(map(tuple, search.match_biblio(requests, index, pruned=p).collect())) for p in (True, False)]
    assert best[0] == best[1]
    terms = search.weighted_terms(search.request_tokens(requests, search.BIBLIO_FIELD), index).cache()
    kept = blocks.surviving_slices(terms, index.blocks, index.spans, 4)
    every = terms.join(index.blocks, ["field", "token"]).count()
    assert blocks.open_blocks(kept, terms, index.blocks).count() < every / 5


def test_blocks_respect_conditions_and_rare_requests(spark):
    df, rows = skewed_records(spark, 600)
    df = df.withColumn("has_doi", search.F.substring("id", 6, 1).isin("0", "2"))
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")}, carry=("has_doi",))
    asked = [(0, rows[3][1]), (1, "common1"), (2, "never seen"), (3, "topic7x1"), (4, " ")]
    requests = spark.createDataFrame(asked, "req_id int, biblio string")
    both = [sorted(map(tuple, search.match_biblio_conditional(requests, index, pruned=p).collect())) for p in (True, False)]
    assert both[0] == both[1] and {r[0] for r in both[0]} >= {0, 1}


def test_blocks_hold_every_posting_once(spark):
    from biblioweave.operators import blocks

    df, _ = skewed_records(spark, 300)
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")})
    opened = index.blocks.select("field", "token", "best", search.F.explode("postings").alias("p"))
    assert opened.count() == index.postings.count() == opened.select("token", "p.id").distinct().count()
    assert opened.where("p.share > best").isEmpty()
    sizes = index.blocks.agg(search.F.max(search.F.size("postings"))).first()[0]
    assert sizes <= blocks.SLICE


def test_numbers_are_dense_and_in_order(spark):
    from biblioweave.operators.keys import numbered

    df = spark.range(0, 3_000, 3).selectExpr("id", "id % 7 AS length").repartition(6)
    found = sorted((r.number, r.length, r.id) for r in numbered(df, "length", "id").collect())
    assert [n for n, _, _ in found] == list(range(1_000))
    assert [x[1:] for x in found] == sorted((i % 7, i) for i in range(0, 3_000, 3))
