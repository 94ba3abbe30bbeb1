import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biblioweave.operators import cells, search


@pytest.fixture
def many_cells(monkeypatch):
    monkeypatch.setattr(cells, "GROUP_POSTINGS", 600)
    monkeypatch.setattr(cells, "LEAST_POSTINGS", 100)


def titles(spark, n=400):
    pick = random.Random(3)
    words = [f"w{int(pick.expovariate(0.08))}" for _ in range(4_000)]
    rows = [
        (f"é{i}", " ".join(pick.choices(words, k=pick.randint(1, 9))), pick.choice(["Kim", "w1", "Roe"]), i % 3 == 0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id string, title string, first_author string, has_doi boolean")


def test_groups_keep_what_is_shuffled_small():
    assert cells.groups(10, 10, 8) == (1, 1)
    q, r = cells.groups(6_000, 150_000_000, 8)
    assert q == 1 and r == 50  # the records go out once
    q, r = cells.groups(60_000_000, 60_000_000, 8)
    assert q == r == 10


def test_cells_give_the_plain_join_and_write_no_blocks(spark, many_cells, monkeypatch):
    def refuse(*_):
        raise AssertionError("blocks were built")

    monkeypatch.setattr(search, "build_blocks", refuse)
    records = titles(spark)
    fields = {f: (f, search.FIELD_ANALYZERS[f]) for f in ("title", "first_author")}
    index = search.build_index(records, fields, carry=("has_doi",), collapse=False)
    requests = records.select(F.col("id").alias("req_id"), F.col("title").alias("atitle"), "first_author", F.col("id").alias("own"))
    for where, exclude in ((None, None), (F.col("has_doi"), None), (None, "own")):
        ask = index if where is None else index.where(where)
        both = [
            sorted(map(tuple, search.match_title_author(requests, ask, pruned=p, exclude=exclude).collect()))
            for p in (True, False)
        ]
        assert both[0] == both[1] and len(both[0]) > 1_000


def test_ties_in_a_cell_go_by_id(spark, many_cells):
    rows = [(i, "same words" if i % 2 else "words same") for i in range(900)] + [(1_000, "other")]
    df = spark.createDataFrame(rows, "id long, text string")
    index = search.build_index(df, {"bibliographic": ("text", "words_stop")}, collapse=False)
    requests = spark.createDataFrame([(1, "same words"), (2, "unknown"), (3, "other same")], "req_id long, biblio string")
    got = {(r.req_id, r.id) for r in search.match_biblio(requests, index).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (1, 3), (3, 1_000), (3, 0), (3, 1), (3, 2)}


def test_few_records_of_a_cell_are_scored_in_full(monkeypatch):
    pick = np.random.default_rng(5)
    texts = [np.unique(np.append(pick.zipf(1.3, 40) % 3_000, 5_000 + i // 6)) for i in range(1_500)]
    words = pa.array([[f"0{w}" for w in t] for t in texts])
    table = pa.table({
        "id": pa.array(range(1_500)), "norm": np.full(1_500, 1.2), "tokens": words, "tfs": pa.array([[1] * len(t) for t in texts]),
    })
    vocabulary = pa.array(sorted({w for t in words.to_pylist() for w in t}))
    held = cells.Records(pa.table({c: pa.chunked_array([table[c].combine_chunks()]) for c in table.column_names}), vocabulary)
    idf = np.log1p((1_500 - np.diff(held.start) + 0.5) / (np.diff(held.start) + 0.5))
    scored, whole = [], held._scores
    monkeypatch.setattr(held, "_scores", lambda chosen, *rest: scored.append(len(chosen)) or whole(chosen, *rest))
    place = {w: k for k, w in enumerate(vocabulary.to_pylist())}
    for ask in range(0, 1_500, 50):
        codes = np.array([place[w] for w in words[ask].as_py()])
        chosen, scores = held.best(codes, idf[codes], 4)
        every = np.zeros(1_500)
        for c in codes:
            every[held.at[held.start[c] : held.start[c + 1]]] += idf[c] / 2.2
        want = sorted(range(1_500), key=lambda i: (-round(every[i], 6), i))[:4]
        got = sorted(zip(chosen.tolist(), scores), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        assert [g[0] for g in got] == want
        assert np.allclose([g[1] for g in got], every[want])
    assert np.mean(scored) < 100


def test_all_scores_in_cells_are_those_of_the_plain_join(spark, many_cells, monkeypatch):
    monkeypatch.setattr(cells, "CELL_PAIRS", 500)
    records = titles(spark)
    fields = {f: (f, search.FIELD_ANALYZERS[f]) for f in ("title", "first_author")}
    index = search.build_index(records, fields, collapse=False)
    requests = records.select(F.concat(F.lit("r"), "id").alias("req_id"), "title", "first_author").limit(60)
    terms = search.weighted_terms(search.request_tokens(requests, fields), index).localCheckpoint()
    scores = lambda df: sorted((r.req_id, r.id, round(r.score, 9)) for r in df.collect())
    found = scores(search.all_scores(terms, index, sorted(fields)))
    assert found == scores(search.bm25(terms, index)) and len(found) > 1_000
    assert cells.smaller(1, 1, 100, 10_000, 50, 400) == (1, 64)


def test_the_query_of_all_scores_moves_no_pairs(spark, monkeypatch):
    from biblioweave.catalog import Tables, matching

    def refuse(*_):
        raise AssertionError("tokens were joined with postings")

    monkeypatch.setattr(search, "bm25", refuse)
    assert matching.bm25(Tables(spark, "/root/testdata/sf0.001")).count() > 0


def test_each_group_is_written_once_however_many_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_POSTINGS", 600)
    monkeypatch.setattr(cells, "CELLS_PER_CORE", 1)
    dealt, deal = {}, cells._grouped
    monkeypatch.setattr(cells, "_grouped", lambda *x: dealt.setdefault(x[-1], deal(*x)))
    records = titles(spark)
    index = search.build_index(records, {"title": ("title", "words_stop")}, collapse=False)
    requests = records.select(F.col("id").alias("req_id"), "title")
    terms = search.weighted_terms(search.request_tokens(requests, {"title": ("title", "words_stop")}), index).localCheckpoint()
    scores = cells.cell_scores(terms, index.held(), search._norm(), ["title"], 4)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "CoGroup" not in plan
    for name, size in (("asked", terms.count()), ("held", index.postings.count())):
        parts = dealt[name].rdd.glom().map(len).collect()
        groups = [cells._opened(pa.scalar(bytes(x[0]), pa.binary())) for x in dealt[name].collect()]
        assert 2 <= len(groups) <= 5 and parts == [1] * len(groups)
        assert sum(len(x["tokens"].combine_chunks().flatten()) for x in groups) == size


def many_texts(n, words, seed=7):
    """Texts with frequent words, some rare ones, and a few near copies."""
    pick = np.random.default_rng(seed)
    texts = [np.unique(np.concatenate((pick.zipf(1.25, words) % 4_000, [5_000 + i // 3]))) for i in range(n)]
    vocabulary = sorted({f"0{w}" for t in texts for w in t})
    place = {w: k for k, w in enumerate(vocabulary)}
    table = pa.table({
        "id": pa.array(range(n)), "norm": 1.2 + pick.integers(0, 4, n) / 10,
        "tokens": pa.array([[f"0{w}" for w in t] for t in texts]), "tfs": pa.array([pick.integers(1, 4, len(t)).tolist() for t in texts]),
    })
    codes = [np.array([place[f"0{w}"] for w in t]) for t in texts]
    df = np.bincount(np.concatenate(codes), minlength=len(vocabulary))
    return table, pa.array(vocabulary), codes, np.log1p((n - df + 0.5) / (df + 0.5))


@pytest.mark.parametrize(("n", "words", "usual"), [(900, 60, True), (900, 60, False), (3_000, 6, True), (70, 30, True), (3, 9, True)])
def test_the_best_of_many_requests_are_those_of_all_scores(n, words, usual):
    table, vocabulary, codes, idf = many_texts(n, words)
    held = cells.Records(table, vocabulary, idf if usual else None)
    plain = cells.Records(table, vocabulary)
    pick = np.random.default_rng(1)
    requests = [(c, idf[c] * (1 if k % 5 else 2)) for k, c in enumerate(codes[: 150])]
    requests += [(c[pick.random(len(c)) < 0.4], idf[c[:0]]) for c in codes[:20]]
    requests = [(c, w if len(w) == len(c) else idf[c]) for c, w in requests] + [(codes[0][:0], idf[:0])]
    for (c, w), (chosen, scores) in zip(requests, held.best_of(requests, 4)):
        some, every = plain.every(c, w)
        want = sorted(zip(some.tolist(), every), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        got = sorted(zip(chosen.tolist(), scores), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1] for x in got], [x[1] for x in want])


def test_rows_of_one_record_and_field_add_up():
    table, vocabulary, codes, idf = many_texts(300, 20)
    twice = pa.concat_tables([table, table.slice(100, 100)])
    held, plain = cells.Records(twice, vocabulary, idf, 2), cells.Records(twice, vocabulary)
    for c, (chosen, scores) in zip(codes, held.best_of([(c, idf[c]) for c in codes], 3)):
        some, every = plain.every(c, idf[c])
        want = sorted(zip(some.tolist(), every), key=lambda x: (-round(x[1], 6), x[0]))[:3]
        assert sorted(zip(chosen.tolist(), scores), key=lambda x: (-round(x[1], 6), x[0]))[:3] == [(i, pytest.approx(s)) for i, s in want]


def test_rare_words_settle_a_request_without_a_look_at_all_records(monkeypatch):
    n = 6_000
    rows = [[f"0{i // 6}", f"0t{i // 2000}", "0com", "0en" if i % 2 else "0de"] for i in range(n)]
    table = pa.table({"id": pa.array(range(n)), "norm": np.full(n, 1.2), "tokens": pa.array(rows), "tfs": pa.array([[1] * 4] * n)})
    vocabulary = pa.array(sorted({w for r in rows for w in r}))
    place = {w: k for k, w in enumerate(vocabulary.to_pylist())}
    df = np.bincount([place[w] for r in rows for w in r])
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    held = cells.Records(table, vocabulary, idf)
    read, parts = [], held._parts
    monkeypatch.setattr(held, "_parts", lambda *x: (read.append(len((y := parts(*x))[0])), y)[1])
    monkeypatch.setattr(held, "_many", None)
    asked = [np.array([place[w] for w in rows[i]]) for i in range(0, n, 60)]
    for i, (chosen, _) in zip(range(0, n, 60), held.best_of([(c, idf[c]) for c in asked], 3)):
        assert sorted(chosen.tolist())[:3] == [i, i + 2, i + 4]
    assert sum(read) < 20 * len(asked)
