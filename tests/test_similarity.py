"""Bounds that spare comparisons, and what they must not change."""

import random

from pyspark.sql import functions as F

from biblioweave.functions import similarity
from biblioweave.operators import lookup, tables


def pairs(n=400):
    pick, words = random.Random(5), ["graph", "theory", "of", "cells", "the", "Neural", "été", "networks", "11", "a"]
    rows = [(None, "x"), ("", "x"), ("Same", "same"), ("x", None), (" ", " "), ("ab", "ba")]
    for _ in range(n):
        one = " ".join(pick.choices(words, k=pick.randint(1, 9)))
        other = list(one) if pick.random() < 0.4 else list(" ".join(pick.choices(words, k=pick.randint(1, 9))))
        for _ in range(pick.randint(0, 5)):
            other[pick.randrange(len(other))] = pick.choice("qwertyuiop")
        rows.append((one, "".join(other)))
    return rows


def test_bounds_hold_and_decide_the_same(spark):
    df = spark.createDataFrame(pairs(), "a string, b string")
    a, b = F.col("a"), F.col("b")
    x, y = F.lower(a), F.lower(b)
    rows = df.select(
        F.coalesce(similarity.ratcliff_obershelp(a, b), F.lit(0.0)).alias("s"),
        similarity.shared_upper_bound(x, y).alias("bound"),
        similarity.ratio_upper_bound(x, y).alias("by_length"),
        *[similarity.reaches(a, b, t).alias(f"r{int(t * 10)}") for t in (0.3, 0.7, 1.0)],
    ).collect()
    for r in rows:
        if r.s and r.bound is not None:
            assert r.s <= r.bound + 1e-12 <= r.by_length + 2e-12
        assert [r.r3, r.r7, r.r10] == [r.s >= t for t in (0.3, 0.7, 1.0)]


def test_less_than_a_third_of_unlike_titles_is_compared(spark):
    pick = random.Random(6)
    words = "graph theory cells neural networks protein binding quantum market trees river policy health laser".split()
    titles = [" ".join(pick.sample(words, pick.randint(2, 8))) for _ in range(60)]
    df = spark.createDataFrame([(x, y) for x in titles for y in titles], "a string, b string")
    share = df.agg(F.avg(similarity.undecided(F.col("a"), F.col("b"), 0.7).cast("int"))).first()[0]
    assert 0 < share < 1 / 3


def test_validation_is_unchanged(spark):
    rows = [(i, "found", x, y, y, x) for i, (x, y) in enumerate(pairs(100))]
    df = spark.createDataFrame(rows, "req_id int, status string, atitle string, record_title string, first_author string, record_author string")
    df = df.withColumn("reason", F.lit(None).cast("string"))
    s = lambda a, b: F.coalesce(similarity.ratcliff_obershelp(F.col(a), F.col(b)), F.lit(0.0)) >= 0.7
    given = {c: F.coalesce(F.trim(c) != "", F.lit(False)) for c in ("atitle", "first_author")}
    wanted = (~given["atitle"] | s("atitle", "record_title")) & (~given["first_author"] | s("first_author", "record_author"))
    for row in lookup.post_validate(df).withColumn("wanted", wanted).collect():
        assert (row.status == "found") == row.wanted, row


def test_last_written_repository_id_of_a_doi(spark):
    from biblioweave.schemas import BIBLIO

    rows = [("hal-9", "10.1/A", 1), ("hal-1", "10.1/a", 2), ("hal-5", "10.1/b", 3), (None, "10.1/b", 4)]
    given = spark.createDataFrame(rows, "hal_id string, doi string, seq long")
    others = [F.lit(None).cast(kind).alias(c) for c, kind in BIBLIO.items() if c not in ("hal_id", "doi")]
    _, by_doi = tables.build_hal_works(given.select("*", *others))
    assert {tuple(r) for r in by_doi.collect()} == {("10.1/a", "hal-1"), ("10.1/b", "hal-5")}


def test_common_reference_lists_are_filled_for_each_record(spark):
    from biblioweave.schemas import REFERENCE

    common = [("c", "1", None, None, None), ("d", None, "10.1/x", None, None)]
    rows = [(i, common) for i in range(50)] + [(50, []), (51, None)]
    df = spark.createDataFrame(rows, f"n int, references array<{REFERENCE}>").repartition(5)
    ids = spark.createDataFrame([("1", "PMC1", "10.1/one", None, None), ("2", None, "10.1/x", None, None)],
                                "pmid string, pmcid string, doi string, license string, subpath string")
    found = {r.n: r.references for r in tables.fill_reference_ids(df, tables.build_pmid_maps(ids)).collect()}
    assert len(found) == 52 and found[50] == [] and found[51] is None
    assert all([(r.pmid, r.doi, r.pmc) for r in found[i]] == [("1", "10.1/one", "PMC1"), ("2", "10.1/x", None)] for i in range(50))
