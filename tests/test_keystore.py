"""Bucketed key stores: what moves in a lookup, and what is read."""

import uuid

import pytest
from pyspark.sql import functions as F

from biblioweave.operators import keystore, lookup


@pytest.fixture(scope="module")
def works(spark, tmp_path_factory):
    rows = spark.range(5_000).select(
        F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("json")
    )
    name = f"works_{uuid.uuid4().hex}"
    yield keystore.write_store(rows, str(tmp_path_factory.mktemp("store") / "works"), key="doi", name=name, buckets=4)
    spark.sql(f"DROP TABLE {name}")


@pytest.fixture
def requests(spark):
    ids = spark.range(0, 6_000, 5).select(F.col("id").alias("req_id"), F.concat(F.lit("10.1/"), F.col("id").cast("string")).alias("doi"))
    return ids.union(spark.createDataFrame([(-1, None), (-2, " "), (-3, "10.1/5")], "req_id long, doi string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(plan, table):
    """Exchanges between the root and the scan of a table."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    depth, found = lines[at].index("FileScan"), 0
    for line in reversed(lines[:at]):
        start = next((i for i, c in enumerate(line) if c.isalpha()), 0)
        if start < depth:
            depth = start
            found += "Exchange" in line
    return found


def plainly(spark, store):
    return spark.createDataFrame(store.rows.collect(), store.rows.schema)


def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)


@pytest.fixture
def moved(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    no_broadcast(spark)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_is_not_moved(spark, works, requests, moved):
    found = lookup.lookup_by_doi(requests, works.rows)
    plan = plan_of(found)
    assert "Bucketed: true" in plan and exchanges_above(plan, works.name) == 0
    expected = lookup.lookup_by_doi(requests, plainly(spark, works))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_maps_and_records_stay_where_they_are(spark, works, tmp_path, moved):
    maps = spark.range(3_000).select(
        F.col("id").cast("string").alias("pmid"), F.concat(F.lit("PMC"), F.col("id").cast("string")).alias("pmcid"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("10.1/"), (F.col("id") * 2).cast("string"))).alias("doi"),
    )
    by_pmid = keystore.write_store(maps, str(tmp_path / "maps"), key="pmid", name=f"maps_{uuid.uuid4().hex}", buckets=4)
    asked = spark.range(0, 4_000, 3).select(F.col("id").alias("req_id"), F.col("id").cast("string").alias("pmid"))
    found = lookup.lookup_by_pmid(asked, by_pmid.rows, works.rows)
    plan = plan_of(found)
    # the map lies below the exchange of its result, which is dealt by DOI; the records do not move
    assert exchanges_above(plan, works.name) == 0 and exchanges_above(plan, by_pmid.name) == 1
    expected = lookup.lookup_by_pmid(asked, maps, plainly(spark, works))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    spark.sql(f"DROP TABLE {by_pmid.name}")


def test_few_keys_are_pushed_down(spark, works, requests):
    few = requests.where("req_id IN (5, 10, -1)")
    rows = works.rows_for(few, F.col("doi"))
    plan = plan_of(rows)
    assert "PushedFilters: [In(doi" in plan  # by which buckets and row groups are skipped
    assert {r.doi for r in rows.collect()} == {"10.1/5", "10.1/10"}
    assert works.rows_for(requests, F.col("doi")) is works.rows


def test_store_opened_by_path(spark, works, requests, moved):
    path = spark.sql(f"DESCRIBE EXTENDED {works.name}").where("col_name = 'Location'").first()["data_type"]
    name = f"again_{uuid.uuid4().hex}"
    again = keystore.open_store(spark, path, key="doi", name=name, buckets=4)
    assert sorted(again.rows.collect()) == sorted(works.rows.collect())
    assert exchanges_above(plan_of(lookup.lookup_by_doi(requests, again.rows)), name) == 0
    spark.sql(f"DROP TABLE {name}")


def test_changes_are_merged_without_moving_the_store(spark, works, tmp_path, moved):
    changes = spark.createDataFrame([("10.1/7", "new"), ("10.1/7", "newer"), ("10.9/x", "added"), (None, "lost")], "doi string, json string")
    name = f"merged_{uuid.uuid4().hex}"
    merged = keystore.merge_store(works, changes, str(tmp_path / "merged"), name=name, order_by=[F.col("json").desc()])
    found = {r.doi: r.json for r in merged.rows.collect()}
    expected = {r.doi: r.json for r in works.rows.collect()} | {"10.1/7": "newer", "10.9/x": "added"}
    assert found == expected
    spark.sql(f"DROP TABLE {name}")


def test_bitmap_keeps_all_requested_rows(spark, works, requests):
    kept = keystore.only_requested(works.rows, "doi", requests, F.col("doi"))
    wanted = {r.doi for r in requests.collect()}
    expected = {r.doi for r in works.rows.collect()} & wanted
    found = [r.doi for r in kept.collect()]
    assert kept.columns == works.rows.columns
    assert expected <= set(found) and len(found) == len(set(found)) < 1.2 * len(expected)
    nothing = requests.limit(0)
    assert keystore.only_requested(works.rows, "doi", nothing, F.col("doi")).count() == 0


def test_bucket_counts():
    assert [keystore.bucket_count(n) for n in (0, 1, 1_000_000, 1_000_001, 5_000_000)] == [1, 1, 1, 2, 8]
