"""An index kept current by batches against one built anew."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from biblioweave.operators import search
from biblioweave.streaming import index as log

FIELDS = {"bibliographic": ("text", "words_stop")}


def top(requests, index):
    return sorted(map(tuple, search.match_biblio(requests, index).collect()))


def rebuilt(spark, records):
    df = spark.createDataFrame(sorted(records.items()), "id string, text string")
    return search.build_index(df, FIELDS, collapse=False)


def text(pick):
    return " ".join(f"w{min(int(pick.expovariate(0.1)), 40)}" for _ in range(pick.randint(1, 12)))


def test_twenty_batches_equal_a_rebuilt_index(spark, tmp_path):
    pick, records, root = random.Random(4), {}, str(tmp_path / "log")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    for batch in range(20):
        given = {f"d{pick.randrange(60)}": text(pick) for _ in range(8)}
        out = [d for d in pick.sample(sorted(records), min(3, len(records)))]
        apply = lambda: log.apply_changes(
            spark.createDataFrame(sorted(given.items()), "id string, text string"), batch, root, FIELDS,
            deleted=spark.createDataFrame([(d,) for d in [*out, "unknown"]], "id string"),
        )
        apply()
        if batch == 11:
            apply()  # replayed
        for d in out:
            records.pop(d)
        records |= given
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    requests = spark.createDataFrame([(i, text(pick)) for i in range(15)], "req_id int, biblio string")
    wanted = rebuilt(spark, records)
    current = log.current_index(spark, root)
    assert top(requests, current) == top(requests, wanted)
    stats = lambda i: sorted((r.token, r.df, round(r.idf, 9)) for r in i.token_stats.collect())
    assert stats(current) == stats(wanted)
    assert len(log.batches(spark, root)) == 20

    # a batch without its last table is not seen
    shutil.rmtree(tmp_path / "log" / "sizes" / "batch=19")
    assert log.batches(spark, root)[-1] == 18

    log.compact_index(spark, root, str(tmp_path / "compacted"))
    assert top(requests, log.current_index(spark, str(tmp_path / "compacted"))) == top(requests, log.current_index(spark, root))


def test_an_empty_log_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        log.current_index(spark, str(tmp_path))


def test_everything_can_be_deleted(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", "y")], "id string, text string")
    log.apply_changes(df, 0, str(tmp_path / "log"), FIELDS)
    log.apply_changes(df.limit(0), 1, str(tmp_path / "log"), FIELDS, deleted=df.select("id"))
    requests = spark.createDataFrame([(1, "x y")], "req_id int, biblio string")
    assert top(requests, log.current_index(spark, str(tmp_path / "log"))) == []
    assert log.current_index(spark, str(tmp_path / "log")).token_stats.where(F.col("df") > 0).count() == 0


def test_postings_of_a_record_are_one_row_and_matched_in_cells(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("tokens were joined with postings")

    monkeypatch.setattr(search, "bm25", refuse)
    root = str(tmp_path / "log")
    df = spark.createDataFrame([("a", "x y z x"), ("b", "y"), ("c", " ")], "id string, text string")
    log.apply_changes(df, 0, root, FIELDS)
    log.apply_changes(df.where("id = 'b'").withColumn("text", F.lit("z q")), 1, root, FIELDS)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/postings").collect()) == ["a", "b", "b"]
    requests = spark.createDataFrame([(1, "y"), (2, "q")], "req_id int, biblio string")
    assert [r[:2] for r in top(requests, log.current_index(spark, root))] == [(1, "a"), (2, "b")]
