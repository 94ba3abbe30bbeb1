"""Update streams: order, replay, compaction, marks."""

import gzip
import json

from pyspark.sql import functions as F

from biblioweave.streaming import updates as U


def land(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as out:
        out.write("\n".join(json.dumps(r) for r in rows))


def work(doi, volume, when, **more):
    return {"DOI": doi, "volume": volume, "title": [f"{doi} {volume}"], "indexed": {"date-time": when}, **more}


def run(spark, tmp_path, **options):
    U.stream_work_updates(
        spark, str(tmp_path / "landing"), str(tmp_path / "t"), str(tmp_path / "cp"), **options
    ).awaitTermination()


def volumes(spark, tmp_path, **options):
    rows = U.current_rows(spark, str(tmp_path / "t" / "works"), key="doi", **options)
    return {r.doi: r.volume for r in rows.collect()}


def test_updates_out_of_order_and_replayed(spark, tmp_path):
    day = tmp_path / "landing" / "2024-01-02"
    land(day, "D1.json.gz", work("10.1/A", "2", "2024-01-02T00:00:00Z"), work("10.1/b", "1", "2024-01-01T00:00:00Z"))
    land(day, "X1.json.gz", work("10.1/ignored", "1", "2024-01-01T00:00:00Z"))
    run(spark, tmp_path)
    assert volumes(spark, tmp_path) == {"10.1/a": "2", "10.1/b": "1"}

    # an older copy arrives late: the record's own date decides, or arrival on request
    land(day, "G2.json.gz", work("10.1/a", "1", "2024-01-01T00:00:00Z"), {"DOI": "10.1/c", "type": "component"})
    run(spark, tmp_path)
    assert volumes(spark, tmp_path) == {"10.1/a": "2", "10.1/b": "1"}
    assert volumes(spark, tmp_path, by_arrival=True) == {"10.1/a": "1", "10.1/b": "1"}

    # the same batch applied once more changes nothing
    lines = spark.read.text(str(day / "G2.json.gz"))
    before = U.run_metrics(spark, str(tmp_path / "t")).collect()
    U.apply_batch(lines, 1, str(tmp_path / "t"))
    assert volumes(spark, tmp_path) == {"10.1/a": "2", "10.1/b": "1"}
    assert U.run_metrics(spark, str(tmp_path / "t")).collect() == before
    assert tuple(before[0]) == (4, 3, 1, 3, 0)

    # compaction keeps the rows, later batches still apply
    U.compact(spark, str(tmp_path / "t" / "works"), key="doi")
    assert volumes(spark, tmp_path) == {"10.1/a": "2", "10.1/b": "1"}
    land(day, "D3.json.gz", work("10.1/b", "9", "2024-01-05T00:00:00Z"))
    run(spark, tmp_path)
    assert volumes(spark, tmp_path) == {"10.1/a": "2", "10.1/b": "9"}
    search = U.current_rows(spark, str(tmp_path / "t" / "search"), key="id").collect()
    assert {r.id: r.bibliographic for r in search} == {
        "crossref:10.1/a": "10.1/A 2 2", "crossref:10.1/b": "10.1/b 9 9",
    }
    assert U.last_mark(spark, str(tmp_path / "t")).collect()[0][0].day == 5


def test_applied_files_can_be_deleted(spark, tmp_path):
    landing = tmp_path / "landing"
    for n in range(3):
        land(landing, f"D{n}.json.gz", work(f"10.1/{n}", "1", "2024-01-01T00:00:00Z"))
        run(spark, tmp_path, clean=True, files_per_batch=1)
    assert len(volumes(spark, tmp_path)) == 3
    # files of completed batches go when the next batch starts
    assert len(list(landing.glob("D*.gz"))) < 3


def test_windows_and_marks(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 00:00:00"), ("c", "2024-01-03 05:00:00"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("indexed_ts", F.col("t").cast("timestamp"))
    mark = df.filter("id = 'b'").agg(F.max("indexed_ts").alias("last_indexed"))
    assert {r.id for r in U.updates_since(df, mark).collect()} == {"b", "c"}
    empty = df.filter("id = 'zzz'").agg(F.max("indexed_ts").alias("last_indexed"))
    assert {r.id for r in U.updates_since(df, empty).collect()} == {"a", "b", "c"}
    assert {r.id for r in U.updates_since_yesterday(df, today="2024-01-03").collect()} == {"b", "c"}

    path = str(tmp_path / "marks")
    U.persist_high_water_mark(mark, path, run_finished=False)
    U.persist_high_water_mark(df.filter("id = 'a'").agg(F.max("indexed_ts").alias("last_indexed")), path, run_finished=False)
    assert U.read_high_water_mark(spark, path).collect()[0][0].day == 2
    U.persist_high_water_mark(mark, path, run_finished=True)
    assert U.read_high_water_mark(spark, path).collect()[0][0].year > 2024


def test_many_batches_leave_few_folders(spark, tmp_path):
    day = tmp_path / "landing"
    for i in range(9):
        land(day, f"D{i}.json.gz", work(f"10.1/x{i % 4}", str(i), f"2024-01-{i + 1:02d}T00:00:00Z"))
    run(spark, tmp_path, files_per_batch=1, compact_every=2)
    table = tmp_path / "t" / "works"
    assert len(list((table / "changes").glob("batch=*"))) <= 4
    assert len(list((table / "base").glob("upto=*"))) <= 2
    assert volumes(spark, tmp_path) == {"10.1/x0": "8", "10.1/x1": "5", "10.1/x2": "6", "10.1/x3": "7"}
