"""Values that many expressions use are made once."""

from pyspark.sql import functions as F

from biblioweave.functions.dates import partial_date
from biblioweave.functions.people import dedupe_authors


def uses(df, call: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(call)


def test_a_date_reads_its_month_once(spark):
    rows = spark.createDataFrame([("2020", "Feb", "30"), ("2020", None, "3"), ("x", "Feb", "1")], "y string, m string, d string")
    dates = rows.select("y", partial_date(F.col("y"), F.col("m"), F.col("d")).alias("date"))
    assert uses(dates, "array_position") <= 2  # compared and taken
    assert [r.date and tuple(r.date) for r in dates.collect()] == [(2020, 2, 28), (2020, None, None), None]


def test_authors_are_made_once_for_all_comparisons(spark):
    person = "array<struct<first_name:string,middle_name:string,last_name:string,initials:string>>"
    rows = [([("A", None, last, None) for last in names],) for names in (["x", "y", "X", "y", "z"], ["x"], [])] + [(None,)]
    people = F.transform("p", lambda p: p.withField("last_name", F.upper(p["last_name"])))
    found = spark.createDataFrame(rows, f"p {person}").select(dedupe_authors(people).alias("p"))
    assert uses(found, "upper(") == 1
    assert [r.p and [x.last_name for x in r.p] for r in found.collect()] == [["X", "Y", "Z"], ["X"], [], None]
