from biblioweave.catalog import Tables, landed


def test_records_of_one_file_are_parsed_by_all_tasks(spark):
    rows = landed.parse_hal_tei(Tables(spark, "/root/testdata/sf0.001"))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
