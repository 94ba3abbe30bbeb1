from biblioweave.operators import lookup


def _names(plan):
    return {plan.output().apply(i).name() for i in range(plan.output().size())}


def test_the_second_join_of_a_mapped_lookup_moves_only_what_it_needs(spark):
    asked = spark.createDataFrame([("a", "PMC1"), ("b", "2"), ("c", "3"), ("d", None)], "req_id string, pmc string")
    by_pmc = spark.createDataFrame([("PMC1", "10.1/A"), ("PMC2", "10.1/b")], "pmcid string, doi string")
    works = spark.createDataFrame([("10.1/a", "{}")], "doi string, json string")
    found = lookup.lookup_by_pmc(asked, by_pmc, works)
    assert found.columns == ["req_id", "pmc", "mapped_doi", "record_doi", "json", "status", "reason"]
    rows = found.select("req_id", "record_doi", "json", "status", "reason")
    no_map = "Cannot find bibliographical record with PMC ID 3"
    want = [("a", "10.1/a", "{}", "found", None), ("b", None, None, "not_found", lookup.NO_RECORD), ("c", None, None, "not_found", no_map)]
    assert sorted(map(tuple, rows.collect()), key=str)[:3] == want
    assert rows.where("req_id = 'd'").first().reason is None
    plan = rows._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    sides = [_names(plan.children().apply(i)) for i in (0, 1)]
    assert not {"pmc", "mapped_doi"} & sides[0]
    assert len(sides[1]) == 2  # the key once, and the record
