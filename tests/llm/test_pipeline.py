"""The registered queries and the pipeline on the smallest tables."""

import pytest

import corpus_pipeline
from biblioweave.llm import neardup, privacy, queries, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if not n.startswith(("op12_", "op13_"))))
def test_query_covers_its_table(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    key = "page_id" if name.startswith("op3_") else "doc_id"
    whole = spark.read.parquet(f"{FOLDER}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert {r[key] for r in rows} == {r[key] for r in whole.select(key).collect()}
    if not name.startswith("op2_"):
        assert len(rows) == whole.count()


def test_audit_and_phrases_cover_all_languages(spark):
    langs = {r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang").distinct().collect()}
    audit = queries.QUERIES["op12_filter_audit"](spark, FOLDER).collect()
    assert {r.part for r in audit} == {lang or "" for lang in langs} and len(audit) == 600 * len(langs)
    assert {r.lang for r in queries.QUERIES["op13_phrases"](spark, FOLDER).collect()} <= {lang or "und" for lang in langs}


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        kept.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
    assert all(later <= earlier for (_, earlier), (_, later) in zip(kept, kept[1:]))
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = {r.doc_id for r in quality.quality_rules(whole).where("kept").collect()}
    assert kept[0][1] == rules == kept[1][1]
    assert not any(r["_base"] for r in privacy.with_base_spans(docs).collect())
    classes = neardup.near_duplicates(whole.where(whole.doc_id.isin(list(kept[2][1])))).collect()
    assert len({r.label for r in classes}) == len(classes)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == kept[-1][1]
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(total.values()) == sum(p.length for p in pieces)


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
