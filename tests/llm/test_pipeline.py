"""The pipeline on a small corpus, each stage against its operator's rules."""

import corpus_pipeline as pipeline
from graphlens.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before.selectExpr("*", "1 as kept", "'x' as removed"), SF)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        rows = after.collect()
        if name in ("quality", "near_dedup"):
            old = {r.doc_id: r.text for r in before.collect()}
            assert 0 < len(rows) < len(old) and all(old[r.doc_id] == r.text for r in rows)
        if name == "line_dedup":
            old = {r.doc_id: r.text.split("\n") for r in before.collect()}
            assert all(set(r.text.split("\n")) <= set(old[r.doc_id]) for r in rows)
            long = [x.strip() for r in rows for x in r.text.split("\n") if len(x.strip()) >= 20]
            assert len(long) == len(set(long)) and any(r.text.split("\n") != old[r.doc_id] for r in rows)
        before = spark.createDataFrame(rows, docs.schema)


def test_run_packs_what_the_stages_leave(spark):
    made = pipeline.run(spark, SF)
    assert made.count() and made.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 1024
    kept = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} <= kept


def test_lines_are_taken_out_in_one_pass(spark, monkeypatch):
    text = "a line to keep\na line to drop"
    rows = [(1, text, "en", "a", len(text)), (2, "a line to drop", "en", "a", 14), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    taken = docs.where("doc_id < 3").selectExpr("doc_id as id", "xxhash64(text) as version", "array(2 - cast(doc_id as int), 9) as removed")
    monkeypatch.setattr(line_dedup, "repeats", lambda *_: taken)
    made = pipeline.lines(spark, docs, SF)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.text, r.n_chars) for r in made.collect()) == [(1, "a line to keep", 14), (3, None, 0), (4, "", 0)]


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
