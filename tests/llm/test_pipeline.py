"""The pipeline: its stages on planted documents, on odd rows, and as a whole."""

import corpus_pipeline
from sieveworks.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, data), name)
        kept[name] = docs.count()
        if name != "packing":
            assert docs.schema.names == before.schema.names
        if name in ("toxicity", "language", "near_dedup"):
            assert docs.join(before, docs.columns, "left_anti").count() == 0
    assert 0.8 * n < kept["toxicity"] < n and kept["language"] >= 0.97 * kept["toxicity"]
    assert 0.5 * kept["language"] < kept["near_dedup"] < kept["language"]
    whole = corpus_pipeline.run(spark, data)
    assert whole.count() == kept["packing"] and whole.columns == docs.columns


def test_near_duplicate_stage_keeps_one_of_each_group(spark, data):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "changed")
    rows = [(7, base, "en", "a", 1), (3, near, "en", "a", 1), (9, "quite another text of some words", "en", "a", 1), (3, near, "en", "a", 1), (None, base, None, None, None), (None, "own words here", None, None, None), (5, None, None, None, None), (6, "", None, None, None)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), data).collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(9) == ids.count(5) == ids.count(6) == 1
    assert len([r for r in out if (r["text"] or "").startswith("w0 ")]) == 1
    assert [r["text"] for r in out if r["text"] == "own words here"] == ["own words here"]


def test_near_duplicate_stage_keeps_different_texts_of_one_id(spark, data):
    rows = [(3, "one text of its own", None, None, 0), (3, "quite another text", None, None, 0), (None, None, None, None, 0), (None, None, None, None, 0), (4, "ONE text of its own", None, None, 0), (4, "ONE text of its own", None, None, 0)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), data).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(3, "one text of its own"), (3, "quite another text"), (None, None), (None, None)], key=str)


def test_odd_rows_and_empty_tables(spark, data):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, "der die das und", "de", "b", 1), (2, "der die das und", "de", "b", 1)], DOCS).withColumnRenamed("n_chars", "score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, data).count() <= 8, name
        assert stage(spark, odd.limit(0), data).count() == 0, name
