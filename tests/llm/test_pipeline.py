"""The pipeline's stages: columns stay, decisions take effect, the last stage packs what is left."""

import corpus_pipeline
from ledgerlake.llm import quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        ids = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert ids == sorted(r.doc_id for r in quality.op5_quality(before).where("kept").collect())
        if name == "toxicity":
            assert ids == sorted(r.doc_id for r in toxicity.op6_toxicity(before, labels).where("predicted = 0").collect())
        if name == "near_duplicates":
            found = simhash.op2_simhash(before).select("component_id").distinct().collect()
            assert ids == sorted(r.component_id for r in found)
        if name == "secret_scans":
            assert docs.count() == before.count()
            assert not docs.where("text LIKE '%AKIA%' OR text RLIKE '[0-9a-f]{24,}'").count()
            assert not docs.where("text LIKE '%[hex]%' AND n_chars <> length(text)").count()
    assert ids == sorted(r.doc_id for r in before.collect())
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls everywhere, repeated rows, a map column, and columns named like those the stages make."""
    prose = " ".join(f"word{n}" for n in range(90)) + "."
    names = ["_q_text", "_q_words", "_kept", "_kept_id", "_row", "_score", "_d0", "text_node", "component_id", "print", "digest"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, notes map<string,string>, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(n, t, None, "src", None, {"a": "b"}, *names) for n, t in enumerate([prose, prose, prose + "Then all was still.", None, "", "x"])]
    rows += [rows[0], (None, prose, None, None, None, None, *names), (None, None, None, None, None, None, *names)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, SF), "test-odd")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            assert docs.count() == simhash.op2_simhash(before).select("component_id").distinct().count()
    assert docs.count()
