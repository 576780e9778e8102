import corpus_pipeline
from driftfield.llm import secrets

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        if name != "bpe":
            assert out.columns == DOCUMENTS
        if name == "secrets":
            assert out.count() == seen[-1] and all(not secrets.spans_of(r["text"]) and r["n_chars"] == len(r["text"]) for r in out.collect())
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    assert docs.where("NOT whole").count() == 0 and {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


def test_empty_documents(spark, tmp_path):
    for t, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
