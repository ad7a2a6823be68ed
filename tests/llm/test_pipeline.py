import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm import catalog, toxicity

from test_similar import slow_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, SF), "test")
        kept[name] = out
        if name != "sentencepiece":
            assert out.columns == columns
        if name == "toxicity":
            scores = toxicity.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert out.count() == scores.where("predicted = 0").count()
        if name == "simhash_near_dedup":
            # five words and a similarity of 0.8, as near-duplicate stages take, against all pairs
            want = slow_components(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(d for d, c in want if d == c)
        if name == "secret_scan":
            assert out.count() == docs.count()
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "mixing":
            assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        docs = out
    assert docs.where("NOT round_trip").count() == 0 and docs.count() == kept["mixing"].count()


def test_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty texts, repeated rows, no rows at all, names that the operators use inside."""
    rows = [(1, "a few plain words here", "en", "s", 22, 0.5, 1), (1, "a few plain words here", "en", "s", 22, 0.5, 1), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, None, 2), (None, "password = hunter22 and more", "de", None, 28, 1.0, 3), (3, "x" * 30000, "en", "s", 30000, 0.0, 4)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, membership int")
    for table in (odd, odd.where("doc_id = 99")):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == odd.columns and out.count() <= docs.count(), name
            docs = corpus_pipeline.settle(out, "odd")
        kept = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert kept.count() == docs.count() and kept.where("NOT round_trip").count() == 0
    assert odd.count() == 6 and docs.count() == 0
