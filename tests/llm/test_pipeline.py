import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_of_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({"node": F.lit(1), "hash": F.lit("h"), "score": F.lit(0.5)})
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "mixing",
    ]
    count = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns
        assert 0.5 * count < out.count() <= count
        assert stage(spark, extra.limit(0), SF).count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, extra, SF)
    assert mixed.filter("taken <= 0").count() == 0 < mixed.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) > 50
