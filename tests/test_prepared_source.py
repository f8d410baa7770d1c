"""The source of a prepared corpus is written in as many files as the session has shuffle partitions."""

from feedloom.plans import catalog
from feedloom.sources import corpus


def test_prepared_source_is_not_a_fixed_number_of_files(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i}", "en", "web", 1) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made, fresh = {}, catalog.fresh_dir
    monkeypatch.setattr(catalog, "fresh_dir", lambda session, label: made.setdefault(label, fresh(session, label)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = catalog.QUERIES["prepare_corpus"](spark, str(tmp_path)).select("format", "doc_id").collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(corpus.list_shards(spark, made["source"], "*.json").collect()) == 9
    assert sorted(map(tuple, rows)) == [(f, i) for f in ("indexed", "parquet") for i in range(400)]
