"""The first stage on rows of which none has a language."""

import corpus_pipeline


def test_documents_with_letters_stay(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Some words {i}", None) for i in range(12)] + [(20, None, None), (21, "", None), (22, "12 !?", None)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(12))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_run_goes_on_from_finished_stages(spark, tmp_path):
    rows = [(i, f"Some words of a text, number {i} of {i * i} and {i % 7} more words here", "en", "s", 5) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path / "run")
    first = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), folder).collect()))
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), folder).collect())) == first and first
    assert times == {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
