"""Benchmark items without an id count like all others."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import decontaminate, queries


def test_items_without_an_id(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {passage} y"), (2, "a b c"), (3, "short one"), (4, None)]
    bench = [(None, passage), (7, "a b"), (None, "short one"), (8, "short one"), (None, None)]
    pd.DataFrame(docs, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL["op5_decontaminate"])
    columns = sorted(want.columns)
    got = queries.op5_decontaminate(spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.select(*columns).fetchall())
    assert {r.doc_id for r in decontaminate.contamination(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"), ["doc_id"]).where(F.col("n_hit") > 0).collect()} == {1, 2, 3}
    kept = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {4}
