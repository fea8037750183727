"""A ledger kept in a folder, rules on long texts, and joins that can be split where one key has many rows."""

import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import chunks, lines, queries, secrets, simhash


def test_a_second_scan_reads_only_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token = 'abcdefghijklmnop'"), (2, "token = 'abcdefghijklmnop'"), (3, None)], "doc_id bigint, text string")
    shown = lambda found: {r.doc_id: r.s for r in found.select("doc_id", secrets.listed("found", secrets.RULES).alias("s")).collect()}
    assert shown(secrets.scan_into(folder, docs, "doc_id", "text")) == {1: "assign:0:25", 2: "assign:0:25", 3: ""}
    first = set(spark.read.parquet(folder).inputFiles())
    more = docs.unionByName(spark.createDataFrame([(4, "deadbeefdeadbeef"), (5, "")], "doc_id bigint, text string"))
    assert shown(secrets.scan_into(folder, more, "doc_id", "text")) == {1: "assign:0:25", 2: "assign:0:25", 3: "", 4: "hex:0:16", 5: ""}
    ledger = spark.read.parquet(folder)
    assert ledger.count() == 3 * len(secrets.RULES) == ledger.select("blob", "rule").distinct().count()
    assert ledger.where(~F.input_file_name().isin(*first)).select("blob").distinct().count() == 1


def test_web_tokens(spark, tmp_path):
    part = "abcdefghijklmn"
    texts = [f"eyJ{part}.{part}.{part}", f"x eyJ{part}.{part}.sig eyJ{part}.{part}.sig", f"a-eyJ{part}.{part}.sig", f"éeyJ{part}.{part}.sig", f"eyJ{part}.{part}.c.eyJ{part}.{part}.d", f"eyJeyJ{part}.{part}.c"]
    pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.sql(queries.ORACLE_SQL["op3_secrets"])
    got = queries.op3_secrets(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert [r.spans.count("jwt") for r in sorted(got)] == [1, 2, 0, 1, 2, 1]


def test_rules_take_time_in_proportion(spark):
    texts = ["eyJ" * 100_000, "AKIA" * 70_000, "token" * 60_000, "password: " + " " * 300_000, "-----BEGIN " * 30_000, "ghp_" * 70_000, "token=" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    start = time.time()
    found, _ = secrets.scan(df, "doc_id", "text")
    assert found.count() == len(texts) and time.time() - start < 60


HOT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "64k",
    "spark.sql.shuffle.partitions": "20",
}


@pytest.mark.parametrize("operator", ["op2", "op3", "op4", "op10"])
def test_hot_keys_are_split(spark, operator):
    """Of rows of which a third hold one text, the join of what was found with the rows is split."""
    hot = "one text of many copies of it\nthat has a secret = 'abcdefghijklmnop'"
    before = {k: spark.conf.get(k) for k in HOT}
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, hot).otherwise(F.concat(F.lit("own text "), F.col("id").cast("string"), F.lit("\nwith words "), F.sha2(F.col("id").cast("string"), 256))).alias("text")).repartition(12)
    try:
        for k, v in HOT.items():
            spark.conf.set(k, v)
        if operator == "op2":
            found = lines.repeated_lines(docs, "doc_id", "text")
        elif operator == "op3":
            found = secrets.scan(docs, "doc_id", "text")[0]
        elif operator == "op4":
            found = chunks.exact_duplicates(docs)
        else:
            found = simhash.near_duplicates(docs)
        rows = found.collect()
        assert len(rows) == (9_999 if operator == "op2" else 30_000)
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_findings_in_one_text(spark):
    """80 000 findings in one text take seconds, and twice as many no more than about twice as long."""
    took = []
    for n in (40_000, 80_000):
        text = "0123456789abcdef token=abcdefghijkl " * (n // 2)
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        began = time.time()
        found, _ = secrets.scan(docs, "doc_id", "text")
        row = found.select(secrets.count("found", secrets.HEX).alias("hex"), secrets.count("found", secrets.ASSIGN).alias("assign")).first()
        took.append(time.time() - began)
        assert (row.hex, row["assign"]) == (n // 2, n // 2)
    assert took[1] < 30
