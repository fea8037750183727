"""What must not grow faster than the input: pairs, rows that one task gets, lists that Python holds."""

import collections
import contextlib
import datetime
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlark.operators import accounts, composites, matching, privacy, series, sinks
from ledgerlark.sources import delimited


@contextlib.contextmanager
def set_to(spark, **conf):
    """Spark settings (dots as two underscores) for a while."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    held = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_longest_prefixes(spark):
    """Of different values only, and the empty beginning is one."""
    values = spark.createDataFrame([("ab-1",), ("ab-12",), ("ab-12",), ("b-1",), (None,)], "model string")
    known = spark.createDataFrame([("ab",), ("ab-1",), ("ab-123",), ("",), ("",), (None,)], "prefix string")
    got = sorted(map(tuple, matching.longest_prefixes(values, known, "model", "prefix").collect()))
    assert got == [("ab-1", "ab-1"), ("ab-12", "ab-1"), ("b-1", "")]


def test_account_match_without_pairs(spark):
    """Against a plain version over pairs; a bank's accounts and statements meet as counts."""
    draw = random.Random(3)
    bank, kind, end = (lambda: draw.choice(["a", "b", "c", None])), (lambda: draw.choice(["current", "savings", "card", None])), (lambda: draw.choice(["1", "2", "3", "4", None]))
    held = [(i, bank(), kind(), end(), draw.choice(["active", "active", "closed"])) for i in range(14)]
    asked = [(i, bank(), kind(), end(), draw.choice([None, *range(14)])) for i in range(400)]
    want = {}
    for i, b, k, e, kept in asked:
        pool = [a for a in held if a[4] == "active" and b is not None and a[1] == b and (k is None or a[2] == k)]
        exact = [a for a in pool if e is not None and a[3] == e]
        left = exact or [a for a in pool if e is None or a[3] is None]
        alone = lambda a: sum(o[4] == "active" and o[1:3] == a[1:3] for o in held) == 1
        sure = [a[0] for a in left if len(exact) == 1 or (len(left) == 1 and (e is None or exact)) or (a[0] == kept and alone(a) and e is not None and a[3] == e)]
        best = [a[0] for a in left if a[0] == kept or len(left) == 1]
        want[i] = (max(sure, default=None), max(best, default=None), len(left))
    got = composites.matched_accounts(spark.createDataFrame(asked, "statement_id bigint, provider string, kind string, last4 string, remembered bigint"), spark.createDataFrame(held, "account_id bigint, provider string, kind string, last4 string, status string"))
    assert {r.statement_id: tuple(r)[1:] for r in got.select("statement_id", "account_id", "best_guess", "n_candidates").collect()} == want
    assert "Window" not in plan(got)


def test_rows_without_partner_are_dealt_out(spark):
    rows = spark.range(3000).selectExpr("id", "'c' AS category_id", "'human' AS decided_by", "cast(null AS bigint) AS rule_id", "cast(null AS bigint) AS merchant_id", "0.5D AS confidence", "IF(id % 100 = 0, id, null) AS partner_id", "false AS ignored")
    table = lambda shape, n=50: spark.range(n).selectExpr(*[f"cast(id * 100 AS {t}) AS {c}" for c, t in (x.split() for x in shape.split(","))])
    partners = spark.range(3000).selectExpr("id AS partner_id", "'x' AS nickname", "date '2024-05-01' AS partner_date")
    with set_to(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="8"):
        told = accounts.why(rows, table("rule_id bigint,description string,source string"), table("merchant_id bigint,name string,usual_category string,seen bigint"), table("id string,label string"), partners)
        dealt = collections.Counter(r.p for r in told.select(F.spark_partition_id().alias("p")).collect())
        assert max(dealt.values()) < 600 and sum(dealt.values()) == 3000
    assert told.where("why LIKE '%x on 01/05/2024.'").count() == 30


def test_records_go_back_in_parts():
    schema = pa.schema([("file", pa.int64()), ("line", pa.int32()), ("cells", pa.list_(pa.string()))])
    text = "\n".join(f"a{i},b" for i in range(7_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, "", text]), pa.array([",", ",", ","])], names=["file", "text", "mark"])
    parts = list(delimited.record_batches([batch], schema))
    assert max(p.num_rows for p in parts) <= 5_000 and len(parts) > 2
    assert [r for p in parts for r in p.to_pylist()] == [{"file": k, "line": i + 1, "cells": [f"a{i}", "b"]} for k in (1, 3) for i in range(7_000)]


def test_exports_are_of_bounded_files(spark, tmp_path):
    rows = spark.range(25).coalesce(1).selectExpr("date '2024-05-01' AS date", "'x' AS description", "id + 1 AS amount_pence")
    sinks.export_csv(rows, str(tmp_path / "out"), 10)
    sizes = sorted(len(p.read_text().splitlines()) for p in (tmp_path / "out").glob("*.csv"))
    assert sizes == [6, 11, 11]
    assert delimited.parsed(spark.read.text(str(tmp_path / "out"), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))).where("outcome = 'row'").count() == 25


MOVES = "id bigint, account_id bigint, account_kind string, date date, amount_pence bigint, text string"
DAY = datetime.date(2024, 1, 1)


def test_texts_are_read_before_rows_meet(spark):
    """However many pairs a row is in, its words are looked for once."""
    texts = ("SAVINGS POT", "TRANSFER POT", "SHOP", "REFUND", None)
    moves = spark.createDataFrame([(i, i % 5, "current", DAY, 500 if i % 2 else -500, texts[i // 2 % 5]) for i in range(40)], MOVES)
    got = matching.pair_candidates(moves)
    assert "RLIKE" not in plan(got).upper()
    words = lambda i: {w for w in matching.TRANSFER_WORDS if w in (texts[i // 2 % 5] or "").split()}
    assert all(r.words == len(words(r.out_id) | words(r.in_id)) for r in got.collect()) and got.count() > 100


def test_transfers_to_accounts_of_one_phrase(spark):
    """Against a plain version over rows and accounts, which meet as counts by day only."""
    draw = random.Random(8)
    day = lambda n: DAY + datetime.timedelta(days=n)
    moves = [(i, draw.randrange(8), "current", day(draw.randrange(12)), 100 + i, f"TO REF{draw.randrange(4)} REF{draw.randrange(4)}") for i in range(150)]
    names = [(a, f"ref{p}") for a in range(8) for p in range(4) if draw.random() < 0.35]
    held = [(a, day(s), day(s + draw.randrange(-1, 8))) for a in range(7) for s in (draw.randrange(4), 4 + draw.randrange(5))]
    near = lambda d, a: any(b == a and s - datetime.timedelta(1) <= d <= e + datetime.timedelta(1) for b, s, e in held)
    want = {m[0] for m in moves for a, p in names if p.upper() in m[5].split() and a != m[1] and not near(m[3], a)}
    run = composites.transfer_run(spark.createDataFrame(moves, MOVES), spark.createDataFrame([], MOVES), spark.createDataFrame(names, "account_id bigint, phrase string"), spark.createDataFrame(held, "account_id bigint, first_day date, last_day date"))
    assert {r.id for r in run.collect()} == want and 0 < len(want) < 150
    assert "other" not in plan(run)


def test_like_cells_are_told_once(spark):
    """A date is read for each different cell, after they're dealt out, not for each row; frequent and empty cells count as before."""
    rows = spark.createDataFrame([(f, ["0%d/02/2024" % (1 + i % 9), "10.00", "", None, f"x{i}"]) for f in (1, 2) for i in range(30)], "file bigint, cells array<string>")
    got = delimited.inferred_columns(rows)
    assert sorted(map(tuple, got.collect())) == [(f, at, kind, form) for f in (1, 2) for at, kind, form in ((0, "date", "%d/%m/%Y"), (1, "money", None), (4, "text", None))]
    assert "try_to_timestamp" not in plan(got) and "gettimestamp" not in plan(got)


def test_lines_are_dealt_out_whatever_their_bytes(spark):
    """A few lines of one file are prepared by as many tasks as the session has shuffle partitions."""
    lines = spark.range(64).coalesce(1).selectExpr("id AS k", "concat('SHOP ', id) AS text")
    with set_to(spark, spark__sql__shuffle__partitions="8"):
        found = privacy.prepared(lines, "k", "k")
        assert len({r.p for r in found.select(F.spark_partition_id().alias("p")).collect()}) > 4


def test_payments_of_series_are_dealt_out_by_number(spark, monkeypatch):
    """Where one task would get all payments by their bytes, it gets few; none is moved again for a join, and series are as before."""
    payments = spark.range(3000).selectExpr("id % 7 AS merchant_id", "id % 250 AS account_id", "id", "add_months(date '2023-01-05', int(id div 250)) AS date", "1000 + id % 250 * IF(id div 250 > 5, 2, 1) AS pence").withColumn("merchant_id", F.col("account_id") % 7)
    with set_to(spark, spark__sql__adaptive__coalescePartitions__parallelismFirst="false"):
        held = sorted(map(str, series.detect(payments, datetime.date(2024, 6, 1)).collect()))
        monkeypatch.setattr(series, "ROWS_A_TASK", 60)
        found = series.detect(payments, datetime.date(2024, 6, 1))
        by_task = collections.Counter()
        for r in found.select(F.spark_partition_id().alias("p"), "occurrences").collect():
            by_task[r.p] += r.occurrences
        assert sum(by_task.values()) == 3000 and max(by_task.values()) <= 300
        assert sorted(map(str, found.collect())) == held and len(held) == 250
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_twins_of_a_merchant_are_counted(spark):
    """Series of one merchant don't meet in one task to be counted."""
    payments = spark.range(40).selectExpr("1L AS merchant_id", "id % 8 AS account_id", "id", "add_months(date '2024-01-05', int(id div 8)) AS date", "1000L AS pence")
    run = composites.commitment_run(payments, datetime.date(2024, 6, 1))
    assert [r.flags for r in run.collect()] == [["duplicate"]] * 8
    assert "Window" not in plan(run)


def test_coverage_leaves_payments_dealt_out(spark, monkeypatch):
    """Series judged by each account's own day: payments that meet it are dealt out by their number too."""
    payments = spark.range(1500).selectExpr("id % 125 % 7 AS merchant_id", "id % 125 AS account_id", "id", "add_months(date '2023-01-05', int(id div 125)) AS date", "1000L AS pence")
    until = spark.range(125).selectExpr("id AS account_id", "IF(id % 4 = 0, date '2024-12-31', date '2023-12-05') AS until")
    monkeypatch.setattr(series, "ROWS_A_TASK", 60)
    found = series.detect(payments, until).select("account_id", "status", "occurrences", F.spark_partition_id().alias("p")).collect()
    by_task = collections.Counter()
    for r in found:
        by_task[r.p] += r.occurrences
    assert max(by_task.values()) <= 300 and sum(by_task.values()) == 1500
    assert {r.account_id for r in found if r.status == "lapsed"} == set(range(0, 125, 4))


def test_series_meet_coverage_and_not_payments(spark):
    """The day that an account's data goes to is joined to what payments were summed up to, and a status needs no lists of them."""
    payments = spark.range(1500).selectExpr("id % 125 % 7 AS merchant_id", "id % 125 AS account_id", "id", "add_months(date '2023-01-05', int(id div 125)) AS date", "1000L AS pence")
    until = spark.range(120).selectExpr("id AS account_id", "IF(id % 4 = 0, date '2024-12-31', date '2023-12-05') AS until")
    found = series.detect(payments, until).select("account_id", "status")
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < optimized.index("Join") < optimized.index("Aggregate")
    assert re.search(r"(\w*)Aggregate", found._jdf.queryExecution().executedPlan().toString())[1] == "Hash"
    assert sorted(map(tuple, found.collect())) == [(a, "active" if a % 4 else "lapsed") for a in range(120)]


def test_cadences_of_gaps_are_looked_up(spark):
    """The table of gaps tells the same as the rule."""
    gaps = spark.range(1400).selectExpr("int(id) AS gap").union(spark.sql("SELECT int(null)"))
    steps = [series.gap_steps(F.col("gap"), c).alias(c) for c in series.CADENCES]
    told = series._stepped(gaps).select("gap", "stepped", "single", *steps).collect()
    for r in told:
        want = [sum(1 << i for i, c in enumerate(series.CADENCES) if fits(r[c])) for fits in (lambda k: k is not None, lambda k: k == 1)]
        assert [r.stepped, r.single] == ([None, None] if r.gap is None else want)
    assert sum(bool(r.stepped) for r in told) > 100
