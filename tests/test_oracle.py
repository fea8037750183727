"""Registered queries against their SQL in DuckDB, on the smallest driver tables."""

import collections
import datetime
import glob
import os
import re
import unicodedata

import duckdb
import pytest

from ledgerlark import plans
from ledgerlark.functions.dates import CADENCES
from ledgerlark.operators import matching
from ledgerlark.plans import adapter, understanding

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def normal(row):
    day = lambda v: v.isoformat()[:10] if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else v
    return tuple(round(v, 6) if isinstance(v, float) else str(day(v)) if isinstance(v, datetime.date) else v for v in row)


SLOW = {"S11_csv_layouts"}  # tests/test_sources.py reads layouts


@pytest.mark.parametrize("name", sorted(set(plans.ORACLE_SQL) - SLOW))
def test_query(name, spark, duck):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((normal(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((normal(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


MORE = "/root/testdata/sf0.01"


def test_transfer_pairs(spark):
    """J6 and D6 over a whole table: the greedy choice, edge by edge, and each row in one decision at most."""
    moves = [(r.id, r.account_id, r.date, r.amount_pence, r.text) for r in adapter.movements(spark, MORE).collect()]
    into = collections.defaultdict(list)
    for m in moves:
        if m[3] > 0:
            into[m[3]].append(m)
    words = lambda *texts: len({w for t in texts for w in matching.TRANSFER_WORDS if re.search(rf"\b{w}\b", t)})
    edges = sorted((abs((i[2] - o[2]).days), -words(o[4], i[4]), o[2], o[0], i[0]) for o in moves if o[3] < 0 for i in into[-o[3]] if i[1] != o[1] and abs((i[2] - o[2]).days) <= 3)
    used, want = set(), set()
    for *_, o, i in edges:
        if not used & {("o", o), ("i", i)}:
            used |= {("o", o), ("i", i)}
            want.add((o, i))
    assert {(r.out_id, r.in_id) for r in plans.QUERIES["J6_transfer_pairs"](spark, MORE).collect()} == want and want
    run = plans.QUERIES["D6_transfer_run"](spark, MORE).collect()
    refunds = {m[0] for m in moves if m[4].startswith("REFUND")}
    assert len({r.id for r in run}) == len(run) > 0 and not refunds & {r.id for r in run}
    paired = {r.id: r.partner for r in run if r.kind == "pair"}
    assert all(paired[p] == i for i, p in paired.items())


def test_soft_duplicates_on_tables(spark):
    got = plans.QUERIES["J5_dedupe_plan"](spark, MORE).collect()
    counts = collections.Counter(r.match for r in got)
    assert len({r.id for r in got}) == len(got) and set(counts) <= {"exact", "similar", "new"} and counts["exact"] and counts["similar"]


def test_import(spark):
    """Every line of an imported statement is linked once, and those of stored ones stay."""
    lines = collections.Counter(r.statement_id for r in understanding.lines(spark, DATA).collect())
    got = collections.Counter()
    for r in plans.QUERIES["W1_import_statement"](spark, DATA).collect():
        got[r.statement_id] += r.n
    assert got == lines


def test_normalised(spark):
    texts = {r.doc_id: r.text for r in adapter.table(spark, DATA, "documents").collect()}
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) not in ("Cf", "Mn", "Me")).translate(str.maketrans("‘’ʼ“”‐‑‒–—−", "\'\'\'\"\"------"))
    for r in plans.QUERIES["F20_normalised"](spark, DATA).collect():
        assert r.text == (plain(texts[r.doc_id]) if texts[r.doc_id] is not None else None)


def test_series_of_orders(spark):
    """WN10 and D8 over orders: every series is long enough for its cadence and due after its last payment."""
    found = plans.QUERIES["WN10_detected_series"](spark, MORE).collect()
    assert found and all(r.occurrences >= CADENCES[r.cadence][3] for r in found)
    flagged = plans.QUERIES["D8_commitment_run"](spark, MORE).collect()
    key = lambda r: (r.merchant_id, r.account_id, r.cadence, r.status)
    assert sorted(map(key, flagged)) == sorted(map(key, found))
    assert all(("lapsed" in r.flags.split(",")) == (r.status == "lapsed") for r in flagged)
