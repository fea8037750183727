"""Operators against slow plain versions and written-out cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import documents, matching, rules, series, temporal, understanding

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("most", [0, 5_000])
def test_pairs_are_greedy_and_one_to_one(spark, most):
    draw = random.Random(4)
    moves = [(i, draw.randrange(6), "current", DAY + datetime.timedelta(days=draw.choice([0, 40]) + draw.randrange(8)), draw.choice([-1, 1]) * draw.choice([500, 700]), draw.choice(["SHOP", "TRANSFER TO SAVINGS", "REFUND"])) for i in range(120)]
    got = {(r.out_id, r.in_id) for r in matching.pair_transfers(spark.createDataFrame(moves, "id bigint, account_id bigint, account_kind string, date date, amount_pence bigint, text string"), most=most).collect()}
    ranked = []
    for o in moves:
        for i in moves:
            gap = abs((o[3] - i[3]).days)
            if o[4] < 0 and i[4] == -o[4] and o[1] != i[1] and gap <= 3:
                words = len({w for w in matching.TRANSFER_WORDS if w in o[5] or w in i[5]})
                ranked.append((gap, -words, o[3], o[0], i[0]))
    used, want = set(), set()
    for *_, a, b in sorted(ranked):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want and want


def test_soft_duplicates(spark):
    draw = random.Random(6)
    texts = ["green shop", "green shop london", "blue cafe", "12"]
    row = lambda i: (i, 1, DAY + datetime.timedelta(days=draw.randrange(5)), draw.choice([100, 200]), draw.choice(texts), i)
    new, stored = [row(i) for i in range(30)], [row(1000 + i) for i in range(30)]
    schema = "id bigint, account_id bigint, date date, amount_pence bigint, raw_description string, pos bigint"
    got = {(r.new_id, r.stored_id) for r in matching.soft_matches(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema)).collect()}
    tokens = lambda t: {w for w in t.split() if len(w) >= 3 and not w.isdigit()}
    alike = lambda a, b: bool(a and b) and (a <= b or b <= a or len(a & b) / len(a | b) >= 0.5)
    taken, matched, want = set(), set(), set()
    for most in (0, 2):
        for n in new:
            if n[0] in matched:
                continue
            near = sorted((abs((s[2] - n[2]).days), s[5], s) for s in stored if s[3] == n[3] and abs((s[2] - n[2]).days) <= most and s[0] not in taken)
            for *_, s in near[: matching.MOST_CANDIDATES]:
                if alike(tokens(n[4]), tokens(s[4])):
                    taken.add(s[0])
                    matched.add(n[0])
                    want.add((n[0], s[0]))
                    break
    assert got == want and want


def found_series(spark, cases, **also):
    """The series of each case (payments and the day they're judged on), detected side by side."""
    rows = [(k, k, 100 * k + i, d, p) for k, (items, _) in enumerate(cases) for i, (d, p) in enumerate(items)]
    until = spark.createDataFrame([(k, u) for k, (_, u) in enumerate(cases)], "account_id bigint, until date")
    got = series.detect(spark.createDataFrame(rows, "merchant_id bigint, account_id bigint, id bigint, date date, pence bigint"), until, **also).collect()
    return [[r for r in got if r.account_id == k] for k in range(len(cases))]


def monthly(n, pence, day=5, start=0):
    return [(datetime.date(2024 + (start + k) // 12, (start + k) % 12 + 1, day), pence) for k in range(n)]


def test_series(spark):
    tax = [p for p in monthly(24, 15000) if p[0].month not in (2, 3)]
    bill = [(d, p) for (d, _), p in zip(monthly(8, 0), (1000, 1100, 1250, 1050, 1300, 1180, 1020, 1240))]
    ends = [(datetime.date(2024, m, d), 700) for m, d in ((1, 31), (2, 29), (3, 29), (4, 30), (5, 31))]
    weekly = [(DAY + datetime.timedelta(days=7 * k), 350) for k in range(6)]
    gap = [p for p in monthly(9, 800) if p[0].month not in (4, 5)]
    shop = [(DAY + datetime.timedelta(days=d), p) for d, p in ((0, 5000), (3, 7100), (40, 2900), (41, 3600))]
    cases = [
        (monthly(4, 1000) + monthly(4, 1200, start=4), datetime.date(2024, 9, 1)),
        (monthly(5, 900), datetime.date(2024, 12, 1)),
        (tax, datetime.date(2025, 12, 31)),
        ([(datetime.date(2024, 1, 5), 100), *monthly(6, 1500, start=1)], datetime.date(2024, 7, 20)),
        (monthly(6, 500) + monthly(6, 2000, day=20), datetime.date(2024, 7, 1)),
        (bill, datetime.date(2024, 9, 1)),
        (weekly, DAY + datetime.timedelta(days=40)),
        (ends, datetime.date(2024, 6, 1)),
        (gap, datetime.date(2024, 11, 20)),
        (shop + monthly(5, 999, day=15), datetime.date(2024, 6, 1)),
        ([(DAY, 100)], datetime.date(2024, 6, 1)),
        ([(DAY, 100), (DAY, 100)], datetime.date(2024, 6, 1)),
    ]
    (rise,), (lapsed,), (skips,), (trial,), two, (bill,), (week,), (end,), (missed,), (exact,), lone, same = found_series(spark, cases)
    assert (rise.cadence, rise.expected_pence, rise.expected_day, rise.status, rise.next_due, rise.annual_pence) == ("monthly", 1200, 5, "active", datetime.date(2024, 9, 5), 14400)
    assert [s.amount_pence for s in rise.price_history] == [1000, 1200]
    assert lapsed.status == "lapsed" and lapsed.late == [datetime.date(2024, m, 5) for m in range(6, 12)]
    assert skips.skip_months == [2, 3] and skips.annual_pence == 150000 and skips.missed == []
    assert trial.trial_id == 300 and trial.occurrences == 6 and not any(s.trial_id for s in (rise, bill, week))
    assert sorted(s.expected_pence for s in two) == [500, 2000]
    assert bill.varies and bill.price_history == [] and bill.expected_pence == 1180
    assert (week.cadence, week.annual_pence) == ("weekly", 350 * 52) and end.expected_day == 0 and end.next_due == datetime.date(2024, 6, 30)
    assert missed.missed == [datetime.date(2024, 4, 5), datetime.date(2024, 5, 5)]
    assert (exact.expected_pence, exact.occurrences) == (999, 5) and lone == [] and same == []


def test_ten_instalments_in_the_first_year(spark):
    tax = [p for p in monthly(12, 15000) if p[0].month not in (2, 3)]
    (known,), = found_series(spark, [(tax, datetime.date(2024, 12, 31))], expected_gaps=frozenset({2, 3}))
    (unknown,), = found_series(spark, [(tax, datetime.date(2024, 12, 31))])
    assert known.skip_months == [2, 3] and known.missed == [] and unknown.skip_months == [] and len(unknown.missed) == 2


def test_detector_over_groups(spark):
    rows = [(m, 1, 100 * m + i, d, p) for m in (1, 2) for i, (d, p) in enumerate(monthly(5, 1000 * m))]
    got = series.detect(spark.createDataFrame(rows, "merchant_id bigint, account_id bigint, id bigint, date date, pence bigint"), datetime.date(2024, 6, 1)).collect()
    assert sorted((r.merchant_id, r.cadence, r.expected_pence) for r in got) == [(1, "monthly", 1000), (2, "monthly", 2000)]
    fitted = series.due(series.fitted_cadence(spark.createDataFrame(rows, "merchant_id bigint, account_id bigint, id bigint, date date, pence bigint"), ["merchant_id"]))
    assert {(r.merchant_id, r.cadence, r.next_due) for r in fitted.collect()} == {(1, "monthly", datetime.date(2024, 6, 5)), (2, "monthly", datetime.date(2024, 6, 5))}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 9, "z")], "k string, s int, v string")
    got = temporal.as_of(left, right, ["k"], "t", "s", ["v"])
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("a", 5, "y"), ("b", 2, None)]


def test_confirmed_rows_never_change(spark):
    draw = random.Random(9)
    rows = [(i, "c", "household", 0.5, draw.choice(["human", "model"]), draw.choice([40, 100]), draw.choice(["confirmed", "inferred"])) for i in range(200)]
    schema = "id bigint, category_id string, who string, confidence double, decided_by string, authority int, status string"
    new = [(i, "d", None, 0.9, draw.choice(["rule", "model"]), draw.choice([40, 80, 100])) for i in range(200)]
    before = spark.createDataFrame(rows, schema)
    after = understanding.merged(before, spark.createDataFrame(new, "id bigint, category_id string, who string, confidence double, decided_by string, authority int"))
    changed = understanding.history(before, after, ["category_id", "status"])
    assert changed.join(before.where("status = 'confirmed'").select("id"), "id").count() == 0 < changed.count()


def test_fingerprints_tell_repeats_apart(spark):
    rows = [(1, 1, DAY, -100, "A  b", 0), (2, 1, DAY, -100, "a B", 1), (3, 1, DAY, -100, "c", 2)]
    got = matching.fingerprinted(spark.createDataFrame(rows, "id bigint, account_id bigint, date date, amount_pence bigint, raw_description string, pos int").withColumn("statement_id", F.lit(1))).collect()
    assert sorted(r.occurrence for r in got) == [0, 0, 1] and len({r.fingerprint for r in got}) == 3


def test_rows_from_boxes(spark):
    """Slanted rows, a tall box, column breaks, and pages apart, against a plain fold."""
    draw = random.Random(8)
    boxes = []
    for page in range(6):
        for r in range(draw.randrange(1, 12)):
            x = 0.0
            for _ in range(draw.randrange(1, 6)):
                word = "w" * draw.randrange(1, 9)
                x += draw.choice([4.0, 30.0])
                top = r * 14.0 + draw.random() * 4
                boxes.append((page, x, x + 6 * len(word), top, top + draw.choice([9.0, 10.0, 18.0]), word))
                x += 6 * len(word)
    want = set()
    for page in range(6):
        rows = []
        for b in sorted((b for b in boxes if b[0] == page), key=lambda b: ((b[3] + b[4]) / 2, b[4] - b[3], *b[1:3], b[5])):
            middle = (b[3] + b[4]) / 2
            if rows and abs(middle - sum((x[3] + x[4]) / 2 for x in rows[-1]) / len(rows[-1])) <= max(x[4] - x[3] for x in rows[-1]) / 2:
                rows[-1].append(b)
            else:
                rows.append([b])
        for k, row in enumerate(rows):
            row.sort(key=lambda b: (b[1], b[2], b[5]))
            width = sorted((b[2] - b[1]) / len(b[5]) for b in row)[len(row) // 2]
            want.add((page, k, row[0][5] + "".join(("   " if b[1] - a[2] > 2.7 * width else " ") + b[5] for a, b in zip(row, row[1:]))))
    got = documents.rows_from_boxes(spark.createDataFrame(boxes, "page int, left double, right double, top double, bottom double, text string"), "page")
    assert set(map(tuple, got.collect())) == want


def test_rules_meet_rows_whichever_way(spark):
    """Few rules are broadcast; many are joined by merchant, word or account: the same rule wins."""
    draw = random.Random(3)
    some = lambda *values: draw.choice([None, *values])
    made = [(f"r{i}", some(1, 2, 3), some("shop", "to savings", "tea-room ltd", "!"), some(100, 500), some(900), some(1, 2), some("in", "out"), some(DAY), None, some("p"), f"c{i}", draw.choice(["seed", "person"]), draw.randrange(4)) for i in range(80)]
    rows = [(i, draw.choice([1, 2, 3, 9]), draw.randrange(4), draw.choice([-1, 1]) * draw.randrange(1, 1200), DAY + datetime.timedelta(days=draw.randrange(-3, 4)), draw.choice(["p", "q"]), draw.choice(["THE SHOP", "TRANSFER TO SAVINGS", "TEA-ROOM LTD 12", "X"])) for i in range(300)]
    rule_table = spark.createDataFrame(made, rules.SCHEMA)
    txns = spark.createDataFrame(rows, "id bigint, merchant_id bigint, account_id bigint, amount_pence bigint, date date, who string, text string")
    ways = [sorted(map(tuple, rules.best_rules(txns, rule_table, most).collect())) for most in (10_000, 20, 0)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 100


def test_soft_duplicates_of_one_hot_amount(spark):
    """Thousands of rows of one amount, every day over years: no pairs are written, and rows meet in order."""
    n = 6_000
    row = lambda i, k: (i, 1, DAY + datetime.timedelta(days=k // 3), 100, "green shop", k)
    schema = "id bigint, account_id bigint, date date, amount_pence bigint, raw_description string, pos bigint"
    new, stored = [row(k, k) for k in range(n)], [row(100_000 + k, k) for k in range(n)]
    got = matching.soft_matches(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema)).collect()
    assert {(r.new_id, r.stored_id, r.gap) for r in got} == {(k, 100_000 + k, 0) for k in range(n)}
