import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import dates, money, text


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_printed_money(spark):
    cases = {"£1,234.56": 123456, "-5": -500, "(3.10)": -310, "12.5 DR": -1250, "4 CR": 400, "−7.00": -700, "$9.9-": -990, "1,23": None, "": None, "abc": None, "(3": None, "1" * 21: None, None: None}
    assert values(spark, cases, money.printed_pence) == list(cases.values())


def test_typed_money(spark):
    cases = {"£1,450.50": 145050, "12": 1200, "-0.5": -50, "1.234": None, "1000000001": None, "x": None}
    assert values(spark, cases, money.typed_pence) == list(cases.values())


def test_pounds(spark):
    assert values(spark, [-1205, 0, 7, 123456, None], money.pounds, "bigint") == ["-12.05", "0.00", "0.07", "1234.56", None]


def test_printed_dates(spark):
    day = datetime.date
    cases = {"1/2/2024": day(2024, 2, 1), "01/02/71": day(1971, 2, 1), "01/02/68": day(2068, 2, 1), "1st Sept 2024": day(2024, 9, 1), "03-JAN-24": day(2024, 1, 3), "2024-01-05 10:11:12": day(2024, 1, 5), "20240102": day(2024, 1, 2), "12-34-56": None, "31/02/2024": None, "": None, None: None}
    assert values(spark, cases, dates.printed_date) == list(cases.values())


def test_month_steps(spark):
    day = datetime.date
    df = spark.createDataFrame([(day(2024, 1, 31), "monthly", None, []), (day(2024, 1, 30), "monthly", 0, []), (day(2024, 1, 15), "monthly", 15, [2, 3]), (day(2024, 2, 29), "annual", None, []), (day(2024, 1, 1), "weekly", 0, [])], "d date, c string, w int, s array<int>")
    got = [r.n for r in df.select(dates.next_due(F.col("d"), F.col("c"), F.col("w"), F.col("s")).alias("n")).collect()]
    assert got == [day(2024, 2, 29), day(2024, 2, 29), day(2024, 4, 15), day(2025, 2, 28), day(2024, 1, 8)]


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("SQ *JS TRADING 0873 LONDON GB", "js trading"), ("DIRECT DEBIT TO AQUA WATER REF 12345", "aqua water"), ("Card payment to Greenbasket.co.uk 12 Jan 2024", "greenbasket"),
        ("NETSTREAM*PREMIUM", "netstream"), ("TFR 20 00 00 12345678", ""), ("SHOP 3", "shop"), ("ACME LTD LONDON GB", "acme"), ("O'NEIL'S BAR 22/03", "oneils bar"), ("", ""),
    ],
)
def test_merchant_key(spark, raw, key):
    assert values(spark, [raw], text.merchant_key) == [key]


def test_phrases_and_similarity(spark):
    df = spark.createDataFrame([("own account", "to OWN  ACCOUNT!", True), ("own", "unknown", False), ("", "x", False), ("isa", "VISA", False)], "p string, t string, want boolean")
    assert all(r.got == r.want for r in df.select(text.phrase_in(F.col("p"), F.col("t")).alias("got"), "want").collect())
    df = spark.createDataFrame([("GREEN SHOP 123", "green shop london", True), ("one two three", "four five six", False), ("12 34", "12 34", False)], "a string, b string, want boolean")
    tokens = lambda c: text.description_tokens(F.col(c))
    assert all(r.got == r.want for r in df.select(text.similar_tokens(tokens("a"), tokens("b")).alias("got"), "want").collect())


def test_iban(spark):
    assert values(spark, ["GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "x"], text.iban_valid) == [True, False, False]


def test_normal_forms(spark):
    from ledgerlark.operators.documents import normalised

    assert values(spark, ["ﬁ​ne “x” – y", "plain", None], normalised) == ["fine \"x\" - y", "plain", None]
