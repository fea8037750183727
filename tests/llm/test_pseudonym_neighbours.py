"""Values beside other numbers, and dates in both orders."""

import re

from ledgerlark.llm import pseudonyms

CASES = [
    ("card 4111111111111111 12/27", "4111111111111111", ["card"]),
    ("4111 1111 1111 1111 123", "4111 1111 1111 1111", ["card"]),
    ("4111-1111-1111-1111 12/27 123", "4111-1111-1111-1111", ["card"]),
    ("no 1234 4111 1111 1111 1111", "4111 1111 1111 1111", ["card"]),
    ("12/27 378282246310005", "378282246310005", ["card"]),
    ("3782 822463 10005, 99", "3782 822463 10005", ["card"]),
    ("41111 11111 111111", "41111 11111 111111", ["card"]),
    ("212-555-1234 2024", "212-555-1234", ["phone"]),
    ("555-123-4567 555-765-4321", "555-123-4567", ["phone", "phone"]),
    ("555-123-4567 555-765-4321", "555-765-4321", ["phone", "phone"]),
    ("4111111111111111 212-555-1234", "4111111111111111", ["card", "phone"]),
    ("4111111111111111 212-555-1234", "212-555-1234", ["card", "phone"]),
    ("4111111111111112 212-555-1234", "212-555-1234", ["phone"]),
    ("born 1/2/1985.", "1/2/1985", ["day_date"]),
    ("on 12/31/1999 it", "12/31/1999", ["day_date"]),
    ("at 7/25/1999 4111111111111111", "7/25/1999", ["day_date", "card"]),
]


def test_values_beside_other_numbers(spark):
    rows = pseudonyms.pseudonymised(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id bigint, text string"), "k").orderBy("doc_id").collect()
    for r, (text, value, kinds) in zip(rows, CASES, strict=True):
        assert r.kinds == kinds and value not in r.clean_text, (text, r)
        if "day_date" not in kinds:
            assert re.sub(r"\d", "0", r.clean_text) == re.sub(r"\d", "0", text)
    assert rows[0].clean_text.endswith(" 12/27") and rows[1].clean_text.endswith(" 123") and rows[7].clean_text.endswith(" 2024")


def test_what_stays(spark):
    texts = ["4111111111111112 12/27", "13/13/1999 31/31/1999", "\ufdd0 4111111111111112 \ufdd1 x", "\ufdd04111111111111112\ufdd1"]
    rows = pseudonyms.pseudonymised(spark.createDataFrame([(t,) for t in texts], "text string"), "k").collect()
    assert [(r.clean_text, r.kinds) for r in rows] == [(t, []) for t in texts]
