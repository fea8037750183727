"""Names replaced in texts, against written-out cases and a plain version."""

import random
import unicodedata

import regex

from ledgerlark.operators import names, redaction

PEOPLE = [(1, 1, "Zoë O'Brien", "adult"), (1, 2, "Will Smith", "adult"), (1, 3, "Ann Smith", "child"), (1, 4, "Smith", "lodger"), (1, 5, "zoë  o'brien", "child"), (1, 6, " ", "adult"), (2, 1, "Will Smith", "child"), (None, 1, "Max Power", "adult")]
SHAPE = "household int, pos int, name string, role string"
CASES = [
    ("Zoe O'Brien and ZOË O’BRIEN", "[ADULT_A] and [ADULT_A]"), ("Z. O'Brien; z o'brien", "[ADULT_A]; [ADULT_A]"), ("I will pay Will, WILL or Willow", "I will pay [ADULT_B], [ADULT_B] or Willow"),
    ("Smith SMITH smith", "[DEPENDANT_1] [DEPENDANT_1] smith"), ("W. Smith's and A Smith", "[ADULT_B]'s and [CHILD_1]"), ("ann smith will smith", "[CHILD_1] [ADULT_B]"), ("will_smith Will  Smith1", "will_smith [ADULT_B]1"), ("no one", "no one"), ("Max Power", "Max Power"), (None, None),
]


def test_written_out_cases(spark):
    lines = spark.createDataFrame([(1, i, t, "x") for i, (t, _) in enumerate(CASES)] + [(1, 0, CASES[0][0], "x"), (None, 0, "Max Power", "x")], "household int, pos int, text string, start string")
    found, mapping = names.replaced(lines, spark.createDataFrame(PEOPLE, SHAPE), "household")
    got = sorted(((r.household, r.pos, r.text) for r in found.collect()), key=repr)
    assert found.columns == lines.columns
    assert got == sorted([(1, i, want) for i, (_, want) in enumerate(CASES)] + [(1, 0, CASES[0][1]), (None, 0, "Max Power")], key=repr)
    back = redaction.put_back(found, mapping, "household").where("household = 1 AND pos = 5").first()
    assert back.text == "Ann Smith Will Smith"


def test_random_texts(spark):
    """Full names, with and without accents and in any case, leave no word of theirs behind, and come back as they were given."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeoüéñ") for _ in range(rng.randint(3, 6))).title()
    people = [(h, i, f"{word()} {word()} {word()}", "adult") for h in range(6) for i in range(4)]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    lines = [(h, 10 * i + k, f"to {how(n)} and {how(n)}, 4.00") for h, i, n, _ in people for k, how in enumerate((str.upper, str.lower, bare, lambda t: t))]
    found, mapping = names.replaced(spark.createDataFrame(lines, "household int, pos int, text string"), spark.createDataFrame(people, SHAPE), "household")
    assert all(regex.fullmatch(r"to (\[ADULT_[A-Z]\]) and \1, 4.00", r.text) for r in found.collect())
    back = {(r.household, r.pos): r.text for r in redaction.put_back(found, mapping, "household").collect()}
    assert back == {(h, 10 * i + k): f"to {n} and {n}, 4.00" for h, i, n, _ in people for k in range(4)}


def test_numbers_and_names_together(spark):
    rows = [(1, 0, "Will Smith 20 11 33 87654321 card 4111/1111/1111/1111"), (1, 1, "will.smith@x.org 20 11 33 87654321")]
    found, mapping = redaction.pseudonymised(spark.createDataFrame(rows, "household int, pos int, text string"), spark.createDataFrame(PEOPLE, SHAPE), "household")
    assert [r.text for r in found.orderBy("pos").collect()] == ["[ADULT_B] [SORT_CODE_1] [ACCOUNT_1] card [CARD_1]", "[EMAIL_1] [SORT_CODE_1] [ACCOUNT_1]"]
    assert [r.text for r in redaction.put_back(found, mapping, "household").orderBy("pos").collect()] == [t for _, _, t in rows]
