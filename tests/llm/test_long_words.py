"""Texts without spaces count to their last character."""

import random
from collections import Counter

from ledgerlark.llm import language, quality


def test_quality_of_what_follows_character_64(spark):
    draw = random.Random(4)
    run = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    docs = [(i, "same" * 20 + run("abc" if i % 2 else "xyz", 300)) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = quality.train(df, df.where("doc_id < 100").selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    got = {r.doc_id: r.score for r in quality.scored(df, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(100, 120))


def test_runs_of_long_words(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("ab日🎉".replace("🎉", "é")) for _ in range(n)) for n in (1, 3, 60, 61, 62, 63, 64, 65, 66, 67, 68, 125, 126, 127, 128, 129, 500)]
    got = {r.run: r.n for r in language.run_counts(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), ["n"]).collect()}
    want = Counter(f"<{w}>"[i : i + k] for w in words for i in range(len(w) + 2) for k in range(1, 5) if i + k <= len(w) + 2)
    assert got == {run: 2 * n for run, n in want.items()}


def test_language_of_what_follows_letter_64(spark):
    head = "o" * 70
    train = spark.createDataFrame([(head + "abcabcabacbc" * 9, "x"), (head + "zyxzyxzyyxzz" * 9, "y")], "text string, lang string")
    held = spark.createDataFrame([(head + "abcabcabacbc" * 7, "x"), (head + "zyxzyxzyyxzz" * 7, "y")], "text string, lang string")
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in language.predicted(held, language.train(train)).collect())
