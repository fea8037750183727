"""Languages of very few training texts neither win what nobody has seen nor lose their words."""

import math
import random
from collections import Counter, defaultdict

import pytest

from ledgerlark.llm import language


def texts(seed, syllables, n):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(1500)]
    return [" ".join(draw.choice(vocabulary) for _ in range(40)) for _ in range(n)]


def test_a_language_of_one_text(spark):
    large, small = texts(1, ["the", "ing", "wo", "sh", "ough", "ed"], 320), texts(2, ["cion", "lla", "que", "os", "ien"], 21)
    train = spark.createDataFrame([(t, "en") for t in large[:300]] + [(small[0], "es")], "text string, lang string")
    held = spark.createDataFrame([(t, "en") for t in large[300:]] + [(t, "es") for t in small[1:]], "text string, lang string")
    got = language.predicted(held, language.train(train)).collect()
    assert [r.lang_pred for r in got] == [r.lang for r in got]


def test_unknown_in_all_but_one(spark):
    """A word of the large language doesn't count for a small one that never saw it."""
    model = language.train(spark.createDataFrame([("alpha beta gamma " * 400, "en"), ("delta gammel", "da"), ("zeta", "el")], "text string, lang string"))
    place = {x: f"s{i}" for i, x in enumerate(model.langs)}
    for r in model.words.where("word in ('alpha', 'beta', 'gamma')").collect():
        assert r[place["en"]] > r[place["da"]] == r[place["el"]]


def test_every_word_is_kept(spark):
    train = spark.createDataFrame([(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q" for i in range(k, k + 3000)), lang) for k, lang in ((0, "en"), (3000, "es"))], "text string, lang string")
    assert language.train(train).words.count() == 6000


def plain(train, texts):
    """The method, text by text: language and score."""
    words = lambda t: [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if w]
    count, runs = defaultdict(Counter), defaultdict(Counter)
    for text, lang in train:
        for w in words(text) if lang is not None else []:
            count[lang][w] += 1
            for i in range(len(w) + 2):
                for k in range(1, 5):
                    if i + k <= len(w) + 2:
                        runs[lang, k][f"<{w}>"[i : i + k]] += 1
    langs = sorted((x for x in count), key=lambda x: (-count[x].total(), x))

    def logs(own):
        n, total = sum(c for c, _ in own), sum(t for _, t in own)
        return [round(language.UNIT * math.log((1 - language.FLOOR) * c / max(t, 1) + language.FLOOR * n / total)) for c, t in own] if n else None

    def score(w):
        if known := logs([(count[x][w], count[x].total()) for x in langs]):
            return known
        found = []
        for i in range(len(w) + 2):
            for k in range(min(4, len(w) + 2 - i), 0, -1):
                if known := logs([(runs[x, k][f"<{w}>"[i : i + k]], runs[x, k].total()) for x in langs]):
                    found.append(known)
                    break
        return [sum(c) // len(found) for c in zip(*found)] if found else [0] * len(langs)

    out = []
    for text in texts:
        own = [score(w) for w in words(text)]
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        total = [sum(c) for c in zip(*own)]
        best = max(total)
        out.append((langs[total.index(best)], 1 / sum(math.exp((t - best) / language.UNIT) for t in total)))
    return out


@pytest.mark.parametrize("common", [0, 7, 40, 100_000])
def test_against_the_plain_method(spark, common, monkeypatch):
    """Common words and runs, rare ones, unseen words, with known and unknown runs: all ways give the same."""
    monkeypatch.setattr(language, "BLOCK", 50)
    draw = random.Random(9)
    train = list(zip(texts(3, ["the", "ing", "wo"], 25) + texts(4, ["que", "os", "Ñi"], 9) + ["Σίσυφος ΣΑΣ x2y ß"], ["en"] * 25 + ["es"] * 9 + ["el"])) + [("lost words", None)]
    rows = [t for t, _ in train] + texts(5, ["the", "qué", "zz", "日本"], 20) + ["", None, "123 !?", "zzzz", "日", "the the the que", "othing" * 60]
    model = language.train(spark.createDataFrame(train, "text string, lang string"), common=common)
    got = language.predicted(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    want = plain(train, rows)
    assert [r.lang_pred for r in got] == [x for x, _ in want]
    assert all(abs(r.score - x) < 1e-9 for r, (_, x) in zip(got, want))
    docs = spark.createDataFrame([(i, t, None if i % 2 else "xx") for i, t in enumerate(rows)], "c1 bigint, text string, lang string")
    kept = {r.c1: r.lang for r in language.told(docs, model).collect()}
    assert kept == {i: x if i % 2 else "xx" for i, (x, _) in enumerate(want) if x != "und"}
