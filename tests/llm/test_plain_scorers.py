"""Scores of the two classifiers against plain ones, word by word, on the trained model; what they find among held-out rows."""

import math
import os
import random
import re
import zlib

import pandas as pd
import pytest

from ledgerlark.llm import quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")

TEXTS = [None, "", " ", "a", "Ab ab ab", "word " * 3000, "日本語 é x9 x9 ... !", "<b>12</b>\n\n12", "y" * 5000 + " z", "One bad thing. Two good? Three\nfour!", "...!", "\x00 \ud7ff 🎉🎉"]


def texts(seed, n=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé1-X") for _ in range(draw.randrange(1, 12))) for _ in range(80)]
    return [" ".join(draw.choice(vocabulary) + draw.choice(["", "", ".", "\n"]) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


def plain_mix(h, kind):
    m = (1 << 64) - 1
    h = (h + (kind * 0x9E3779B97F4A7C15 & m)) * 0xD6E8FEB86659FD93 & m
    return ((h ^ h >> 32) * 0xD6E8FEB86659FD93 & m) >> 40 & (quality.BUCKETS - 1)


def plain_features(word):
    """The features of one word: itself, its shape, its runs of 3 and 4."""
    points, step, m = [ord(c) for c in f"<{word}>"], 0x100000001B3, (1 << 64) - 1
    power = lambda k: pow(step, k + 1, 1 << 64)
    whole = sum(p * power(k) for k, p in enumerate(points)) & m
    shape = ["A" if "A" <= chr(p) <= "Z" else "0" if "0" <= chr(p) <= "9" else "a" if p > 127 or "a" <= chr(p) <= "z" else chr(p) for p in points]
    folded = [ord(c) for i, c in enumerate(shape) if not i or c != shape[i - 1]]
    out = [plain_mix(whole, 1), plain_mix(sum(p * power(k) for k, p in enumerate(folded)) & m, 2)]
    for n in (3, 4):
        out += [plain_mix(sum(p * power(k) for k, p in enumerate(points[i : i + n])) & m, n) for i in range(len(points) - n + 1)]
    return out


def plain_quality(model, text):
    words = (text or "").split()
    words += [quality.REPEAT for a, b in zip(words, words[1:]) if a == b]
    z = [0.0, 0.0]
    for w in words:
        own = plain_features(w)
        mean = [sum(float(model["vectors"][f][d]) for f in own) / len(own) / len(words) for d in range(quality.WIDTH)]
        z = [z[c] + sum(mean[d] * float(model["out"][d][c]) for d in range(quality.WIDTH)) for c in (0, 1)]
    z = [z[c] + float(model["bias"][c]) for c in (0, 1)]
    return 1 / (1 + math.exp(z[0] - z[1]))


def plain_toxicity(model, text):
    clean = 0.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        if words := {w for w in re.split(r"[\W\d_]+", sentence) if w}:
            features = [x for w in words for x in [w, *(f"<{w[:n]}" for n in (4, 5) if len(w) >= n)]]
            z = model["bias"] + sum(float(model["weights"][zlib.crc32(x.encode()) % toxicity.BUCKETS]) for x in features)
            clean += math.log1p(math.exp(z)) if z < 30 else z
    return -math.expm1(-clean)


@pytest.mark.parametrize(("module", "plain"), [(quality, plain_quality), (toxicity, plain_toxicity)])
def test_scores(spark, module, plain):
    rows = texts(1) + TEXTS
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, (t.count("1") > 3) * 1) for i, t in enumerate(rows[:60])], "doc_id bigint, label int")
    model = module.train(df, labels, label="label")
    for r in module.scored(df, model, ["doc_id"]).collect():
        assert r.score == pytest.approx(plain(model, rows[r.doc_id]), rel=1e-5, abs=1e-7), rows[r.doc_id]


@needs_data
@pytest.mark.parametrize(("name", "label"), [("op1_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_rows_are_found(name, label, spark):
    """Of held-out rows both classes are found: a constant answer finds none of one."""
    got = queries.QUERIES[name](spark, DATA).toPandas()
    held = got[got.held_out].merge(pd.read_parquet(f"{DATA}/labels.parquet"), on="doc_id")
    found, said = held[held[label] == 1], held[held.predicted == 1]
    assert len(found) and (found.predicted == 1).mean() >= 0.8 and (said[label] == 1).mean() >= 0.8
    assert (held[held[label] == 0].predicted == 0).mean() >= 0.95
