"""Whitening against numpy and nearest neighbours against brute force, with copies, ties, gaps and odd vectors."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import neighbours, queries, whitening

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
SCHEMA = "vec_id bigint, embedding array<double>, SCORE string, deviation string"
nan, inf = float("nan"), float("inf")


def some(n=300, width=5, seed=3):
    """Vectors in clusters, a third of them one vector, with repeats, ties and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)) + rng.integers(0, 4, (n, 1)) * 3, 1)
    x[: n // 3] = x[0]
    x[n // 3 : n // 3 + 20] = np.eye(width)[rng.integers(0, width, 20)]
    rows = [(i, v.tolist(), "x", "y") for i, v in enumerate(x)]
    bad = [None, [], [0.0] * width, [1.0, None, 0.0, 0.0, 0.0], [nan, 1.0, 0.0, 0.0, 0.0], [inf, 1.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    return rows + [rows[5], rows[-1], (None, rows[7][1], "x", "y")] + [(100_000 + 100 * i, v, "x", "y") for i, v in enumerate(bad)]


def test_whitening_equals_numpy(spark):
    rows = some()
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(3), "embedding", ["vec_id", "SCORE", "deviation"])
    assert found.columns == ["vec_id", "SCORE", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.toPandas()
    taken = [(i, v) for i, v, *_ in rows if v and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in taken]
    fit = sorted(set(map(tuple, whole)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 5 * len(taken) and (got.n == n).all() and got.identity_error.max() < 1e-9
    at = {x: i for i, x in enumerate(fit)}
    want = sorted((str(i), c + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums)), round(abs(centred[at[tuple(x)]] @ vectors[:, c] / values[c] ** 0.5), 7), round(values[c] / values.sum(), 9)) for (i, _), x in zip(taken, whole) for c in range(5))
    assert sorted((str(None if pd.isna(i) else int(i)), c, d, round(abs(w), 7), round(e, 9)) for i, c, d, w, e in got[["vec_id", "component", "deviation", "whitened", "explained"]].itertuples(index=False)) == want
    signs = {tuple(np.sign(g.sort_values("vec_id").whitened.round(6))) for _, g in got[got.vec_id == 299].groupby("component")}
    assert len(signs) <= 2  # repeated rows have one sign


def test_whitening_without_directions(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for rows in ([], [(1, None, "x", "y")], [(1, [1.0, 2.0], "x", "y")] * 3):
        assert whitening.whitened(frame(rows), "embedding", ["vec_id"]).collect() == []
    flat = whitening.whitened(frame([(i, [float(i), 2.0], "x", "y") for i in range(4)]), "embedding", ["vec_id"]).collect()
    assert [(r.component, round(r.explained, 6)) for r in flat] == [(1, 1.0)] * 4


def test_deviation_too_large_is_null(spark):
    found = whitening.whitened(spark.createDataFrame([(1, [0.0, 1e8]), (2, [1.0, -1e8]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<double>"), "embedding", ["vec_id"])
    assert {(r.vec_id, r.deviation is None) for r in found.collect()} == {(1, True), (2, True), (3, False)}


def brute(rows, asks, k):
    taken = sorted({(i, tuple(v)) for i, v, *_ in rows if i is not None and v and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v) and any(v)})
    ids, x = np.array([i for i, _ in taken]), np.array([v for _, v in taken])
    want = []
    for i, v in taken:
        if asks(i):
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            others = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            want += [(i, r, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(others, 1)]
    return sorted(want)


@pytest.mark.parametrize("k", [10, 250])
def test_all_leaves_equal_brute_force(spark, k):
    rows = some()
    found = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, k, recall=1.1, leaf=8)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()) == brute(rows, lambda i: i % 10 == 0, k)


def test_lists_of_bounded_length(spark):
    """More vectors than the tree saw, in leaves of several lists."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9000, 5)))]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 10 == 0, 10, recall=1.1, sample=600, leaf=400)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect()) == brute(rows, lambda i: i % 10 == 0, 10)


def test_nothing_to_search(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for rows in ([], [(100, [1.0, 2.0], "x", "y")], [(1, [1.0, 2.0], "x", "y"), (2, [1.0, 3.0], "x", "y")]):
        assert neighbours.nearest(frame(rows), F.col("vec_id") % 100 == 0).collect() == []


@needs_data
def test_recall(spark):
    got = queries.QUERIES["op13_neighbours"](spark, DATA).toPandas()
    own = pd.read_parquet(f"{DATA}/embeddings.parquet")
    x = np.stack(own.embedding).astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[own.vec_id == q][0]) ** 2).sum(1))
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 11)) and np.allclose(g.sort_values("rank").score, np.sort(g.score))
        hits += len(set(g.vec_id) & set(own.vec_id.to_numpy()[np.lexsort((own.vec_id, d))[1:11]]))
    assert len(got) == 200 and hits >= 0.9 * len(got)
