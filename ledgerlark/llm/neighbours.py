"""Approximate nearest neighbours by a hierarchical k-means tree.

Rows whose vector is null, empty or zero, or holds null or non-finite entries, take no part; neither do
rows without an id and rows of another length than the most frequent one. Equal vectors are searched
once: each distinct vector carries the ``k + 1`` smallest of its ids, which is all that a list of ``k``
nearest can show of it, ties going to smaller ids.

The tree is fitted in one task on a sample of distinct vectors, those with the smallest hashes
(``SAMPLE`` expected at most; all, if there are fewer). A node that stands for more than ``LEAF`` vectors, and has
over ``FEWEST`` of the sample, is split by k-means into ``BRANCHES`` children, so dense places are split further;
the tree's size follows from the sample's and is broadcast. Every distinct vector goes down to its nearest leaf. A query walks the tree best bin
first: a priority queue holds nodes by the distance to their centre, the nearest is opened, leaves are
visited in the order in which they come up. How many are visited is calibrated: the neighbours of up to
``PROBES`` query vectors are found exactly, by comparing them with all vectors in blocks, and the number of
visits is widened by a quarter until the visited leaves hold ``recall`` of those neighbours; at its end stand all leaves,
which is exact.

Vectors of a leaf and the queries that visit it are put together in lists of bounded length that meet
by leaf, so a leaf with very many of both is still worked on by many tasks. Distances are Euclidean, in
double precision, on the original vectors.

An empty table, or one without queries, gives no rows; a query without any other vector gives none.
Rows repeated with the same id and vector count once.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Packed, cut, kept_in_worker, short_batches
from .whitening import is_whole, of_one_length

#: Vectors that the tree is fitted on at most, on average over hashes.
SAMPLE = 131_072
LEAF, FEWEST, BRANCHES, ROUNDS = 512, 32, 16, 8
#: Query vectors that the number of visits is calibrated with, and the share of their neighbours that must be found.
PROBES, RECALL = 200, 0.95
#: Vectors and queries of one list.
TOGETHER, ASKED = 2048, 512


class Tree:
    """Nodes with their centres and children; the children of a node follow one another."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, rounds: int = ROUNDS):
        rng = np.random.default_rng(7)
        self.centre, self.first, self.number = [x.mean(0)], [0], [0]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            centres, nearest = split(x[own], branches, rounds, rng)
            if len(centres) < 2:
                continue
            self.first[node], self.number[node] = len(self.centre), len(centres)
            for k, c in enumerate(centres):
                todo.append((len(self.centre), own[nearest == k]))
                self.centre.append(c)
                self.first.append(0)
                self.number.append(0)
        self.centre, self.first, self.number = np.array(self.centre), np.array(self.first), np.array(self.number)

    @property
    def leaves(self) -> int:
        return int((self.number == 0).sum())

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each vector ends in, going to the nearest centre at every level."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x)) if self.number[0] else np.zeros(0, np.int64)
        while len(moving):
            moving = moving[np.argsort(at[moving], kind="stable")]
            nodes, starts = np.unique(at[moving], return_index=True)
            for node, own in zip(nodes.tolist(), np.split(moving, starts[1:])):
                at[own] = self.first[node] + squares(x[own], self.children(node)).argmin(1)
            moving = moving[self.number[at[moving]] > 0]
        return at

    def children(self, node: int) -> np.ndarray:
        return self.centre[self.first[node] : self.first[node] + self.number[node]]

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.number[node] == 0:
                yield node
                continue
            away = self.children(node) - q
            for k, d in enumerate(np.einsum("ij,ij->i", away, away).tolist()):
                heapq.heappush(queue, (d, int(self.first[node]) + k))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y, but for rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def split(x: np.ndarray, branches: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres that k-means comes to, without empty ones, and the centre of each row."""
    centres = x[rng.choice(len(x), branches, replace=False)] if len(x) > branches else x
    for _ in range(rounds):
        nearest = squares(x, centres).argmin(1)
        kinds, nearest = np.unique(nearest, return_inverse=True)
        count = np.bincount(nearest)
        order = np.argsort(nearest, kind="stable")
        centres = np.add.reduceat(x[order], np.cumsum(count) - count) / count[:, None]
    return centres, nearest


def best_of(q: np.ndarray, x: np.ndarray, first_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of x for each of q, ties to the smaller first id: query, row, distance.

    Products find the candidates, with all that rounding could have put behind them; their distances are then taken from the differences.
    """
    near = squares(q, x)
    bound = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    query, row = np.nonzero(near <= (bound + slack)[:, None])
    distance = np.sqrt(((q[query] - x[row]) ** 2).sum(1))
    order = np.lexsort((first_id[row], distance, query))
    query, row, distance = query[order], row[order], distance[order]
    start = np.searchsorted(query, np.arange(len(q)))
    kept = np.arange(len(query)) - start[query] < k
    return query[kept], row[kept], distance[kept]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vid, v and the k + 1 smallest ids of each vector, written. Each task passes on so many rows of a vector at most."""
    by = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    return cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.monotonically_increasing_id()))


def fitted(vectors: DataFrame, n: int, width: int, size: int, leaf: int) -> Tree:
    """A tree over a sample of vectors, fitted in one task."""
    share = min(1.0, size / max(n, 1))
    sample = vectors.select("v").where(F.xxhash64("v").bitwiseAND((1 << 31) - 1) < int(share * (1 << 31))) if share < 1 else vectors.select("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [matrix(b.column(0), width) for b in batches]
        if own:
            x = np.concatenate(own)
            tree = Tree(x[np.lexsort(x.T[::-1])], max(FEWEST, int(leaf * share)) if share < 1 else leaf)  # in an order of its own, so that the tree doesn't depend on how rows come
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], names=["tree"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "tree binary").first()["tree"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other rows of each row for which is_query holds."""
    spark = vectors.sparkSession
    short_batches(spark)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & is_whole(F.col("v")) & F.exists("v", lambda c: c != 0))
    rows, width = of_one_length(rows, "v")
    own = distinct_vectors(rows.select("id", "v"), k)
    n = own.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = rows.where("asks").select("id", "v").distinct()
    queries = cut(asked.join(own.select("v", "vid"), "v").select("id", "vid"))
    packed = Packed(spark, fitted(own, n, width, sample, leaf))
    tree = pickle.loads(packed.packed.value)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = kept_in_worker(packed.id, lambda: pickle.loads(packed.packed.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(here.leaf_of(matrix(batch.column(1), width)))], names=[*batch.schema.names, "leaf"])

    placed = cut(own.select("vid", "v", "ids").mapInArrow(leaves, "vid bigint, v array<double>, ids array<bigint>, leaf bigint"))
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf of the broadcast tree
    searched = cut(own.select("vid", "v").join(queries.select("vid").distinct(), "vid"))
    most = visits_for(placed, searched, tree, width, k, recall, counts)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = kept_in_worker(packed.id, lambda: pickle.loads(packed.packed.value))
        for batch in batches:
            found = [list(enough(here, q, most, k, counts)) for q in matrix(batch.column(1), width)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), list(map(len, found))))
            yield pa.RecordBatch.from_arrays([pa.array([x for own in found for x in own], pa.int64()), *[c.take(at) for c in batch.columns]], names=["leaf", "q", "qv"])

    asks = searched.mapInArrow(visited, "leaf bigint, q bigint, qv array<double>")
    parts = spark.createDataFrame([(leaf, -(-count // TOGETHER)) for leaf, count in counts.items()], "leaf bigint, parts bigint")
    part = F.pmod(F.xxhash64("vid"), "parts").alias("part")
    lists = cut(placed.join(F.broadcast(parts), "leaf").groupBy("leaf", part).agg(F.collect_list(F.struct("ids", "v")).alias("rows")))
    # were all queries to visit one leaf, they would make so many lists of bounded length
    group = F.pmod(F.xxhash64("q"), F.lit(-(-searched.count() // ASKED))).alias("group")
    held = cut(asks.groupBy("leaf", group).agg(F.collect_list(F.struct("q", "qv")).alias("queries")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, asking = batch.column(0)[i].values, batch.column(1)[i].values
                ids = mine.field("ids")
                first = ids.flatten().to_numpy()[np.concatenate(([0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())[:-1]))]
                query, row, distance = best_of(matrix(asking.field("qv"), width), matrix(mine.field("v"), width), first, k + 1)
                yield pa.RecordBatch.from_arrays([asking.field("q").take(pa.array(query)), pa.array(distance), ids.take(pa.array(row))], names=["q", "score", "ids"])

    found = lists.join(held, "leaf").select("rows", "queries").mapInArrow(search, "q bigint, score double, ids array<bigint>")
    by = Window.partitionBy("q").orderBy("score", F.col("ids")[0])
    few = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1).select("q", "score", F.explode("ids").alias("id"))
    best = cut(few.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k + 1).alias("best")))
    others = queries.join(best, F.col("vid") == F.col("q")).select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    shown = others.select("query_id", F.posexplode("best").alias("at", "b"))
    return shown.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def enough(tree: Tree, q: np.ndarray, most: int, k: int, counts: dict[int, int]) -> Iterator[int]:
    """The first leaves of a query, and more until they hold k vectors besides its own."""
    held = 0
    for i, leaf in enumerate(tree.visits(q)):
        if i >= most and held > k:
            return
        held += counts.get(leaf, 0)
        if leaf in counts:
            yield leaf


def visits_for(placed: DataFrame, searched: DataFrame, tree: Tree, width: int, k: int, recall: float, counts: dict[int, int]) -> int:
    """The number of leaf visits, widened by a quarter at a time, that finds the asked share of the probes' exact neighbours; all leaves, if none does."""
    probes = searched.select("vid", "v").orderBy(F.xxhash64("v"), "vid").limit(PROBES).collect()
    if not probes:
        return 0
    ids, q = np.array([r["vid"] for r in probes]), np.array([r["v"] for r in probes])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
        for batch in batches:
            vid, leaf = (batch.column(i).to_numpy() for i in (0, 2))
            query, row, distance = best_of(q, matrix(batch.column(1), width), vid, k + 1)
            best = [np.concatenate(x) for x in zip(best, (query, distance, vid[row], leaf[row]))]
            order = np.lexsort((best[2], best[1], best[0]))
            best = [x[order] for x in best]
            kept = np.arange(len(order)) - np.searchsorted(best[0], best[0]) <= k
            best = [x[kept] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(best[0].astype(np.int32)), *map(pa.array, best[1:])], names=["probe", "score", "vid", "leaf"])

    found = placed.select("vid", "v", "leaf").mapInArrow(exact, "probe int, score double, vid bigint, leaf bigint")
    by = Window.partitionBy("probe").orderBy("score", "vid")
    truth = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1).select("probe", "vid", "leaf").collect()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(x))} for x in q]
    ranks = np.array([order[r["probe"]][r["leaf"]] for r in truth if r["vid"] != ids[r["probe"]]], np.int64)
    most = 1
    while most < tree.leaves and len(ranks) and (ranks < most).mean() < recall:
        most += -(-most // 4)
    return min(most, tree.leaves)
