"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into short segments; the vector of their bit counts is an embedding
under which the Manhattan distance never exceeds the Hamming distance. Fingerprints within d bits
therefore lie within Manhattan distance d. The grid: segments are dealt to d + r groups, whose
counts form a cell; two vectors within distance d differ in at most d groups, so they meet in at
least one choice of r groups with equal cells. Members of a cell are compared by their Manhattan
distance first and verified by their Hamming distance.

Cells are small because the number of groups follows the number of fingerprints. A cell over
``cell_limit`` members (near copies by the thousand) isn't compared pair by pair: its fingerprints
go to an exact star join instead. For d = 3, two fingerprints are linked only if some word lies
within one bit of the one and two bits of the other; everything near such a word is chained to the
smallest fingerprint within one bit of it, which is a true link and keeps components whole.

Null and empty texts have fingerprint zero and link like any other; equal texts (also repeated
rows) share a fingerprint and a component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, buffer_of, cut, map_texts, within, without
from .graph import components

BITS = 64
#: Two bits a segment: 32 counts of 0 to 2.
SEGMENT_BITS = 2


def fingerprint_kernel(words: int = 3, seed: int = 42):
    """Function from texts to signed 64-bit fingerprints of their word shingles."""
    digest = xxhash.xxh64_intdigest

    def one(text: bytes) -> int:
        tokens = text.lower().split()
        if not tokens:
            return 0
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        n = max(1, len(tokens) - words + 1)
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        stops = (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
        total = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 15):
            h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)])), np.uint64)
            total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
        return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])

    def kernel(texts: pa.Array) -> list[pa.Array]:
        data, at = buffer_of(texts)
        raw = data.tobytes()
        return [pa.array([one(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())]

    return kernel


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """docs' kept columns and a bigint fingerprint."""
    keep = keep if keep is not None else docs.columns
    return map_texts(docs, text, keep, [T.StructField(name, T.LongType())], fingerprint_kernel, words, seed)


def group_count(n: int, distance: int) -> int:
    """Groups of segments: enough that chance meetings stay a few for each fingerprint at n of them."""
    for groups in range(distance + 3, BITS // SEGMENT_BITS):
        agreeing = groups - distance
        chance = 2.0 ** (-1.415 * (BITS // SEGMENT_BITS) * agreeing / groups)  # two bits agree in count in 3 of 8 cases
        if n * len(list(combinations(range(groups), agreeing))) * chance <= 8 or groups >= 12:
            return groups
    return groups


def _embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments, each written in unary (0, 01, 11) where its segment was.

    Two embedded vectors' Manhattan distance is then the number of bits in which they differ.
    """
    odd, half = np.uint64(0x5555555555555555), fp >> np.uint64(1)
    return ((fp | half) & odd) | ((fp & half & odd) << np.uint64(1))


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def _cells(groups: int, distance: int):
    """Function from fingerprints to cells, one for each choice of groups that must agree."""
    segment = np.arange(BITS // SEGMENT_BITS)
    mask = [np.uint64(sum(3 << (SEGMENT_BITS * int(s)) for s in segment[segment % groups == g])) for g in range(groups)]
    choices = [np.bitwise_or.reduce([mask[g] for g in c]) for c in combinations(range(groups), groups - distance)]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            counts = _embed(fp)
            for k, m in enumerate(choices):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((counts & m).view(np.int64)), pa.array(fp.view(np.int64))], names=["choice", "cell", "fp"])

    return run


def _compare(distance: int):
    """Function from cells with their members to links that hold each cell's components together."""

    def links(members: np.ndarray) -> list[tuple[int, int]]:
        fp = members.view(np.uint64)
        counts, seen, out = _embed(fp), np.zeros(len(fp), bool), []
        for first in range(len(fp)):  # breadth first: each member is compared with those not reached yet
            if seen[first]:
                continue
            seen[first], queue = True, [first]
            while queue:
                i = queue.pop()
                rest = np.flatnonzero(~seen)
                if not len(rest):
                    break
                near = rest[_manhattan(counts[rest], counts[i]) <= distance]
                near = near[np.bitwise_count(fp[near] ^ fp[i]) <= distance]
                seen[near] = True
                queue += near.tolist()
                out += [(int(members[i]), int(members[j])) for j in near]
        return out

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            size = np.diff(at)
            pairs = at[:-1][size == 2]
            a, b = values[pairs], values[pairs + 1]
            near = _manhattan(_embed(a.view(np.uint64)), _embed(b.view(np.uint64))) <= distance
            a, b = a[near], b[near]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            found = [(a[near], b[near])]
            for i in np.flatnonzero(size > 2):
                if got := links(values[at[i] : at[i + 1]]):
                    x = np.array(got, np.int64)
                    found.append((x[:, 0], x[:, 1]))
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _stars(distance: int):
    """Function from crowded fingerprints to the words near them: within one bit (near) or two (far)."""
    one = [1 << i for i in range(BITS)]
    flips = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    near = np.concatenate((np.ones(1 + BITS, bool), np.zeros(len(flips) - 1 - BITS, bool)))

    def run(batches):
        for batch in batches:
            for fp in batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array((flips ^ fp).view(np.int64)), pa.array(np.full(len(flips), fp, np.uint64).view(np.int64)), pa.array(near)], names=["word", "fp", "near"])

    return run


def link_fingerprints(fps: DataFrame, distance: int = 3, cell_limit: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp that keep every component of links within distance bits whole."""
    if distance not in (2, 3):
        raise ValueError("distance must be 2 or 3")
    fps = cut(fps.select("fp").where("fp is not null").distinct())
    groups = group_count(fps.count(), distance)
    cells = fps.mapInArrow(_cells(groups, distance), "choice int, cell bigint, fp bigint")
    # counts are written before they're joined: right above its aggregation, a cell of many fingerprints couldn't be split
    counted = cut(cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(cells.join(counted, ["choice", "cell"]).select("choice", "cell", "fp", "n"))
    lists = shared.where(F.col("n") <= cell_limit).groupBy("choice", "cell").agg(F.collect_list("fp").alias("members"))
    links = lists.select("members").mapInArrow(_compare(distance), "a bigint, b bigint")
    crowded = shared.where(F.col("n") > cell_limit).select("fp").distinct()
    words = crowded.mapInArrow(_stars(distance), "word bigint, fp bigint, near boolean")
    hubs = cut(words.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").drop("n"))
    chained = words.join(hubs, "word").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    if distance < 3:  # a hub's far neighbours may then be too far away
        chained = chained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return links.unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3, words: int = 3, seed: int = 42, cell_limit: int = 2048, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: its id, the columns named in also, fp (bigint), component_id (the smallest id reachable
    over links) and component (the smallest fingerprint reachable, which names the component itself)."""
    own = cut(fingerprints(docs, text, [doc_id, *also], "fp", words, seed))
    least = cut(own.groupBy("fp").agg(F.min(doc_id).alias("least")))
    of = components(link_fingerprints(least, distance, cell_limit))
    joined = least.join(of, least["fp"] == of["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    # written, so that the join is one of two plain shuffles, which can be split where one fingerprint has many rows
    class_of = cut(joined.select("fp", "component").join(ids, "component").select("fp", "component_id", "component"))
    return own.join(class_of, "fp").select(doc_id, *also, "fp", "component_id", "component")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Rows without an id can't stand for others and stay. Rows repeated with one id and fingerprint
    stay once; rows of one id with texts of different components are different documents.
    """
    own, name, restore = aside(docs)
    at, text = name[doc_id], name[text]
    by = F.concat_ws(":", F.col(at).cast("string"), F.xxhash64(text))
    named = own.where(F.col(at).isNotNull())
    classes = cut(near_duplicates(named.withColumn("key", by), at, text, distance, also=("key",)))
    stay = classes.groupBy("component").agg(F.min(F.struct(at, "fp")).alias("one")).select("component", F.col("one.fp").alias("stay_fp"), F.col(f"one.{at}").alias("stay_id"))
    is_one = (F.col(at) == F.col("stay_id")) & (F.col("fp") == F.col("stay_fp"))
    found = cut(classes.join(cut(stay), "component").groupBy("key", is_one.alias("stays"), at, "fp").agg(F.count("*").alias("n")))
    # rows of one id and fingerprint, with one text or several, of which one stays
    several = found.where("stays").groupBy(at, "fp").agg(F.sum("n").alias("rows"), F.collect_set("key").alias("keys")).where("rows > 1")
    repeated = cut(several.select(at, F.col("keys").getItem(0).alias("one_key"), F.explode("keys").alias("key")))
    left = without(named, found.where("not stays").select(at, "key").unionByName(repeated.select(at, "key")), by, at).unionByName(own.where(F.col(at).isNull()))
    return restore(left if repeated.isEmpty() else left.unionByName(within(named, repeated.where("key = one_key"), by, at)))
