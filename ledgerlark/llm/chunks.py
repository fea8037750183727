"""Exact de-duplication by content-defined chunk recipes.

A normalised text (A-Z lower-cased) is cut where a rolling hash of its last bytes has its low bits
zero, so equal stretches are cut alike wherever they stand. Chunks are de-duplicated to verified
identifiers: a chunk's 64-bit hash, and a variant number that tells different bytes under one hash
apart (distinct bytes are compared once, after map-side de-duplication, so a text's bytes move at
most once and copies don't move at all). A text's recipe is the ordered list of its identifiers;
texts are equal exactly when their recipes are.

Null and empty texts are equal to each other (the empty recipe). Of equal texts the largest doc_id
stays; null ids come last. Rows repeated with one id and text are one document here: all of them
carry the same decision, and ``distinct_documents`` keeps a single one. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, buffer_of, cut, map_texts, within, without

#: Smallest, mean (a power of two) and largest chunk in bytes.
SIZES = (256, 2048, 16384)
#: The rolling hash covers the last 32 bytes.
WINDOW = 32
#: Bytes hashed at once, which bounds the memory that a long text takes.
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gear(data: np.ndarray) -> np.ndarray:
    """For each byte, the hash of the WINDOW bytes that end there: h = sum of mix(byte) << age, by doubling."""
    h = np.arange(256, dtype=np.uint32)
    for _ in range(3):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(0x9E3779B9)
    h = h[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h ^ (h >> np.uint32(16))


def boundaries(data: np.ndarray, sizes: tuple[int, int, int] = SIZES) -> list[int]:
    """Ends of one text's chunks."""
    least, mean, most = sizes
    marks = []
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW)
        h = _gear(data[at - lead : at + BLOCK])[lead:]
        marks.append(np.flatnonzero((h & np.uint32(mean - 1)) == 0) + at + 1)
    out, start = [], 0
    for end in np.concatenate(marks).tolist() if marks else []:
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= least:
            out.append(end)
            start = end
    while len(data) - start > most:
        start += most
        out.append(start)
    if start < len(data):
        out.append(len(data))
    return out


def chunk_kernel(sizes: tuple[int, int, int]):
    def kernel(texts: pa.Array) -> list[pa.Array]:
        data, at = buffer_of(texts)
        data = _LOWER[data]
        raw = memoryview(data)
        digests, ends, counts = [], [0], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            digests.append(hashlib.sha256(raw[a:b]).hexdigest())
            ends += [a + x for x in boundaries(data[a:b], sizes)]
            counts.append(len(ends) - 1)
        pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(data)])
        return [pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pieces)]

    return kernel


def chunked(docs: DataFrame, text: str, keep: list[str], sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """keep, text_sha256 of the normalised text, and its chunks (array of binary)."""
    fields = [T.StructField("text_sha256", T.StringType()), T.StructField("chunks", T.ArrayType(T.BinaryType()))]
    return map_texts(docs, text, keep, fields, chunk_kernel, sizes)


def recipes(docs: DataFrame, doc_id: str, text: str, sizes: tuple[int, int, int] = SIZES, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered list of verified chunk identifiers (hash, variant).

    hash_bits under 64 shortens the hash, which tests use to make different chunks share one.
    """
    short = lambda c: F.xxhash64(c) if hash_bits == 64 else F.shiftrightunsigned(F.xxhash64(c), 64 - hash_bits)
    whole = chunked(docs, text, [doc_id], sizes)
    own = cut(whole.select(doc_id, "text_sha256", F.transform("chunks", short).alias("hashes")))
    pieces = whole.select(F.explode("chunks").alias("chunk")).select(short(F.col("chunk")).alias("hash"), "chunk").distinct()
    clashing = pieces.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    clashing = cut(clashing)
    plain = lambda c: F.transform(c, lambda h: F.struct(h.alias("hash"), F.lit(0).alias("variant")))
    if clashing.isEmpty():
        return own.select(doc_id, "text_sha256", plain("hashes").alias("recipe"))
    # Different chunks under one hash: number them, and rewrite the recipes that hold any of them.
    # A recipe depends on the text alone, so each text is rewritten once.
    rest = pieces.join(clashing, "hash", "left_semi")
    before = rest.alias("x").join(rest.alias("y"), (F.col("x.hash") == F.col("y.hash")) & (F.col("y.chunk") < F.col("x.chunk")), "left")
    variants = before.groupBy("x.hash", "x.chunk").agg(F.count("y.chunk").cast("int").alias("variant"))
    at = whole.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("hash", short(F.col("chunk"))).distinct()
    told = at.join(variants, ["hash", "chunk"]).groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "variant"))).alias("told"))
    variant = lambda i: F.coalesce(F.try_element_at("told", i), F.lit(0))
    recipe = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), variant(i).alias("variant")))
    return own.join(told, "text_sha256", "left").select(doc_id, "text_sha256", recipe.alias("recipe"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, int, int] = SIZES, hash_bits: int = 64) -> DataFrame:
    """One row for each document: its id, keep_id, group_size, kept, text_sha256."""
    own = cut(recipes(docs, doc_id, text, sizes, hash_bits))
    # Groups are written before they're joined: a join right above its aggregation can't be split where one recipe has many rows.
    groups = cut(own.groupBy("recipe").agg(F.max(doc_id).alias("keep_id"), F.count("*").alias("group_size")))
    joined = own.join(groups, "recipe")
    return joined.select(doc_id, "keep_id", "group_size", (F.col(doc_id).eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns.

    What goes is told by ids and digests alone (``without``); only rows repeated with one id and text, of which one
    stays, are brought together.
    """
    own, name, restore = aside(docs)
    at, text = name[doc_id], name[text]
    found = cut(exact_duplicates(own, at, text).groupBy(at, "text_sha256", "kept").agg(F.count("*").alias("n")))
    key = lambda digest: F.concat_ws(":", F.coalesce(F.col(at).cast("string"), F.lit("")), digest)
    by, mark = key(F.sha2(F.coalesce(lowered(text), F.lit("")), 256)), "__mark"
    marked = lambda df: df.withColumn(mark, F.coalesce(F.col(at).cast("string"), F.lit("")))
    keyed = lambda df: marked(df.select(at, key("text_sha256").alias("key")))
    repeated = cut(keyed(found.where("kept and n > 1")))
    left = without(marked(own), keyed(found.where("not kept or n > 1")), by, mark)
    return restore(left if repeated.isEmpty() else left.unionByName(within(marked(own), repeated, by, mark)))


def lowered(text: str) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(f"`{text}`").cast("string"), upper, upper.lower())
