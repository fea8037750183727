"""What the text operators share: Arrow mapping of whole texts, folds, and lineage cuts.

Defined results for all operators here: a null text counts as an empty one, extra columns pass
through or are ignored, and a text is always processed whole, however long it is.
"""

from __future__ import annotations

import gc
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut, is_written, removed, scratch, shared_dir  # noqa: F401

#: Bytes of text handed to a kernel at once; one longer text forms a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows and bytes of an Arrow batch: whole texts can be long, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id's text, modulo parts: the fold that a document belongs to."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small in rows and bytes; smaller settings of its own stay.

    The size is read when a plan runs, so it can't be set for one plan alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower()).groups()
        if not 0 < int(number) << (10 * " kmgt".index(unit or " ")) <= most:
            spark.conf.set(name, str(most))


_KEPT: dict = {}


def kept_in_worker(key, make: Callable):
    """What a Python worker keeps from task to task: the state of one operator, of one model. Another key takes its place."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


#: Bits of the filter that tells rows that may be meant: 16 MB at most, in bitmaps of 4 KB.
FILTER_BITS, BITMAP_BITS = 1 << 27, 1 << 15


def met(docs: DataFrame, keys: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose mark isn't among those of keys, and all others with a few that only share its place in a filter.

    The filter has one bit for each place of a hash, so its size is bounded; it is broadcast and nothing moves. More keys
    leave more rows to the second part, never fewer. Null marks are in no keys.
    """
    place = F.xxhash64(F.col(f"`{mark}`").cast("string")).bitwiseAND(FILTER_BITS - 1)
    bucket, pos = (place / BITMAP_BITS).cast("int"), place % BITMAP_BITS
    bits = keys.where(F.col(f"`{mark}`").isNotNull()).select(bucket.alias("__bucket"), pos.alias("__pos")).groupBy("__bucket").agg(F.bitmap_construct_agg("__pos").alias("__bits"))
    here = docs.withColumn("__bucket", F.when(F.col(f"`{mark}`").isNotNull(), bucket)).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    is_met = F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))
    return here.where(~is_met).select(*docs.columns), here.where(is_met).select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, by: Column, mark: str) -> DataFrame:
    """docs but for the rows whose key (by) is in gone (mark, key). Only rows whose mark may be in gone are keyed and moved."""
    gone = cut(gone.select(mark, "key").distinct())
    stay, maybe = met(docs, gone, mark)
    return stay.unionByName(maybe.withColumn("__key", by).join(gone.select(F.col("key").alias("__key")), "__key", "left_anti").select(*docs.columns))


def within(docs: DataFrame, wanted: DataFrame, by: Column, mark: str) -> DataFrame:
    """One of the rows of docs for each key (by) in wanted (mark, key)."""
    wanted = cut(wanted.select(mark, "key").distinct())
    return met(docs, wanted, mark)[1].withColumn("__key", by).join(wanted.select(F.col("key").alias("__key")), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a null-free string array as one vector, and the offsets of its texts in it."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, at - at[0]


def starts_of(size: np.ndarray) -> np.ndarray:
    """Where parts of these sizes start, laid one after the other."""
    return np.cumsum(size) - size


def inside(size: np.ndarray) -> np.ndarray:
    """For parts of these sizes, laid one after the other, the place of each element in its part."""
    return np.arange(int(size.sum())) - np.repeat(starts_of(size), size)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Packed:
    """A model on its way to the executors; its id tells workers whether they have it."""

    def __init__(self, spark: SparkSession, model):
        self.id, self.packed = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(model))


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], make: Callable, *args) -> DataFrame:
    """Append columns computed from a text column, slice by slice, without a shuffle.

    keep: columns that stay; a computed column takes the place of one of its name. make(*args) runs once a task and returns a function from a null-free
    string array to one Arrow array for each of fields. Broadcasts may be among args.
    """
    spark = df.sparkSession
    short_batches(spark)
    computed = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in computed]
    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].cast("string").alias("__text"))
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make(*args)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                found = kernel(pc.fill_null(part.column(part.num_columns - 1), ""))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], names=names)

    return source.mapInArrow(run, schema)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs with its columns renamed to c0, c1 ... so that no computed name can clash with one; the new
    name of each; and a function that takes these columns alone and gives them their names back."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*names.values())
    return renamed, names, lambda df: df.select(*[F.col(new).alias(old) for old, new in names.items()])
