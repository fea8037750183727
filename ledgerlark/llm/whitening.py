"""Embedding whitening with distributed block matrices.

Rows whose vector is null or empty, or holds null or non-finite entries, are left out; so are those of
another length than the most frequent one (of equally frequent lengths the longer). Entries become whole
numbers ``floor(64 * c) + 1000000``. The fit list has each distinct whole vector once, so copies neither
weigh more nor move more. Its rows, centred, are indexed and laid out in blocks of a BlockMatrix; its
transpose times itself is the scatter, whose rows of blocks are multiplied in as many parts as the table
has partitions. The driver gets one square matrix of the dimensions and takes its eigenvectors; the rows
times those over the root of their eigenvalue, again as BlockMatrices, are the whitened rows, which go
back to every row with that vector.

Sums are whole numbers, so deviations are exact; one that 64 bits can't hold is null. Components whose
eigenvalue is no more than 1e-12 of the trace have no direction and are left out, so a fit list of one
vector gives no rows. Rows repeated, or without an id, each have their own result; an empty table gives
none. Columns in ``keep`` that are called like a computed one give way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT = 64, 1_000_000
#: Rows of a block; its columns are all dimensions.
BLOCK_ROWS = 1024
COMPONENTS = 16
COMPUTED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: Share of the trace below which a component has no direction.
LEAST = 1e-12


def is_whole(vector: Column) -> Column:
    """Whether a vector has entries, and all of them are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length, and that length; 0 if there are no rows."""
    length = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return (rows.where(F.size(vector) == length["length"]), length["length"]) if length else (rows, 0)


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows, written, with an index from 0 without gaps, and their number. Only one count for each partition is collected."""
    marked = cut(rows.withColumn("mark", F.monotonically_increasing_id()))
    part = F.shiftright("mark", 33)
    counts = sorted(map(tuple, marked.groupBy(part.alias("part")).count().collect()))
    first, n = [], 0
    for _, count in counts:
        first.append(n)
        n += count
    if not counts:
        return marked.withColumnRenamed("mark", "index"), 0
    before = F.create_map(*[F.lit(x) for (p, _), at in zip(counts, first) for x in (p, at)])
    return marked.withColumn("index", before[part] + F.col("mark").bitwiseAND((1 << 33) - 1)).drop("mark"), n


def product(left: BlockMatrix, right: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """left x right, the inner dimension multiplied in so many parts that are added up."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def blocks_of(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """A BlockMatrix from rows with columns index and centred."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, width)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """index and values of a BlockMatrix's rows, without leaving the JVM."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, their shares of the trace, and the whitening matrix."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors, trace = values[::-1], vectors[:, ::-1], values.sum()
    kept = np.flatnonzero(values > LEAST * max(trace, 0))[:most] if trace > 0 else np.zeros(0, int)
    return values[kept], values[kept] / (trace or 1), vectors[:, kept] / np.sqrt(values[kept])


def identity_error(rows: DataFrame, width: int, n: int) -> float:
    """The largest absolute entry of the covariance of values minus the identity."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    v = F.col("values")
    sums = rows.agg(*[F.sum(v[i]).alias(f"s{i}") for i in range(width)], *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"p{i}_{j}"] / n - sums[f"s{i}"] / n * sums[f"s{j}"] / n - (i == j)) for i, j in pairs)


def whitened(vectors: DataFrame, vector: str, keep: list[str], most: int = COMPONENTS) -> DataFrame:
    """keep, then component, n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    spark = vectors.sparkSession
    keep = [c for c in keep if c.lower() not in COMPUTED]
    own = vectors.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{vector}`").cast("array<double>").alias("v"))
    own, width = of_one_length(own.where(is_whole(F.col("v"))), "v")
    own = own.withColumn("x", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)).drop("v")
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    nothing = own.limit(0).select(*names, *[F.lit(None).cast(t).alias(c) for c, t in zip(COMPUTED, ("int", "bigint", "bigint", "double", "double", "double"))])
    if not width:
        return nothing
    fit, n = indexed(own.select("x").distinct())
    sums = list(fit.agg(*[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first())
    apart = lambda x: F.zip_with(x, F.array(*[F.lit(s) for s in sums]), lambda a, s: a * F.lit(n).cast("bigint") - s)
    fit = fit.withColumn("apart", apart(F.col("x")))
    matrix = blocks_of(fit.select("index", F.transform("apart", lambda a: a.cast("double") / n).alias("centred")), n, width)
    parts = max(1, min(-(-n // BLOCK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    values, explained, matrix_of = components(product(matrix.transpose(), matrix, parts).toLocalMatrix().toArray(), n, most)
    if not len(values):
        return nothing
    by = spark.sparkContext.parallelize([((0, 0), DenseMatrix(*matrix_of.shape, matrix_of.ravel(order="F")))], 1)
    found = cut(rows_of(product(matrix, BlockMatrix(by, width, len(values), *matrix_of.shape))))
    error = identity_error(found, len(values), n)
    deviation = F.aggregate("apart", F.lit(0).cast("bigint"), lambda total, a: F.try_add(total, F.try_multiply(a, a)))
    by_vector = fit.select("index", "x", deviation.alias("deviation")).join(found, "index").drop("index")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return (
        own.join(by_vector, "x").select(*names, "deviation", F.posexplode("values").alias("at", "whitened"))
        .select(*keep, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
    )
