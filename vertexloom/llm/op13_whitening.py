"""Whitening of embeddings with distributed block matrices.

Components become whole numbers, so counts, sums and deviations are exact. Each distinct vector counts
once for the fit: its first row, by a number that all rows get. Rows less their mean are a
``BlockMatrix`` of row blocks; its transpose times itself is the scatter matrix, a few numbers a
dimension. Its eigenvectors, found on the driver, over the roots of their eigenvalues are the whitening
matrix, by which the block matrix of all rows is multiplied. Rows that do not count for the fit are
zero in the first product.

A block product sends what it needs to the partition of its result, and the scatter matrix is one
block. The middle dimension therefore is split, so that a task gets a bounded number of row blocks and
gives one partial sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.op12_exact_topk import whole
from vertexloom.operators.ordering import running
from vertexloom.session import cut, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block, and row blocks that one task multiplies for the scatter matrix.
ROWS, MIDDLE = 1024, 16
#: Whole numbers are clipped to this on both sides before the shift.
LARGEST = 1 << 40
#: Eigenvalues up to this part of the largest one are taken for zero.
RANK = 1e-12
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``(vec_id, x)``: scaled, floored and shifted components of the rows that have finite ones only."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole(F.col("v")))

    def put(c: Column) -> Column:
        return F.greatest(F.least(F.floor(c * scale), F.lit(LARGEST)), F.lit(-LARGEST)) + shift

    return own.select("vec_id", F.transform("v", put).alias("x"))


def _filled(x: Column, dim: int, zero: int) -> Column:
    """Shorter vectors with the number of a zero at the end."""
    return F.when(F.size(x) == dim, x).otherwise(F.concat(x, F.array_repeat(F.lit(zero).cast("long"), F.greatest(F.lit(dim) - F.size(x), F.lit(0)))))


def _blocks(rows: DataFrame, x: Column, mean: list[Fraction], count: int) -> BlockMatrix:
    """Rows ``row`` less the mean as blocks; what is taken off first is whole, so little is lost."""
    base = [int(m // 1) for m in mean]
    rest = [float(m - b) for m, b in zip(mean, base)]
    centred = F.zip_with(F.zip_with(x, F.lit(base).cast("array<long>"), lambda a, b: (a - b).cast("double")), F.lit(rest), lambda a, r: a - r)
    vectors = rows.select(F.col("row").alias("index"), array_to_vector(centred).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, len(mean)).toBlockMatrix(ROWS, max(len(mean), 1))


def scatter(fit: BlockMatrix) -> np.ndarray:
    """The product of the transposed matrix with the matrix; of a number for each pair of columns."""
    splits = -(-fit.numRowBlocks // MIDDLE)
    java = fit.transpose()._java_matrix_wrapper.call("multiply", fit._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, fit.colsPerBlock, fit.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues over zero and their unit vectors as columns, by falling eigenvalue, ``most`` at the most."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > max(values[0], 0.0) * RANK).sum()) if len(values) else 0)
    return values[:keep], vectors[:, :keep]


def _projected(rows: BlockMatrix, by: np.ndarray, spark: SparkSession) -> DataFrame:
    """``(row, w)``: every row times the matrix."""
    matrix = Matrices.dense(by.shape[0], by.shape[1], by.flatten(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), matrix)], 1), by.shape[0], by.shape[1])
    given = rows.multiply(right).blocks.map(lambda b: (b[0][0], b[1].toArray().tolist()))
    found = spark.createDataFrame(given, "block long, ws array<array<double>>")
    return found.select("block", F.posexplode("ws").alias("at", "w")).select((F.col("block") * ROWS + F.col("at")).alias("row"), "w")


def _identity_error(fit: DataFrame, k: int) -> float:
    """Largest entry, by size, of the covariance of ``w`` less the identity; centred before it is multiplied."""
    means = fit.select(*[F.avg(F.get("w", F.lit(i))) for i in range(k)]).first()
    centre = np.array(list(means))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, k)), 0
        for frame in frames:
            if len(frame):
                w = np.stack(frame["w"].to_numpy()) - centre
                total, n = total + w.T @ w, n + len(w)
        if n:
            i, j = np.indices((k, k))
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": n, "total": total.ravel()})

    sums = fit.select("w").mapInPandas(partial, "i int, j int, n long, total double").groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("c"))
    off = F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.agg(F.max(off)).first()[0]


def _deviation(x: Column, n: int, sums: list[int]) -> Column:
    """The exact sum of (n * x - S)^2; null if it is no long."""
    wide = max((abs(s) for s in sums), default=0) + n * (LARGEST + SHIFT)

    @F.pandas_udf("long")
    def deviation(given: pd.Series) -> pd.Series:
        if not len(given):
            return pd.Series([], dtype="Int64")
        own = np.stack(given.to_numpy()).astype(np.int64)
        spread = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(own.min(axis=0), own.max(axis=0), sums)), default=0)
        if wide < 1 << 63 and spread * spread * max(len(sums), 1) < 1 << 63:
            return pd.Series(((n * own - np.array(sums, np.int64)) ** 2).sum(axis=1), dtype="Int64")
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in own]
        return pd.Series([e if e < 1 << 63 else None for e in exact], dtype="Int64")

    return deviation(x)


def whiten(rows: DataFrame, id_col: str, vector_col: str, most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: up to ``most`` components of each row.

    Components of a vector become ``floor(scale * c) + shift``. ``n`` distinct vectors are the fit list,
    of which mean and covariance are. Components go from 1 by falling eigenvalue; those whose eigenvalue
    is zero have no whitened value and are left out, so one distinct vector alone gives no rows. Rows
    with null vectors and with null or non-finite components are dropped; shorter vectors are filled with
    the number of a zero; numbers over 2^40 are clipped. Null ids and repeated rows stay, each with its own
    result. A deviation that is no long is null. An empty table gives no rows, other columns are not read.
    """
    spark = rows.sparkSession
    given = whole_numbers(rows, id_col, vector_col, scale, shift)
    dim = given.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], OUTPUT)
    given = given.select("vec_id", _filled(F.col("x"), dim, shift).alias("x"))
    numbered = cut(running(given, ["vec_id", "x"], "row"))
    count = numbered.count()
    fit = cut(numbered.groupBy("x").agg(F.min("row").alias("row")))
    sums = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    told = sorted(sums.collect())  # a row per dimension
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    mean = [Fraction(s, n) for s in sums]
    all_rows = _blocks(numbered, F.col("x"), mean, count).persist(StorageLevel.MEMORY_AND_DISK)
    # Without copies all rows are the fit list, and their blocks are its blocks.
    fit_rows = all_rows if n == count else _blocks(fit, F.col("x"), mean, count).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        covariance = scatter(fit_rows) / n
        values, vectors = components(covariance, most)
        trace, k = float(np.trace(covariance)), len(values)
        if not k:
            return spark.createDataFrame([], OUTPUT)
        projected = _projected(all_rows, vectors / np.sqrt(values), spark)
        own = numbered.join(fit.select("row", F.lit(True).alias("fits")), "row", "left")
        own = own.select("row", "vec_id", F.coalesce("fits", F.lit(False)).alias("fits"), _deviation(F.col("x"), n, sums).alias("deviation"))
        found = cut(own.join(projected, "row").select("vec_id", "fits", "deviation", "w"))
    finally:
        for matrix in (all_rows, fit_rows):
            matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    error = _identity_error(found.where("fits"), k)
    explained = F.element_at(F.lit([float(v) / trace for v in values]), F.col("component"))
    flat = found.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return flat.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
