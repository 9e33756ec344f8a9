"""Whitening of vectors: projections on the components of their covariance, over the root of its eigenvalues.

Entries become integers first, x = floor(scale * c) + shift, so sums S over the n distinct vectors are exact, and so is
n * x - S: rows are centred by one rounding, before anything is multiplied. MLlib's computeSVD of the centred rows gives
the components and singular values s; asked for all dimensions it decomposes the rows' Gramian with LAPACK, in double
precision, and the eigenvalues of the covariance are s^2 / n. The total variance doesn't come from it: it is the sum of
all exact squared deviations, over n^3.

Equal vectors count once in the fit, however often they stand in the table; partial aggregation folds them before the
shuffle. What the driver and each task hold is bounded by the dimensions (their square, 8 MB for 1000), not by rows.

Vectors that are null, hold null or non-finite entries, or entries too large for the integers (2^53 after scaling), take no
part; nor do those of another length than most, of equally frequent lengths the smaller. Repeated rows and ids keep their
own entries; a null id stays null. Components without variance (up to rounding) can't be whitened and are left out, so a
table of one distinct vector, like an empty one, has none. Only the id and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import lean, table, written

SCALE, SHIFT = 64, 1_000_000


@dataclass
class Whitening:
    """A fit; its size is bounded by the dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    total: float  # the trace of the covariance
    identity_error: float = 0.0


def integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector's entries as longs, or null if it takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & (F.abs(e * scale) < 2.0**53))  # NaN is larger than all numbers
    return F.when(v.isNotNull() & fine, F.transform(v, lambda e: F.floor(e * scale) + F.lit(shift).cast("long")))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where their squares' sum fits, else Python's."""
    dims = max(1, len(sums))
    largest = max(1, int(np.abs(x).max(initial=0)), *(abs(s) // n + 1 for s in sums))
    if 2 * n * largest < 2**62:
        d = n * x - np.array(sums, np.int64)
        if dims * int(np.abs(d).max(initial=0)) ** 2 < 2**63:
            return d
        return d.astype(object)
    return n * x.astype(object) - np.array(sums, object)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _summed(rows: DataFrame, column: str, dims: int, of) -> list:
    """of(matrix), numbers in an array, added over all rows: first within tasks, then over tasks. Python's integers stay exact."""

    def run(batches):
        total = 0
        for b in batches:
            total = total + of(_matrix(b.column(0), dims))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), kind)], ["at", "v"])

    exact = rows.schema[column].dataType.simpleString() == "array<bigint>"
    kind, name = (pa.decimal128(38), "decimal(38,0)") if exact else (pa.float64(), "double")
    parts = rows.select(column).mapInArrow(lean(run), f"at long, v {name}").groupBy("at").agg(F.sum("v").alias("v"))
    return [v for _, v in sorted(tuple(r) for r in parts.collect())]


def fit(vectors: DataFrame, k: int = 16) -> Whitening | None:
    """The fit over the distinct vectors of x (array<long>, one length); None if nothing varies."""
    spark = vectors.sparkSession
    each = written(vectors.select("x").distinct())
    dims = each.select(F.size("x")).head()
    if dims is None or not dims[0]:
        return None
    dims = dims[0]
    n, sums = each.count(), [int(s) for s in _summed(each, "x", dims, lambda x: x.sum(0, dtype=object))]

    def centred(batches):
        for b in batches:
            d = _deviations(_matrix(b.column(0), dims), n, sums)
            squares = [int(s) for s in (d * d).sum(1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(d.astype(np.float64) / n), pa.list_(pa.float64())), pa.array(squares, pa.decimal128(38))], ["c", "deviation"])

    rows = written(each.mapInArrow(lean(centred), "c array<double>, deviation decimal(38,0)"))
    total = int(rows.agg(F.sum("deviation")).head()[0]) / n**3
    if not total:
        return None
    # All dimensions are asked for: a few of them would be found by ARPACK, to its tolerance.
    matrix = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c")
    svd = RowMatrix(matrix, n, dims).computeSVD(dims)
    values = np.asarray(svd.s.toArray()) ** 2 / n
    good = min(k, int((values > values[0] * dims * np.finfo(float).eps).sum()))
    made = Whitening(n, sums, np.asarray(svd.V.toArray())[:, :good], values[:good], total)
    made.identity_error = _identity_error(rows, made)
    return made


def _identity_error(rows: DataFrame, made: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity: a Gramian of each task's rows, summed."""
    turn, k = made.components / np.sqrt(made.eigenvalues), len(made.eigenvalues)

    def products(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    flat = np.array(_summed(rows, "c", len(made.sums), products)) / made.n  # k * k + k numbers
    mean = flat[k * k :]
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None]:
    """vec_id, deviation (decimal: the sum over dimensions of (n * x - S)^2) and whitened (an array with at most k entries) of
    each row that takes part, and the fit. No rows if there is no fit."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), integers(F.col(f"`{vector}`"), scale, shift).alias("x")).where("x IS NOT NULL")
    kept = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kept}, deviation decimal(38,0), whitened array<double>"
    most = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").head()
    if most is None:
        return spark.createDataFrame([], schema), None
    rows = rows.where(F.size("x") == most["dims"])
    made = fit(rows, k)
    if made is None:
        return spark.createDataFrame([], schema), None
    shared = spark.sparkContext.broadcast((made.n, made.sums, made.components / np.sqrt(made.eigenvalues)))

    def run(batches):
        n, sums, turn = shared.value
        for b in batches:
            d = _deviations(_matrix(b.column(1), len(sums)), n, sums)
            w = (d.astype(np.float64) / n) @ turn
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(s) for s in (d * d).sum(1)], pa.decimal128(38)), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(lean(run), schema), made


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation beyond a long, which takes millions of vectors, is null here and whole in
    the operator's decimal."""
    found, made = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e / made.total)) for e in made.eigenvalues]) if made else F.array().cast("array<double>")
    n, error = (made.n, made.identity_error) if made else (0, 0.0)
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
