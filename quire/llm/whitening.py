"""Whitening of embeddings by the covariance of distinct vectors, weighted by how often each occurs.

Equal integer vectors are one row with its multiplicity before anything is multiplied: each
task centres its distinct vectors, multiplies them by their weights and by themselves in one
matrix product, and gives its sums to Spark, which adds them up. Each distinct vector is then
whitened once, and the rows are joined back to theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_vectors, matrix, path_of, remove, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers stop here, which entries beyond sixteen million alone reach.
MOST = 1 << 30
#: Eigenvalues below this share of the largest are rounding errors of directions without any spread.
NO_SPREAD = 1e-12
Read = Callable[[pa.RecordBatch], np.ndarray]


def added(rows: DataFrame, columns: list[str], one: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all batches of one(batch), of `size` numbers: a task adds up its batches, Spark the tasks."""
    dtype, arrow = (np.int64, pa.int64()) if kind == "long" else (np.float64, pa.float64())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for b in it:
            if len(b):
                total += one(b)
        yield pa.record_batch([pa.array(np.arange(size), pa.int64()), pa.array(total, arrow)], names=["at", "s"])

    out = np.zeros(size, dtype)
    for r in rows.select(*columns).mapInArrow(run, f"at long, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r.s
    return out


def weights(b: pa.RecordBatch) -> np.ndarray:
    return b.column(1).to_numpy()


def weighted_covariance(rows: DataFrame, column: str, read: Read, dim: int, mean: np.ndarray, n: int) -> np.ndarray:
    """Of rows(column, weight): sum of weight * (v - mean)(v - mean)' over n, centred before multiplying."""

    def gemm(b: pa.RecordBatch) -> np.ndarray:
        v = read(b) - mean
        return ((v * weights(b)[:, None]).T @ v).ravel()

    c = added(rows, [column, "weight"], gemm, dim * dim, "double").reshape(dim, dim) / n
    return (c + c.T) / 2


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2; None where that is beyond 64 bits."""
    far = max(abs(n * int(f(x[:, j])) - int(s)) for j, s in enumerate(sums.tolist()) for f in (np.min, np.max))
    if far * far * x.shape[1] < 1 << 63:
        return ((n * x - sums) ** 2).sum(1).tolist()  # within 64 bits although n * x and S may wrap, as their difference does not
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def spectrum(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, falling, their unit vectors as columns (largest entry positive), and the trace."""
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    top = u[np.abs(u).argmax(0), np.arange(u.shape[1])]
    return e, u * np.where(top < 0, -1.0, 1.0), float(np.trace(cov))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, by_count: bool = True) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error.

    by_count: distinct vectors weigh as often as they occur, else one each; the covariance is over these weights.
    The driver sees sums alone: as many numbers as an entry squared. Defined cases: null, non-finite and odd vectors as
    in integer_vectors(); each row counts, of repeated ids too; directions without any spread have whitened and explained 0, and
    count as 1 in identity_error; a deviation beyond 64 bits is null; an empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dim = integer_vectors(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), scale, offset, MOST, ["vec_id"])
    if not dim:
        return spark.createDataFrame([], schema)
    rows = written(rows, "integers")
    weight = F.count("*") if by_count else F.lit(1).cast("long")
    distinct = written(rows.groupBy("x").agg(weight.alias("weight")), "distinct")

    def integers(b: pa.RecordBatch) -> np.ndarray:
        return matrix(b.column(0), dim)

    sums = added(distinct, ["x", "weight"], lambda b: np.append(weights(b) @ integers(b), weights(b).sum()), dim + 1, "long")
    n, sums = int(sums[-1]), sums[:-1]
    mean = sums / n
    cov = weighted_covariance(distinct, "x", integers, dim, mean, n)
    e, u, trace = spectrum(cov, min(components, dim))
    flat = e <= NO_SPREAD * max(e[0], 0) if e[0] > 0 else np.ones(len(e), bool)
    to = u / np.where(flat, np.inf, np.sqrt(np.where(flat, 1, e)))
    explained = np.where(flat, 0, e / (trace or 1)).tolist()

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if len(b):
                x = integers(b)
                w = (x - mean) @ to
                ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(exact_deviation(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["x", "weight", "deviation", "w"])

    white = written(distinct.select("x", "weight").mapInArrow(project, "x binary, weight long, deviation long, w array<double>"), "white")
    remove(spark, path_of(distinct))
    k = len(e)

    def projected(b: pa.RecordBatch) -> np.ndarray:
        return b.column(0).flatten().to_numpy().reshape(len(b), k)

    centre = added(white, ["w", "weight"], lambda b: weights(b) @ projected(b), k, "double") / n
    error = float(np.abs(weighted_covariance(white, "w", projected, k, centre, n) - np.eye(k)).max())
    out = rows.join(white.select("x", "deviation", "w"), "x").select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    share = F.get(F.lit(explained), F.col("c"))
    return out.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
