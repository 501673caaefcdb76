"""What the operators share: shared-folder paths, written tables, raw binary files and Arrow batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where the session names none, one in the warehouse. A cluster whose session names none, and whose warehouse is a local folder, is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/steps"
        if (at.startswith("file:") or "://" not in at) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files through Spark's own file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage so that a lost executor costs no earlier step."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(name: str) -> str:
    """A new folder's name for tables that go together: written(df, f"{name}/...") puts them there, and remove_steps takes them all away."""
    return f"{name}-{uuid.uuid4().hex}"


def remove_steps(spark: SparkSession, name: str) -> None:
    remove(spark, f"{shared_dir(spark)}/{name}")


def path_of(df: DataFrame) -> str:
    """The folder of a table made by written()."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def write_binary(df: DataFrame, blob: str, path: str, last: int) -> None:
    """Writes the rows' bytes one after another, a file for each partition.

    Spark's text sink puts a separator byte after each row, so every row's final
    byte must be `last`: it is taken off here and put back by the sink. The sink
    brings Spark's commit protocol and its file systems along.
    """
    body = F.expr(f"substring({blob}, 1, length({blob}) - 1)")
    df.select(body.cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", chr(last)).text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file; writers keep files small enough for one row."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def keyed_crc(col: str | Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 2000, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from an iterator of tuples."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= n or size >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression of few columns (bias last)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def in_one_task(rows: DataFrame, order: list[str], train: Callable[[Iterator[pa.RecordBatch]], Any]) -> Any:
    """train(batches of rows in that order), run by one task, not the driver: for samples of a bounded number of rows. A lost executor costs a rerun."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([pickle.dumps(train(it))], pa.binary())], names=["model"])

    made = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(work, "model binary").first()
    return pickle.loads(made.model) if made else train(iter(()))  # without rows Spark may leave the task out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces_by_size(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` hold `total`."""
    return max(least, -(-int(total or 0) // each))


def integer_vectors(vectors: DataFrame, scale: int, offset: int, most: int, keep: list[str]) -> tuple[DataFrame, int]:
    """vectors(embedding, ...) -> the columns `keep` and x, floor(scale * c) + offset of each entry as 32-bit integers one after another; and the number of entries.

    Rows whose vector is null or holds null, NaN or infinite entries go, and so do those of another
    length than most rows have (of equally common lengths the larger stays). Integers beyond `most` either way stop there.
    """
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.select(*keep, F.col("embedding").cast("array<double>").alias("embedding")).filter(finite)
    usual = own.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = usual.d if usual else 0

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(b), dim)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(v * scale) + offset, -most, most).astype("<i4")
            ends = np.arange(len(b) + 1, dtype=np.int32) * (4 * dim)
            packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])
            yield pa.record_batch([*(b.column(k) for k in range(len(keep))), packed], names=[*keep, "x"])

    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "x binary"])
    return own.filter(F.size("embedding") == dim).select(*keep, "embedding").mapInArrow(pack, schema), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows' packed 32-bit integers as 64-bit ones."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)
