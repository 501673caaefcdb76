"""Compression of vectors to one code for each of their parts, with memoised grid cells.

A part is cut into cells of a grid; a cell's coarse place is hashed, and the entries of the
codebook that can be nearest to some point of the cell are kept by that hash: those whose least
distance to the cell's box is not beyond the smallest of the entries' largest distances.
Other points of the cell look the entries up, and only these are evaluated, in whole numbers.
Codes are exact, whatever the cells are; ties go to the entry of the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_vectors, matrix, mix64, path_of, remove, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers stop here, which components beyond 32,768 alone reach; so squared distances of 8 parts fit in 64 bits up to 64 entries.
MOST = 1 << 27


class CellMemo:
    """The entries of a codebook (k x p) that can be nearest in a cell of the grid, by the cell's hash."""

    def __init__(self, book: np.ndarray, width: int, most: int = 100_000):
        self.book, self.width, self.most = book, width, most
        self.odd = mix64(np.arange(1, book.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, self.book.shape[1]), np.int64)
        self.masks = np.zeros((0, len(self.book)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Cells (n x p) -> n x k: is an entry nearest to some point of the box, as far as least and largest distances tell?"""
        out = np.zeros((len(cells), len(self.book)), bool)
        for k in range(0, len(cells), 4096):
            low = (cells[k : k + 4096] * self.width)[:, None, :]
            high = low + self.width - 1
            least = np.maximum(0, np.maximum(low - self.book, self.book - high))
            most = np.maximum(np.abs(self.book - low), np.abs(high - self.book))
            out[k : k + 4096] = (least**2).sum(2) <= (most**2).sum(2).min(1)[:, None]
        return out

    def candidates(self, x: np.ndarray) -> np.ndarray:
        cells = x // self.width
        h = mix64((cells.astype(np.uint64) * self.odd).sum(1, dtype=np.uint64))
        at, known = self.look_up(h, cells)
        if not known.all():
            _, first = np.unique(h[~known], return_index=True)
            new = np.flatnonzero(~known)[first]
            new = new[~np.isin(h[new], self.keys)]  # a cell whose hash another one has stays outside
            if len(self.keys) + len(new) > self.most:
                self.forget()
            new = new[: self.most]
            keys, found, masks = (np.concatenate(p) for p in ((self.keys, h[new]), (self.cells, cells[new]), (self.masks, self.undominated(cells[new]))))
            order = np.argsort(keys, kind="stable")
            self.keys, self.cells, self.masks = keys[order], found[order], masks[order]
            at, known = self.look_up(h, cells)
        out = np.zeros((len(x), len(self.book)), bool)
        out[known] = self.masks[at[known]]
        out[~known] = self.undominated(cells[~known])
        return out

    def look_up(self, h: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, (self.keys[at] == h) & (self.cells[at] == cells).all(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and the squared distance."""
        mask = self.candidates(x)
        row, entry = np.nonzero(mask)
        d = ((x[row] - self.book[entry]) ** 2).sum(1)
        least = np.minimum.reduceat(d, np.concatenate([[0], np.cumsum(mask.sum(1))[:-1]]))
        hit = np.flatnonzero(d == least[row])
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
        return entry[first], least


def memos(books: list[np.ndarray], width: int) -> list[CellMemo]:
    return [CellMemo(b, width) for b in books]


def part_sums(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Each entry's parts: componentwise sums and, last, their count; a row of sums from each task, added up by Spark."""
    parts, (k, p) = len(books), books[0].shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = memos(books, width), np.zeros((parts, k, p + 1), np.int64)
        for b in it:
            x = matrix(b.column(0), parts * p).reshape(len(b), parts, p) if len(b) else np.zeros((0, parts, p), np.int64)
            for j in range(parts if len(x) else 0):
                entry, _ = memo[j].nearest(x[:, j])
                np.add.at(total[j, :, :p], entry, x[:, j])
                total[j, :, p] += np.bincount(entry, minlength=k)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "s"])

    sums = rows.select("x").mapInArrow(run, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(parts * k * (p + 1), np.int64)
    for r in sums:
        out[r["at"]] = r.s
    return list(out.reshape(parts, k, p + 1))


def fit(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int, width: int) -> list[np.ndarray]:
    """rows(vec_id, x) -> a codebook for each part. It starts as the parts of the smallest vec_ids (null ones last, then by x)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    start = np.array([np.frombuffer(r.x, "<i4") for r in first], np.int64).reshape(len(first), parts, dim // parts)
    books = [np.ascontiguousarray(start[:, j]) for j in range(parts)]
    for _ in range(rounds):
        for book, sums in zip(books, part_sums(rows, books, width), strict=True):
            used = sums[:, -1] > 0
            book[used] = sums[used, :-1] // sums[used, -1:]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """rows(vec_id, label, x) -> vec_id, label, code, error."""
    parts, p, hexes = len(books), books[0].shape[1], np.array([f"{k:02x}" for k in range(len(books[0]))])
    kind = dict(rows.dtypes)["label"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memos(books, width)
        for b in it:
            if not len(b):
                continue
            x = matrix(b.column(2), parts * p).reshape(len(b), parts, p)
            got = [m.nearest(x[:, j]) for j, m in enumerate(memo)]
            code = hexes[got[0][0]]
            for entry, _ in got[1:]:
                code = np.char.add(code, hexes[entry])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(code.tolist(), pa.string()), pa.array(sum(d for _, d in got), pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int = 512) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    The vectors' integers are written once and read in each round; a task adds up its sums for each entry, so
    parts * entries * (length of a part + 1) numbers a round reach the driver, whatever the input is.
    Defined cases: null, non-finite and odd vectors as in integer_vectors(); of repeated ids each row counts; with fewer
    rows than entries, the codebooks are as small; null labels are one label; an empty table gives no rows; other columns
    are left out. The length of a vector must be a multiple of the number of parts (ValueError).
    """
    spark, out = vectors.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows, dim = integer_vectors(vectors.withColumn("vec_id", F.col("vec_id").cast("long")), scale, 0, MOST, ["vec_id", "label"])
    if not dim:
        return spark.createDataFrame([], out)
    if dim % parts:
        raise ValueError(f"vectors of {dim} entries can't be cut into {parts} equal parts")
    rows = written(rows, "integers")
    books = fit(rows, dim, parts, entries, rounds, width)
    coded = written(encode(rows, books, width), "codes")
    remove(spark, path_of(rows))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    """The rounds as one query, without cells: every part with every entry."""
    assign = "SELECT vec_id, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, p.v, b.entry, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) AS d FROM p JOIN {b} b USING (part)) GROUP BY ALL"
    size = f"(len(v) // {PARTS})"
    steps = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * {size} + 1 : (part + 1) * {size}] AS v FROM k, range({PARTS}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}) USING (vec_id))",
    ]
    for n in range(ROUNDS):
        steps += [
            f"a{n} AS MATERIALIZED ({assign.format(b=f'b{n}')})",
            f"m{n} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(c)::BIGINT::DECIMAL(38, 6) / count(*))::DOUBLE AS m FROM (SELECT part, entry, unnest(range(len(v))) AS i, unnest(v) AS c FROM a{n}) GROUP BY ALL) GROUP BY ALL)",
            f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN m{n} m USING (part, entry))",
        ]
    last = f"b{ROUNDS}"
    steps.append(f"z AS ({assign.format(b=last)}), c AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(list_transform(v, lambda c: c::BIGINT), ',') AS s FROM {last}))")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"


SQL = sql()
