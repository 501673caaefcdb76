"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, and white space becomes single spaces. An item of m characters may
occur in a document with up to k = floor(rate m) edits. Such an occurrence keeps at least
m - q + 1 - k q of the item's q-grams, all on diagonals (place in the document less place
in the item) within k of each other. So shared q-grams are counted in cells of 2 k + 1
diagonals, and each two neighbouring cells, an overlapping band, with enough of them
are a region to align: a banded dynamic program with free ends in the document gives
edits and span. Whatever is within the budget is found; nothing beyond it is.

The benchmark is handed to the tasks in blocks of bounded size (all of it, as a rule),
each against all documents; there is no join and no shuffle.

The lemma asks for at least one shared q-gram only of long enough items: those of 40
characters or more are sought with q = 8, of 4 to 39 with q = 4, of 1 to 3 with q = 1, so that
each item has its whole edit budget. Items of all lengths are found wherever they occur; a flag
tells whether an occurrence begins and ends where words do, for those who take short items as words only.

Defined cases: items that are null or blank are found nowhere; null or empty texts have no hit; null doc_ids and repeated rows are rows of their own; empty
tables on either side give no hits; more columns are ignored, or kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, pieces_by_size

Q, RATE = 8, 0.1
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each in the text) with lower case and single spaces."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have lower case of two characters
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    blank = code <= 32
    high = np.flatnonzero(code >= 0x85)
    if len(high):
        blank[high[np.isin(code[high], SPACE)]] = True
    code[blank] = 32
    keep = ~(blank & np.concatenate([[True], blank[:-1]])) if len(code) else blank
    return code[keep], np.flatnonzero(keep)


def grams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q (a power of two) characters from each place on; the last q - 1 places have none."""
    h, w, base = code.astype(np.uint64), 1, int(BASE)
    while w < q:
        h = (h[:-w] * np.uint64(base) + h[w:]) if len(h) > w else h[:0]
        h ^= h >> np.uint64(29)
        base = base * base % 2**64
        w *= 2
    return h


class Benchmark:
    """A block of items, sought by q-grams of as many characters as their lengths allow."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        own = [(i, c) for i, t in items if t and len(c := normal(t.strip())[0])]
        by_q: dict[int, list] = {}
        for i, c in own:
            q = next(q for q in (Q, Q // 2, 1) if len(c) >= q and len(c) - q + 1 - int(len(c) * rate) * q > 0)
            by_q.setdefault(q, []).append((i, c))
        self.parts = [Grams(part, q, rate) for q, part in by_q.items()]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of the items' occurrences in a text; of overlapping ones of an item the best."""
        if not text or not self.parts:
            return []
        code, where = normal(text)
        return [(i, int(where[s]), int(where[e - 1]) + 1, d) for part in self.parts for i, s, e, d in part.search(code)]


class Grams:
    """The q-grams of items, for lookups."""

    def __init__(self, own: list[tuple[int, np.ndarray]], q: int, rate: float):
        self.ids, self.codes, self.q = [i for i, _ in own], [c for _, c in own], q
        self.m = np.array([len(c) for c in self.codes], np.int64)
        self.k = (self.m * rate).astype(np.int64)
        self.need = self.m - q + 1 - self.k * q
        self.cell = 2 * self.k + 1
        all_ = [grams(c, q) for c in self.codes]
        g = np.concatenate([*all_, np.zeros(0, np.uint64)])
        order = np.argsort(g, kind="stable")
        self.item = np.repeat(np.arange(len(own)), [len(x) for x in all_])[order]
        self.at = np.concatenate([*[np.arange(len(x)) for x in all_], np.zeros(0, np.int64)])[order]
        self.keys, self.first, self.times = np.unique(g[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def regions(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of the bands in which enough q-grams are shared."""
        g = grams(code, self.q)
        at = np.flatnonzero(self.bits[g >> np.uint64(44)])
        if not len(at) or not len(self.keys):
            return []
        x = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[x] == g[at]
        at, x = at[ok], x[ok]
        n = self.times[x]
        place = np.repeat(at, n)
        own = np.repeat(self.first[x], n) + (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n))
        item = self.item[own]
        cell = (place - self.at[own] + self.m[item]) // self.cell[item]  # the item's length keeps diagonals above 0
        keys, count = np.unique(item << np.int64(40) | cell, return_counts=True)
        both = count.copy()
        both[:-1] += np.where(keys[1:] == keys[:-1] + 1, count[1:], 0)
        # a band is a cell and the next; one whose own cell is empty holds no more than the band that begins at the next
        hit = keys[both >= self.need[keys >> np.int64(40)]]
        item, cell = hit >> np.int64(40), hit & ((1 << 40) - 1)
        return [*zip(item.tolist(), (cell * self.cell[item] - self.m[item]).tolist(), strict=True)]

    def align(self, code: np.ndarray, regions: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best occurrence in each region with one within the budget."""
        out = []
        for item, low in regions:
            p, k, m = self.codes[item], int(self.k[item]), int(self.m[item])
            begin, width = low - k, 2 * int(self.cell[item]) + 2 * k
            # cost in the high, start in the low half: equal costs take the earlier start
            best, one = np.arange(begin, begin + width, dtype=np.int64) + (1 << 20), 1 << 32
            step = np.arange(width, dtype=np.int64) * one
            pad = np.zeros(m + width + 1, np.uint32)
            a, b = max(begin, 0), min(begin + m + width, len(code))
            pad[a - begin : max(b, a) - begin] = code[a : max(b, a)]
            for i in range(m):
                new = best + np.where(pad[i : i + width] == p[i], 0, one)
                np.minimum(new[:-1], best[1:] + one, out=new[:-1])
                best = np.minimum.accumulate(new - step) + step
                if not i & 15 and int(best.min() >> 32) > k:
                    break
            x = int(best.argmin())
            edits, start = int(best[x] >> 32), int(best[x] & 0xFFFFFFFF) - (1 << 20)
            if edits <= k:
                out.append((item, max(start, 0), min(begin + m + x, len(code)), edits))
        return out

    def search(self, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits), places in the normal text."""
        found = self.align(code, self.regions(code))
        out: list[tuple[int, int, int, int]] = []
        for item, start, end, edits in sorted(found, key=lambda f: (f[0], f[3], f[1])):
            if all(o[0] != item or end <= o[1] or start >= o[2] for o in out):
                out.append((item, start, end, edits))
        return [(self.ids[i], s, e, d) for i, s, e, d in out if e > s]


def whole_words(text: str, start: int, end: int) -> bool:
    """Does a place begin and end where words do?"""
    inner = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return not inner(start) and not inner(end)


def blocks(benchmark: DataFrame, block_chars: int = 4_000_000) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of about block_chars characters, one at a time at the driver."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    n = pieces_by_size(items.agg(F.sum(F.length("text")).alias("n")).first().n, block_chars)
    for b in range(n):
        yield [(r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, start_char, end_char, edits, whole_words of each occurrence."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("edits", pa.int32()), ("whole_words", pa.bool_())])
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in blocks(benchmark):
        known = spark.sparkContext.broadcast(items)

        def rows(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(known.value)
            yield from batches(((d, *hit, whole_words(t, *hit[1:3])) for b in it for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in bench.search(t)), schema)

        part = cols.mapInArrow(rows, "doc_id long, item_id long, start_char long, end_char long, edits int, whole_words boolean")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, words: bool = False) -> DataFrame:
    """The rows, all columns, in which no item occurs; with `words`, none as whole words."""
    spark = docs.sparkSession

    def leaks_into(text: str | None, bench: Benchmark) -> bool:
        hits = bench.search(text)
        return any(whole_words(text, s, e) for _, s, e, _ in hits) if words else bool(hits)

    for items in blocks(benchmark):
        known = spark.sparkContext.broadcast(items)

        def rows(it: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(known.value)
            for b in it:
                yield b.filter(pa.array([not leaks_into(t, bench) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
