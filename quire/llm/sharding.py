"""Sharding by longest-processing-time scheduling: groups that stay together go, largest first, to the least loaded shard.

The sequence of the largest group, the next and so on depends on sizes alone, so a heap needs
the number of groups of each size, not the groups: of different sizes there are at most
sqrt(2 * total bytes), 14 million for 100 TB. One task reads these counts in falling order and
keeps the loads of the shards; how many groups of a size each shard gets is what a heap over
single groups gives. Which of them, is told by a group's place among those of its size, and
places come from a range sort and the sums of its partitions. No window and no
group holds a shard, a size or a set of copies.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import path_of, pieces_by_size, remove, written

SHARDS = 24
#: Sizes that are sent to all tasks at most; beyond, they are joined.
BROADCAST_SIZES = 200_000
PLAN = "total long, first long, cuts array<long>, shards array<int>"


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard gets, the least loaded first (of equal ones the first); loads grow."""
    n = [0] * len(loads)
    if count > 8 * len(loads):
        # a heap takes the count smallest of all load + i * size; those under a level are taken at once
        at = np.array(loads, np.int64)
        under = lambda level: np.maximum(0, -((at - level) // size))
        low, high = int(at.min()), int(at.min()) + size * (count + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if int(under(mid).sum()) <= count else (low, mid)
        n = under(low).tolist()
    heap = [(load + k * size, i) for i, (load, k) in enumerate(zip(loads, n, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(n)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + size, i))
        n[i] += 1
    for i, k in enumerate(n):
        loads[i] += k * size
    return n


def plan_rows(sizes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(size, groups) in falling order of sizes -> size, place of its first group among all, and from which place in the size on each shard has its own."""
    loads, first = [0] * shards, 0
    for size, count in sizes:
        n = deal(loads, size, count)
        own = [i for i, k in enumerate(n) if k]
        yield size, first, np.cumsum([n[i] for i in own]).tolist(), own
        first += count


def plan(groups: DataFrame, shards: int) -> DataFrame:
    """groups(total) -> total, first, cuts, shards: the schedule, a row for each size; one task reads the counts of sizes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = ((s, c) for b in it for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held: list[tuple] = []
        for row in plan_rows(sizes, shards):
            held.append(row)
            if len(held) == 10_000:
                yield as_batch(held)
                held = []
        if held:
            yield as_batch(held)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["total", "first", "cuts", "shards"])

    sizes = groups.groupBy("total").agg(F.count("*").alias("n"))
    return sizes.repartition(1).sortWithinPartitions(F.desc("total")).mapInArrow(run, PLAN)


def numbered(df: DataFrame, by: list[str], order: list[str], parts: int, name: str) -> DataFrame:
    """Adds `place`, from 0 among the rows of equal `by` in the given order: a range sort, written, and sums of its partitions.

    by: of few values in all, as sums are sent to all tasks: a row for each partition and one more for each value.
    """
    own = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    own = written(own.withColumn("_row", F.monotonically_increasing_id()), name)
    own = own.withColumn("_part", F.shiftright("_row", 33))
    sums = own.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_part", *by, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    out = own.join(F.broadcast(sums), ["_part", *by])
    return out.withColumn("place", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, part_rows: int = 500_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size (UTF-8 bytes and 8), text_crc32, law (`bytes`), shard, slot (from 0 in each shard, by doc_id), grown_shard (null).

    Equal texts are a group and stay together, so a shard is never larger than the mean and the
    largest group. Equal sizes go by the texts' SHA-256, equal loads to the first shard.
    Defined cases: a null text counts as an empty one; null ids come first in a shard; repeated rows
    each have a slot; an empty table gives no rows; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    own = written(own, "sizes")
    rows = own.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces_by_size(rows, part_rows))
    groups = own.groupBy("key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    groups = groups.select("key", (-F.col("n") * F.col("size")).alias("falling"))
    placed = numbered(groups, [], ["falling", "key"], parts, "groups")
    placed = placed.select("key", (-F.col("falling")).alias("total"), "place")
    schedule = written(plan(placed, shards), "schedule")
    few = schedule.count() <= BROADCAST_SIZES
    placed = placed.join(F.broadcast(schedule) if few else schedule, "total")
    rank = F.col("place") - F.col("first")
    at = F.size(F.filter("cuts", lambda c: c <= rank))
    dealt = own.join(placed.select("key", F.get("shards", at).alias("shard")), "key")
    out = numbered(dealt, ["shard"], ["doc_id", "key", "row"], parts, "shards")
    remove(spark, path_of(own))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 bit by bit, eight steps a byte.
BIT = "xor({0} >> 1, 3988292384 * ({0} & 1))"
BYTE = reduce(lambda a, _: f"list_transform([{a}], lambda y: {BIT.format('y')})[1]", range(8), "xor(a, x)")
CRC = f"""b AS (SELECT key, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM (SELECT DISTINCT key, hex(encode(t)) AS h FROM k)),
c AS (SELECT key, xor(4294967295, list_reduce(bytes, lambda a, x: {BYTE}, 4294967295)) AS text_crc32 FROM b)"""
#: The heap as a recursive query over single groups; of equal sizes the shards taken are dealt to the groups in rising order of both.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size FROM documents), k AS (SELECT doc_id, t, size, sha256(t) AS key FROM d),
g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY total DESC, key) AS i FROM (SELECT key, sum(size)::BIGINT AS total FROM k GROUP BY key)),
r(i, total, shard, loads) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT)
 UNION ALL SELECT g.i, g.total, list_position(loads, list_min(loads))::BIGINT - 1, list_transform(range({SHARDS}), lambda x: loads[x + 1] + CASE WHEN x + 1 = list_position(loads, list_min(loads)) THEN g.total ELSE 0 END) FROM r JOIN g ON g.i = r.i + 1),
s AS (SELECT total, shard, row_number() OVER (PARTITION BY total ORDER BY shard, i) AS j FROM r WHERE i > 0), p AS (SELECT key, total, row_number() OVER (PARTITION BY total ORDER BY key) AS j FROM g),
o AS (SELECT k.*, s.shard FROM k JOIN p USING (key) JOIN s USING (total, j)),
{CRC}
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, key) - 1 AS slot, NULL::INT AS grown_shard FROM o JOIN c USING (key)"""
