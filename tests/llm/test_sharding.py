"""Shards: the schedule against a heap over single groups, slots, odd tables, one group with a third of all rows."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

from quire.llm import sharding


def by_heap(sizes, shards):
    """Loads after each group of falling size went to the least loaded shard, the first of equal ones."""
    heap = [(0, i) for i in range(shards)]
    out = defaultdict(Counter)
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        out[size][i] += 1
        heapq.heappush(heap, (load + size, i))
    return out


def test_schedule_is_a_heap_over_groups():
    rng = random.Random(7)
    for shards in (1, 3, 24):
        for top in (1, 3, 40, 10_000):
            sizes = [rng.randint(1, top) for _ in range(3000)]
            got = defaultdict(Counter)
            for size, _, cuts, own in sharding.plan_rows(iter(sorted(Counter(sizes).items(), reverse=True)), shards):
                for lo, hi, i in zip([0, *cuts], cuts, own, strict=False):
                    got[size][i] = hi - lo
            assert got == by_heap(sizes, shards)


def rows_of(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, place int").repartition(3)
    return sharding.shard_documents(df, **k).collect()


def test_odd_tables(spark):
    rows = [(1, "a", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (None, "é" * 5, "x", 1), (None, "b", "x", 1), (4, "w " * 200_000, "x", 1), (5, "a", "x", 1), (5, "a", "x", 1), (5, "c", "x", 1)]
    got = rows_of(spark, rows, shards=3)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    home = defaultdict(set)
    for r in got:
        home[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in home.values())
    for i in range(3):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(sum(r.shard == i for r in got)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert rows_of(spark, []) == []


def test_a_third_in_one_group(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else "t" * rng.randint(0, 60) + str(i), "", 0) for i in range(1500)] + [(None, "same", "", 0)] * 500
    got = rows_of(spark, rows, shards=4, part_rows=100)
    loads, sizes = Counter(), Counter()
    for r in got:
        loads[r.shard] += r.size
        sizes[r.text_crc32] += r.size
    assert max(loads.values()) - min(loads.values()) <= max(sizes.values())
    assert len({(r.shard, r.slot) for r in got}) == 2000 and max(Counter(r.shard for r in got).values()) == max(r.slot for r in got) + 1
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in rows_of(spark, rows[::-1], shards=4)}
