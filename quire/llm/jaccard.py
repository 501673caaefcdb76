"""N-gram Jaccard self-join by chosen paths, for near-duplicate documents.

Sets are the five-word shingles of a text. Equal sets are first summed up to one node.
A node's sampled tokens are its MinHash values (coordinate, value). Each run splits all
nodes by one token; buckets of up to `split_over` nodes are leaves. Larger ones are
split again by tokens drawn by the path so far, 1.25 = 1 / 0.8 of them on average, until
they are small, or dense (a child keeps most of its parent: their members are alike and
splitting doesn't help), or `depth` is reached. Paths of more than a fixed share of all
rows, of which there can be few, have their counts broadcast, so their rows stay apart.

Leaves are compared by brute force with the exact sets. A leaf of more than a block's
nodes is dealt to pairs of blocks, so no task holds it whole and no pair is left out.
A task emits a row for each node, never pairs: its links and the smallest node of its
component there. A pair that several leaves hold is counted in the first of them
alone, which the nodes' lists of leaves tell. Leaves with equal members are compared once.

How many runs found each pair estimates the share of pairs that no run found (Chao's
estimator), apart for nodes of few, some and many links, so that large groups don't speak
for small ones; runs are added until each estimate reaches the target. Should the most
runs fall short of it, buckets are searched once more without splitting, in so many runs
that a pair at the threshold shares no bucket with a probability of 1e-12: slower, but nothing is left out.

Defined cases: words are what white space separates, lower-cased; a text of fewer than
five words is one shingle; texts without words (null, empty, blank) equal each other;
null doc_ids are kept, and count for a class's id only if all its ids are null; repeated
rows are copies; an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, mix64, path_of, remove, remove_steps, steps, written

SHINGLE, COORDS, SLOTS = 5, 64, 1 << 22
HOT = 10_000  # paths of more than 1 / HOT of all rows are hot: fewer than HOT of them
_rng = np.random.default_rng(20240229)
MUL = _rng.integers(0, 2**31, COORDS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 2**32, COORDS).astype(np.uint32)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 200)
    n = min(n, len(h))
    g = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)])
    return np.unique(g)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 31 bits each."""
    if not len(s):
        return np.zeros(COORDS, np.int32)
    x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(COORDS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):  # 32-bit products, in pieces that stay in the cache
        low = np.minimum(low, (x[at : at + 1024, None] * MUL + ADD).min(axis=0))
    return (mix64(low.astype(np.uint64)) >> np.uint64(33)).astype(np.int32)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h (hash of the text), key (of the set), n (its size), sig."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("sig", pa.list_(pa.int32()))])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for d, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    s = shingles(t)
                    yield d, h, set_key(s), len(s), signature(s)

        yield from batches(out(), schema)

    cols = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    return cols.mapInArrow(rows, "doc_id long, h long, key binary, n int, sig array<int>")


def child(path: Column, coord: Column, value: Column, run: Column) -> Column:
    """64-bit name of a bucket; its low byte is the run."""
    return F.xxhash64(path, coord, value).bitwiseAND(F.lit(-256)).bitwiseOR(run.cast("long"))


def hot(total: int) -> Column:
    """Of paths with m rows out of `total`, those that hold more than their share."""
    return F.col("m") > max(64, total // HOT)


def sized(rows: DataFrame, total: int, at: str = "sized") -> DataFrame:
    """Rows of buckets with several nodes, with m (nodes), n (largest set) and the members' fingerprint.

    Counts are summed map-side; those of hot paths, 2 * HOT at most, go to the rows, all others meet by path.
    total: at least half of the rows; at: the folder of steps.
    """
    stats = rows.groupBy("path").agg(F.count("*").alias("m"), F.max("n").alias("top"), F.bit_xor(F.xxhash64("key")).alias("f1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("f2"))
    stats = written(stats.filter("m > 1"), f"{at}/buckets")
    few = F.broadcast(stats.filter(hot(total)))
    rest = rows.join(few.select("path"), "path", "left_anti").join(stats.filter(~hot(total)), "path")
    return rows.join(few, "path").unionByName(rest)


def leaves(nodes: DataFrame, runs: int, split_over: int, depth: int, at: str, dense: float = 0.7) -> DataFrame:
    """nodes(key, n, sig) -> key, path, m, top, f1, f2: the leaf buckets of all runs."""
    run = F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.get("sig", r).alias("v"))))
    first = nodes.select("key", "n", run.alias("x"))
    first = first.select("key", "n", child(F.lit(0).cast("long"), F.col("x.run"), F.col("x.v"), F.col("x.run")).alias("path"))
    top = written(sized(first, nodes.count() * runs, at), f"{at}/paths")
    out = [top.filter((F.col("m") <= split_over) | F.lit(depth == 0))]
    big = top.filter(F.col("m") > split_over).join(nodes.select("key", "sig"), "key")
    for level in range(depth):
        big = written(big, f"{at}/paths")
        size = big.count()
        if not size:
            break
        pick = lambda k: (F.lit(runs) + F.pmod(F.xxhash64("path", F.lit(k)), F.lit(COORDS - runs))).cast("int")  # noqa: B023, E731
        coords = F.when(F.pmod(F.xxhash64("path", F.lit(7)), F.lit(4)) == 0, F.array(pick(1), pick(2))).otherwise(F.array(pick(1)))
        kids = big.select("key", "n", "sig", F.col("m").alias("was"), "path", F.explode(F.array_distinct(coords)).alias("c"))
        kids = kids.select("key", "n", "sig", "was", child(F.col("path"), F.col("c"), F.get("sig", F.col("c")), F.col("path").bitwiseAND(F.lit(255))).alias("path"))
        kids = written(sized(kids, size, at), f"{at}/paths")  # a row has one or two
        done = (F.col("m") <= split_over) | (F.col("m") >= dense * F.col("was")) | F.lit(level == depth - 1)
        out.append(kids.filter(done).drop("sig", "was"))
        big = kids.filter(~done).select("key", "n", "sig", "path", "m")
    return reduce(DataFrame.unionByName, [x.select("key", "path", "m", "top", "f1", "f2") for x in out])


def slot(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS)).cast("int")


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """reps(doc_id, h) name texts -> key, set (packed hashes) of these.

    A bitmap of fixed size (one bit for each of SLOTS hash values, 512 KB) keeps most other
    texts from being moved; the join on keys that follows is exact, so its false hits don't matter.
    """
    spark = docs.sparkSession
    hits = reps.select(slot("doc_id", "h").alias("s")).distinct().toArrow().column("s").to_numpy()  # SLOTS numbers at most
    bits = np.zeros(SLOTS, bool)
    bits[hits] = True
    known = spark.sparkContext.broadcast(np.packbits(bits))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = np.unpackbits(known.value).view(bool)

        def out() -> Iterator[tuple]:
            for b in it:
                for k in np.flatnonzero(ok[b.column(0).to_numpy()]).tolist():
                    s = shingles(b.column(1)[k].as_py())
                    yield set_key(s), s.tobytes()

        yield from batches(out(), pa.schema([("key", pa.binary()), ("set", pa.binary())]))

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    return cols.select(slot("doc_id", "h").alias("slot"), "text").mapInArrow(rows, "key binary, set binary")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[ii] and b[jj]."""
    if len(ii) <= 3 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(ii.tolist(), jj.tolist(), strict=True)], np.int64)
    words, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    who = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    inter = np.zeros((len(a), len(b)), np.float32)
    step = max(256, (8 << 20) // (len(a) + len(b)))
    cuts = np.searchsorted(code, np.arange(0, len(words) + step, step))
    for at, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(a) + len(b), step), np.float32)
        m[who[i:j], code[i:j] - at * step] = 1
        inter += m[: len(a)] @ m[len(a) :].T
    return inter[ii, jj].astype(np.int64)


def plausible(left: dict, right: dict, same: bool, threshold: float) -> np.ndarray:
    """Pairs that sketches and sizes leave possible: agreement not five standard deviations below the threshold."""
    sa, sb = left["sig"], right["sig"]
    low = int(np.floor(COORDS * (threshold - 5 * np.sqrt(threshold * (1 - threshold) / COORDS))))
    if len(sa) * len(sb) <= 2048:
        agree = (sa[:, None, :] == sb[None, :, :]).sum(axis=2)
    else:
        agree = np.zeros((len(sa), len(sb)), np.int16)
        for c in range(COORDS):
            agree += sa[:, c, None] == sb[None, :, c]
    na, nb = left["n"][:, None], right["n"][None, :]
    ok = (agree >= low) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
    return np.triu(ok, 1) if same else ok


def candidates(left: dict, right: dict, same: bool, threshold: float) -> Iterator[tuple]:
    """Of a pair of blocks the nodes with a plausible partner there: canon, bi, bj, side, same, key."""
    ok = plausible(left, right, same, threshold)
    hits = [(left, ok.any(axis=1) | (ok.any(axis=0) if same else False))] + ([] if same else [(right, ok.any(axis=0))])
    for block, hit in hits:
        for k in np.flatnonzero(hit).tolist():
            yield (*block["id"], block["side"][k], same, block["key"][k])


def compare(left: dict, right: dict, same: bool, threshold: float) -> Iterator[tuple]:
    """One pair of blocks of one leaf -> key, links, hook, found, once, twice of its nodes with links."""
    canon = left["id"][0]
    na, nb = left["n"].astype(np.int64), right["n"].astype(np.int64)
    ii, jj = np.nonzero(plausible(left, right, same, threshold))
    if not len(ii):
        return
    a = [np.frombuffer(x, np.uint64) for x in left["set"]]
    b = a if same else [np.frombuffer(x, np.uint64) for x in right["set"]]
    inter = overlaps(a, b, ii, jj)
    hit = inter >= threshold * (na[ii] + nb[jj] - inter) - 1e-9
    ii, jj = ii[hit], jj[hit]
    if not len(ii):
        return
    # leaves that both nodes of a pair are in: in how many runs, and is this the first
    both = [*zip(left["paths"], left["canons"], strict=True), *([] if same else zip(right["paths"], right["canons"], strict=True))]
    cols = sorted({(c, p) for ps, cs in both for p, c in zip(ps, cs, strict=True)})
    at = {p: k for k, (_, p) in enumerate(cols)}
    member = np.zeros((len(both), len(cols)), bool)
    for r, (ps, _) in enumerate(both):
        member[r, [at[p] for p in ps]] = True
    canons = np.array([c for c, _ in cols])
    by_run = np.argsort([p & 255 for _, p in cols], kind="stable")
    starts = np.flatnonzero(np.diff([-1, *[cols[k][1] & 255 for k in by_run]]))
    first, runs = np.zeros(len(ii), bool), np.zeros(len(ii), np.int64)
    for k in range(0, len(ii), 1 << 14):
        s = slice(k, k + (1 << 14))
        common = member[ii[s]] & member[jj[s] + (0 if same else len(na))]
        first[s] = canons[common.argmax(axis=1)] == canon
        runs[s] = np.logical_or.reduceat(common[:, by_run], starts, axis=1).sum(axis=1)
    # the smallest node of each node's component within this task
    total = len(both)
    label = np.arange(total)
    x, y = ii, jj + (0 if same else len(na))
    while len(x):
        low_ = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low_)
        np.minimum.at(new, y, low_)
        np.minimum.at(new, label[x], low_)
        np.minimum.at(new, label[y], low_)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keys = [*left["key"], *([] if same else right["key"])]
    ii, jj, runs = ii[first], jj[first] + (0 if same else len(na)), runs[first]
    links = np.bincount(ii, minlength=total) + np.bincount(jj, minlength=total)
    mine = [np.bincount(ii[m], minlength=total) for m in (runs > 0, runs == 1, runs == 2)]  # each pair at its left node
    for k in np.flatnonzero((links > 0) | (label != np.arange(total))).tolist():
        yield keys[k], int(links[k]), keys[label[k]], int(mine[0][k]), int(mine[1][k]), int(mine[2][k])


def by_blocks(rows: DataFrame, work, schema: pa.Schema, out: str) -> DataFrame:
    """Applies work(left, right, same) to each pair of blocks (canon, bi, bj).

    Rows are dealt by block pair and sorted by it, then left, and by key; a task cuts its
    sorted stream at the borders, which spares a data frame for each of many small leaves.
    """
    ordered = rows.repartition("canon", "bi", "bj").sortWithinPartitions("canon", "bi", "bj", "side", "key")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[pa.RecordBatch]:
            rest = None
            for b in it:
                b = b if rest is None else pa.concat_batches([rest, b])
                ids = np.stack([b.column(c).to_numpy() for c in ("canon", "bi", "bj")], axis=1)
                cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
                for i, j in zip([0, *cuts], cuts, strict=False):
                    yield b.slice(i, j - i)
                rest = b.slice(cuts[-1] if len(cuts) else 0)
            if rest is not None and rest.num_rows:
                yield rest

        def results() -> Iterator[tuple]:
            for g in groups():
                same, sides = g.column("same")[0].as_py(), g.column("side").to_numpy()
                cols = {"n": g.column("n").to_numpy(), "sig": g.column("sig").flatten().to_numpy().reshape(-1, COORDS)}
                cols |= {c: g.column(c).to_pylist() for c in g.schema.names if c in ("key", "set", "paths", "canons", "side")}
                mid = len(sides) if same else int((sides == 0).sum())
                if mid < (2 if same else 1) or (not same and mid == len(sides)):
                    continue
                one = tuple(g.column(c)[0].as_py() for c in ("canon", "bi", "bj"))
                left, right = ({"id": one} | {k: v[part] for k, v in cols.items()} for part in (slice(0, mid), slice(0 if same else mid, None)))
                yield from work(left, right, same)

        yield from batches(results(), schema)

    return ordered.mapInArrow(cut, out)


FOUND = "key binary, links long, hook binary, found long, once long, twice long"
LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("hook", pa.binary()), ("found", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])


def search(docs: DataFrame, nodes: DataFrame, threshold: float, runs: int, split_over: int, block: int, depth: int) -> DataFrame:
    """A table of (key, links, hook, found, once, twice), several rows for a key. The tables of its steps are gone when it ends."""
    at = steps("search")
    leaf = written(leaves(nodes, runs, split_over, depth, at), f"{at}/leaves")
    buckets = leaf.groupBy("path").agg(F.first("m").alias("m"), F.first("top").alias("top"), F.first("f1").alias("f1"), F.first("f2").alias("f2"))
    canon = buckets.groupBy("m", "f1", "f2").agg(F.min("path").alias("canon"))
    canon = written(buckets.join(canon, ["m", "f1", "f2"]).select("path", "m", "canon"), f"{at}/buckets")
    leaf, few = leaf.select("key", "path", "m", "top"), hot(leaf.count())
    named = leaf.filter(~few).join(canon.filter(~few).drop("m"), "path").unionByName(leaf.filter(few).join(F.broadcast(canon.filter(few).drop("m")), "path"))
    named = written(named.select("key", "path", "canon", "m", "top"), f"{at}/leaves")
    lists = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("canon", "path"))).alias("l"))  # a node's leaves: some for each run
    lists = lists.select("key", F.col("l.path").alias("paths"), F.col("l.canon").alias("canons"))
    # blocks of bounded rows and bytes; each node goes to all pairs that its block is in
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("m") * F.col("top") / (4 << 20))).cast("int")
    rows = named.filter("path = canon").select("key", "canon", blocks.alias("nb"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("nb")).cast("int"))
    rows = rows.select("key", "canon", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select("key", "canon", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"))
    # sketches first: only nodes with a plausible partner need their sets
    ids = pa.schema([("canon", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("side", pa.int32()), ("same", pa.bool_()), ("key", pa.binary())])
    near = by_blocks(rows.join(nodes.select("key", "n", "sig"), "key"), partial(candidates, threshold=threshold), ids, "canon long, bi int, bj int, side int, same boolean, key binary")
    near = written(near, f"{at}/near")
    known = written(nodes.join(lists, "key").join(near.select("key").distinct(), "key", "left_semi"), f"{at}/candidates")
    sets = sets_of(docs, known.select("doc_id", "h")).groupBy("key").agg(F.first("set").alias("set"))
    known = known.join(sets, "key").select("key", "n", "sig", "paths", "canons", "set")
    links = written(by_blocks(near.join(known, "key"), partial(compare, threshold=threshold), LINKS, FOUND), "links")
    remove_steps(docs.sparkSession, at)
    return links


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(key, hook) -> key, label: the smallest key of the connected component.

    Each round takes the smallest label around and then that label's own label, so paths
    halve. Labels of a round are a written table; the last two are all that is kept.
    """
    both = edges.select("key", "hook").unionByName(edges.select(F.col("hook").alias("key"), F.col("key").alias("hook"))).filter("key <> hook").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("key").agg(F.min("hook").alias("x")).select("key", F.least("key", "x").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("key", "hook"), "hook").groupBy("key").agg(F.min("label").alias("near"))
        new = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("key").alias("label"), F.col("label").alias("up"))
        new = written(new.join(up, "label", "left").select("key", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = not new.filter("was <> label").isEmpty()
        remove(new.sparkSession, path_of(labels))
        labels = new.select("key", "label")
        if not changed:
            remove(new.sparkSession, path_of(both))
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def recalls(found: DataFrame) -> dict[str, float]:
    """Estimated recall of pairs whose left node has few (up to 3), some (up to 31) or many links."""
    sums = ("links", "found", "once", "twice")
    by = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])
    kind = F.when(F.col("links") <= 3, "few").when(F.col("links") <= 31, "some").otherwise("many")
    rows = by.groupBy(kind.alias("kind")).agg(*[F.sum(c).alias(c) for c in sums]).collect()
    return {r.kind: r.found / (r.found + r.once * r.once / (2 * max(r.twice, 1))) for r in rows if r.found}


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, split_over: int = 256, block: int = 1024, depth: int = 8, runs: tuple[int, ...] = (12, 24, 40, 56)) -> DataFrame:
    """docs(doc_id, text) -> doc_id, h, class_id, n_links, n_copies, keeper.

    class_id: smallest doc_id of the class; n_links: other distinct sets at the threshold
    or more; n_copies: other rows with the same set; keeper: h of the class's first row
    (by doc_id, then h), so that rows with doc_id = class_id and h = keeper stand for it.
    """
    sketch = written(sketches(docs), "sketch")
    row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    nodes = sketch.groupBy("key").agg(F.min(row).alias("r"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = written(nodes.select("key", F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"), "copies", "n", "sig"), "nodes")
    own = nodes.select("key", "doc_id", "h", "n", "sig").filter("n > 0")
    for r in runs:
        found = search(docs, own, threshold, r, split_over, block, depth)
        estimates = recalls(found)
        if all(x >= recall for x in estimates.values()):
            break
    else:
        warnings.warn(f"estimated recall {estimates} by number of links, after {runs[-1]} runs; buckets are now compared unsplit", stacklevel=2)
        unsplit = min(COORDS, int(np.ceil(np.log(1e-12) / np.log(1 - threshold)))) if threshold < 1 else 1
        found = search(docs, own, threshold, unsplit, split_over, block, 0)
    label = components(found.select("key", "hook"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    node = nodes.select("key", "doc_id", "h", "copies").join(label, "key", "left").join(links, "key", "left")
    node = node.select("key", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h").alias("r"), "copies", F.coalesce("label", "key").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    node = written(node, "classes")
    for table in (found, label, nodes):  # the classes hold what is left of them
        remove(docs.sparkSession, path_of(table))
    firsts = node.groupBy("label").agg(F.min("r").alias("first"))
    node = node.join(firsts, "label").select("key", "first", "copies", "links")
    out = sketch.select("doc_id", "h", "key").join(node, "key")
    return out.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), F.col("links").alias("n_links"), (F.col("copies") - 1).alias("n_copies"), F.col("first.h").alias("keeper"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The first document of each class, all columns."""
    classes = near_duplicates(docs.select("doc_id", "text"), **params)
    gone = written(classes.filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("keeper")))).select("doc_id", "h").distinct(), "gone")
    again = written(classes.groupBy("doc_id", "h").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id", "h"), "gone")
    name = "_h"
    while name in docs.columns:
        name += "_"
    own = docs.withColumn(name, F.xxhash64("text"))
    same = lambda left, right: left["doc_id"].eqNullSafe(right["doc_id"]) & (left[name] == right["h"])
    kept = own.join(gone, same(own, gone), "left_anti")
    if again.isEmpty():
        return kept.drop(name)
    # repeated rows among the kept: one of each
    twice = kept.join(again, same(kept, again), "left_semi").dropDuplicates(["doc_id", name])
    return kept.join(again, same(kept, again), "left_anti").unionByName(twice).drop(name)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")
