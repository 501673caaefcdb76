"""Embeddings and exact retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.io import scratch


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float] | None]:
    """The embedder without a network: signed hashing of words, length 1."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(v)
        out.append((v / n).tolist() if n else None)
    return out


def embed_rows(rows: DataFrame, embedder: Callable[[list[str]], list] = hashed_embedding, batch_size: int = 100) -> DataFrame:
    """V1: rows(id, content) -> id, embedding, in batches; a batch that fails is tried row by row. Rows for which the embedder gives None, or fails, are left out."""

    def embedded(texts: list[str]) -> list:
        try:
            return list(embedder(texts))
        except Exception:  # noqa: BLE001  a service's failure costs its row alone
            return [None] if len(texts) == 1 else [v for t in texts for v in embedded([t])]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k in range(0, len(pdf), batch_size):
                part = pdf.iloc[k : k + batch_size]
                vs = embedded(part.content.fillna("").tolist())
                ok = [v is not None for v in vs]
                if any(ok):
                    yield pd.DataFrame({"id": part.id[ok], "embedding": [v for v in vs if v is not None]})

    return rows.select("id", "content").mapInPandas(run, "id long, embedding array<float>")


def l2_normalize(col: Column) -> Column:
    """V2: divided by the length; a zero vector stays."""
    v = col.cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


#: What vectors are near to when they are put in blocks, at most; blocks are looked at without bounds where there are as few as FEW of them.
PIVOTS, FEW = 2048, 8
#: Bytes of the blocks' centres that are sent to all tasks: with more vectors, blocks grow.
CENTRE_BYTES = 64 << 20
#: Rounding errors of a bound.
SLACK = 1e-9


def unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def packed(df: DataFrame, key: str, block: int, level: str | None = None) -> DataFrame:
    """Rows of up to `block` vectors: ids, and a matrix of vectors of length 1, row by row; and a level of each, if asked for."""
    extra = [level] if level else []

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k in range(0, len(pdf), block):
                part = pdf.iloc[k : k + block]
                yield pd.DataFrame({f"{key}s": [part[key].to_numpy(np.int64).tobytes()], f"{key}_m": [unit(part.embedding).tobytes()]} | {c: [part[c].to_numpy(np.float64).tobytes()] for c in extra})

    schema = f"{key}s binary, {key}_m binary" + "".join(f", {c} binary" for c in extra)
    return df.filter("embedding is not null").select(key, "embedding", *extra).mapInPandas(run, schema)


def best_of(q: bytes, qm: bytes, v: bytes, vm: bytes, k: int) -> pd.DataFrame:
    """The k best vectors of a block for each query of a block; ties by vec_id.

    A matrix product's last digits depend on a vector's place in its block, so those near the k-th best are summed up once more, each by itself: equal vectors are
    equally similar in any block.
    """
    q, v = np.frombuffer(q, np.int64), np.frombuffer(v, np.int64)
    qm, vm = np.frombuffer(qm).reshape(len(q), -1), np.frombuffer(vm).reshape(len(v), -1)
    s = vm @ qm.T
    level = np.partition(s, -k, axis=0)[-k] if len(v) > k else np.full(len(q), -2.0)
    col, row = np.nonzero((s >= level - SLACK).T)
    exact = np.concatenate([(vm[row[i : i + 65536]] * qm[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    order = np.lexsort((v[row], -exact, col))
    col, row, exact = col[order], row[order], exact[order]
    top = np.arange(len(col)) - np.searchsorted(col, col) < k
    return pd.DataFrame({"query_id": q[col[top]], "vec_id": v[row[top]], "similarity": exact[top]})


def looked_at(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs of a block of queries and a block of vectors -> the k best of each for each query."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for q, qm, v, vm in zip(pdf.query_ids, pdf.query_id_m, pdf.vec_ids, pdf.vec_id_m, strict=True):
                yield best_of(q, qm, v, vm, k)

    return pairs.select("query_ids", "query_id_m", "vec_ids", "vec_id_m").mapInPandas(run, "query_id long, vec_id long, similarity double")


def first_k(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def worth_bounds(m: np.ndarray, k: int) -> bool:
    """Do the balls of a sample, dealt to as many pivots as its root, rule out most of them for most of its vectors?"""
    home = (m @ m[: int(len(m) ** 0.5)].T).argmax(1)
    own = [m[home == h] for h in np.unique(home)]
    centres = np.stack([x.mean(0) for x in own])
    bound = m @ centres.T + [np.linalg.norm(x - c, axis=1).max() for x, c in zip(own, centres, strict=True)]
    level = np.partition(m @ m.T, -min(k + 1, len(m)), axis=1)[:, -min(k + 1, len(m))]
    return bool((bound >= level[:, None]).mean() < 0.5)


def balls(base: DataFrame, pivots: np.ndarray, n: int, block: int) -> DataFrame:
    """base(vec_id, embedding) -> written blocks of neighbours: ids, matrix, centre and radius of a ball that holds them, number of vectors.

    Vectors go to the nearest of the pivots; a range sort by pivot and id cuts pivots of many vectors.
    """

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(home=(unit(pdf.embedding) @ pivots.T).argmax(1).astype("int32")) if len(pdf) else pdf.assign(home=pd.Series(dtype="int32"))

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in it:
            for _, part in pdf.groupby("home", sort=False):
                if held and held[0].home.iloc[0] != part.home.iloc[0]:
                    yield ball(pd.concat(held))
                    held = []
                held.append(part)
                while sum(map(len, held)) >= block:
                    rows = pd.concat(held)
                    yield ball(rows.iloc[:block])
                    held = [rows.iloc[block:]] if len(rows) > block else []
        if held:
            yield ball(pd.concat(held))

    def ball(part: pd.DataFrame) -> pd.DataFrame:
        m = unit(part.embedding)
        centre = m.mean(0)
        radius = float(np.linalg.norm(m - centre, axis=1).max())
        return pd.DataFrame({"vec_ids": [part.vec_id.to_numpy(np.int64).tobytes()], "vec_id_m": [m.tobytes()], "centre": [centre.tobytes()], "radius": [radius], "size": [len(part)]})

    kind = dict(base.dtypes)["embedding"]
    dealt = base.filter("embedding is not null").select(F.col("vec_id").cast("long"), "embedding").mapInPandas(near, f"vec_id long, embedding {kind}, home int")
    parts = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (64 * block))
    dealt = dealt.repartitionByRange(parts, "home", "vec_id").sortWithinPartitions("home", "vec_id")
    blocks = dealt.mapInPandas(pack, "vec_ids binary, vec_id_m binary, centre binary, radius double, size long")
    path = scratch(base.sparkSession, "balls")
    blocks.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return base.sparkSession.read.schema("vec_ids binary, vec_id_m binary, centre binary, radius double, size long, block long").parquet(path)


def cosine_topk(queries: DataFrame, base: DataFrame, k: int = 5, block: int = 2048, told: Observation | None = None, bounds: bool | None = None) -> DataFrame:
    """V3: queries(query_id, embedding), base(vec_id, embedding) -> query_id, vec_id, similarity, rank 1..k; ties by vec_id.

    Both sides are packed to blocks of bounded size, and what meets is blocks: a matrix product, and the k best of it per query, which alone are
    shuffled. Where there are few blocks of vectors, all are looked at. Else neighbours share a block, and its ball bounds what a query can find in it: product
    with the centre, plus radius. Each query looks first at the blocks of the highest bounds that hold k vectors; the k-th best of these rules out all blocks of lower bounds.
    Bounds pay where vectors lie in clusters, and cost a shuffle where they do not: unless `bounds` says, a bounded sample of vectors, from which pivots are taken too,
    decides. Results are exact either way. told: observes `looked_at`, the pairs of a query and a block beyond the first look, once the result has run, where bounds are used.
    """
    spark = base.sparkSession
    size = base.filter("embedding is not null").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    block = max(block, -(-size.n * 8 * (size.dim or 1) // CENTRE_BYTES))
    sample = None
    if size.n > FEW * block and bounds is not False:
        rows = base.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(PIVOTS).toPandas()
        sample = unit(rows.embedding)
    if sample is None or not (bounds or worth_bounds(sample, k)):
        return first_k(looked_at(packed(base, "vec_id", block).crossJoin(packed(queries, "query_id", 2048)), k), k)
    blocks = balls(base, sample[: int(size.n**0.5) + 1], size.n, block)
    summary = blocks.select("block", "centre", "radius", "size").orderBy("block").toPandas()  # CENTRE_BYTES at most, but for pivots' last blocks
    numbers, sizes, radius = summary.block.to_numpy(), summary["size"].to_numpy(), summary.radius.to_numpy()
    sent = spark.sparkContext.broadcast((np.stack([np.frombuffer(c) for c in summary.centre]), radius, numbers, sizes))

    def wanted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first look (without levels) or all others (with them): queries of a block, by the block of vectors."""
        centres, radius, numbers, sizes = sent.value
        for pdf in it:
            for r in pdf.itertuples(index=False):
                q, qm = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.query_id_m).reshape(-1, centres.shape[1])
                bound = qm @ centres.T + radius
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                take = first if not hasattr(r, "level") else ~first & (bound + SLACK >= np.frombuffer(r.level)[:, None])
                for b in np.flatnonzero(take.any(0)):
                    rows = take[:, b]
                    yield pd.DataFrame({"block": [numbers[b]], "query_ids": [q[rows].tobytes()], "query_id_m": [qm[rows].tobytes()], "pairs": [int(rows.sum())]})

    schema = "block long, query_ids binary, query_id_m binary, pairs long"
    asked = queries.select(F.col("query_id").cast("long"), "embedding")
    one = first_k(looked_at(packed(asked, "query_id", 256).mapInPandas(wanted, schema).join(blocks, "block"), k), k)
    path = scratch(spark, "first-look")
    one.select("query_id", "vec_id", "similarity", "rank").write.parquet(path)
    one = spark.read.schema("query_id long, vec_id long, similarity double, rank int").parquet(path)
    level = one.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("similarity"))).alias("level"))
    again = asked.join(level, "query_id").withColumn("level", F.coalesce("level", F.lit(-2.0)))
    pairs = packed(again, "query_id", 256, "level").mapInPandas(wanted, schema)
    if told is not None:
        pairs = pairs.observe(told, F.coalesce(F.sum("pairs"), F.lit(0)).alias("looked_at"))
    two = looked_at(pairs.join(blocks, "block"), k)
    return first_k(one.drop("rank").unionByName(two), k)


def hydrate_hits(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """V4: hits with the content and metadata of rows(vec_id, content, metadata)."""
    return hits.join(rows, "vec_id")
