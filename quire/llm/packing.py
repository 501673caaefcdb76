"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost (attention grows faster than
length). Pieces come longest first; each goes to the open bin that it leaves fullest.
If none has room, a bin is opened of the size that costs least per token it is expected
to hold, given the lengths still to come (for a piece of length l and capacity c: l plus
as much of the rest as fits, for what the remaining pieces can fill). At the end each
bin is cut down to the smallest permitted length that holds its contents.

Lengths are counts of token ids: those of op2's tokenizer, and one for the end id, so that
start and length address the token stream that op2 writes. A document longer than the
largest length is cut into pieces of that length and a rest.

Documents are dealt to groups of about `group_rows` by a hash of id and text length, and
each group is packed alone: with thousands of pieces to a group the loss against one
global packing is a few bins. Groups hold numbers only (24 bytes a piece), so that even a
group that many repeated rows make larger is no burden. A full-length piece is a bin of
its own; it needs no group and never enters one.

Defined cases: null or blank text has nothing to train on and goes to no bin (length 0, bin_id null, one row);
rows with equal doc_id and length are packed as rows of their own; null doc_id is kept;
an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_by_size, written
from .tokens import encoder

CAPACITIES = (256, 512, 1024, 2048)
OUT = "doc_id long, piece int, start long, length int, bin_id string, bin_size int, bin_offset int"


def cost(capacity: int) -> float:
    """Of a sequence: a linear part, an attention part that is as large at 4096 tokens, and a fixed start."""
    return 16 + capacity * (1 + capacity / 4096)


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, bin's final size, offset in the bin) of each piece; lengths are in 1..max(capacities).

    Open bins are kept by the room left in them; a sorted list of the rooms in use finds
    the tightest in O(log). Equal rooms: the bin opened first; equal lengths: in input order.
    """
    caps = sorted(capacities)
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rooms: list[int] = []  # distinct rooms with open bins, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    left = int(lengths.sum())  # tokens not yet placed
    count = np.bincount(lengths, minlength=caps[-1] + 1)
    below = np.cumsum(count * np.arange(len(count)))  # tokens in pieces of at most so many
    for k in order:
        size = int(lengths[k])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop(0)
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            # what may join the piece: the rest of the bin, if pieces that small are still to come
            c = min((c for c in caps if c >= size), key=lambda c: (cost(c) / (size + min(c - size, left - size, int(below[min(c - size, size)]))), c))
            b, room = len(used), c
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        left -= size
        if room > size:
            if room - size not in by_room:
                bisect.insort(rooms, room - size)
                by_room[room - size] = [b]
            else:
                bisect.insort(by_room[room - size], b)
    final = np.array([caps[bisect.bisect_left(caps, u)] for u in used], np.int64)
    return bins, final[bins] if n else bins, offsets


def word_count(text: str | Column = "text") -> Column:
    """Words of a text, and one for the end; 0 if there is none."""
    col = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+", " "))
    return F.when(col == "", 0).otherwise(F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit(""))) + 2).cast("long")


def token_counts(docs: DataFrame, file: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens: token ids of the text and the end id; 0 for a text that is null or blank."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("byte_bpe_50k.json")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for b in it:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [len(ids) // enc.dtype.itemsize + 1 if t.strip(" \t\n\x0b\f\r") else 0 for t, ids in zip(texts, enc.encode(texts), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_tokens long")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, group_rows: int = 20_000) -> DataFrame:
    """docs(doc_id, n_tokens) -> a row for each piece: bin, final bin size, offset in the bin."""
    top, caps = max(capacities), list(capacities)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"))
    docs = written(docs, "lengths")  # texts are counted once, not for whole pieces and rests each
    rows = docs.agg(F.count("*").alias("n")).first().n
    groups = pieces_by_size(rows, group_rows)
    whole = docs.filter(F.col("n") >= top).select("doc_id", "n", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0), (F.col("n") / top).cast("int") - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", (F.col("piece") * F.lit(top).cast("long")).alias("start"), F.lit(top).alias("length"), F.concat_ws("-", F.lit("full"), F.col("row"), F.col("piece")).alias("bin_id"), F.lit(top).alias("bin_size"), F.lit(0).alias("bin_offset"))
    rest = docs.filter((F.col("n") % top > 0) | (F.col("n") == 0))
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(groups)).cast("int")
    rest = rest.select(salt.alias("g"), "doc_id", (F.col("n") / top).cast("int").alias("piece"), (F.col("n") % top).cast("int").alias("length"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        out = pd.DataFrame({"doc_id": pdf.doc_id, "piece": pdf.piece, "start": pdf.piece.astype("int64") * top, "length": pdf.length})
        full = pdf.length.to_numpy() > 0
        bins, size, at = pack(pdf.length.to_numpy()[full].astype(np.int64), caps)
        out["bin_id"], out["bin_size"], out["bin_offset"] = None, pd.array([None] * len(pdf), "Int32"), pd.array([None] * len(pdf), "Int32")
        out.loc[full, "bin_id"] = [f"{pdf.g[0]}-{b}" for b in bins]
        out.loc[full, "bin_size"], out.loc[full, "bin_offset"] = size, at
        return out

    packed = rest.groupBy("g").applyInPandas(group, OUT)
    return whole.unionByName(packed)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(token_counts(docs))
