"""Token-ID files: independent zstandard frames, a trailing seek table and per-frame checksums.

A shard file, for documents in ascending order:

    frame 1 .. n    a zstandard frame per document: its token ids, 16 or 32 bits each, little-endian
    index           skippable frame 0x184D2A50: "QTOK", version, bytes per id, shard number (u32), n (u32),
                    tokens in the shard (u64), then doc_id (i64; smallest value for null) and token count (u32) of each document
    seek table      skippable frame 0x184D2A5E as in the public seekable format: compressed size, decompressed
                    size, checksum (low 32 bits of XXH64) of each frame, the index included with size 0;
                    n + 1 (u32), descriptor 0x80, magic 0x8F92EAB1

A reader fetches the table from the file's end, and then only the frames it wants.

Text is encoded with the tokenizers library. As this encodes each piece between a
space and the next on its own, equal pieces of a block of texts are looked up once, and
their ids kept in a table of two generations (the older is dropped when the younger is
full); texts in which a space stands elsewhere than between words (double spaces, odd
white space) go through the library whole, so that ids are always the library's own.

Documents are dealt to shards by ranges of doc_id and the text's hash, so that the order
of shards and frames is that of doc_id, and a doc_id that very many rows share is spread
over several. The shards' token totals, one row a file, are added up in one window.
Defined cases: repeated rows are documents of their own; null text is empty and has the end id alone; null doc_id comes first;
an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, fresh_path, pieces_by_size, read_binary, write_binary

INDEX, TABLE, MAGIC, NULL = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, -(2**63)
KEPT, BLOCK, ROWS = 250_000, 8_000_000, 3000  # ROWS: texts held as Python strings at once
#: Pieces on which the library might see other bounds than the space before them: white space after the space, or white space on which engines differ.
ODD = re.compile(r"\A(?:\s|\Z)|[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]|<\|")

#: The same of pieces joined by spaces: one that is empty or begins with white space.
SPACED = re.compile(r" (?:\s|\Z)")


class Kept:
    """Ids of pieces: up to KEPT recent ones and as many older; what is found among the older is recent again."""

    def __init__(self, most: int = KEPT):
        self.most, self.young, self.old = most, {}, {}

    def get(self, pieces: list[str]) -> tuple[list[bytes | None], list[int]]:
        """(ids of each, places of those without)."""
        out, lack = [*map(self.young.get, pieces)], []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            if (ids := self.old.get(pieces[k])) is None:
                lack.append(k)
            else:
                out[k] = self.young[pieces[k]] = ids
        return out, lack

    def add(self, new: dict[str, bytes]) -> None:
        self.young.update(new)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Encoder:
    """Token ids of texts by a tokenizers file."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.special = sorted({t.content for t in self.tok.get_added_tokens_decoder().values() if t.special})
        self.tok.encode_special_tokens = True  # pieces are plain text; a text that names a special token is encoded whole, by the plain call
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        self.width = np.array([len(self.tok.id_to_token(k) or "") for k in range(self.size)])  # a byte-level vocabulary writes one character a byte
        self.inner, self.first = Kept(), Kept()  # ids of a space and the piece; of a text's first piece

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str], n: int = 4000) -> Iterator[tuple[str, bytes]]:
        """(piece, packed ids of it after a space): encoded in one string and cut apart by the tokens' byte lengths."""
        w = self.dtype.itemsize
        for at in range(0, len(pieces), n):
            part = pieces[at : at + n]
            text = " " + " ".join(part)
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum(np.array([len(p) for p in part] if text.isascii() else [len(p.encode()) for p in part]) + 1)
            token_ends = np.cumsum(self.width[ids])
            last = np.searchsorted(token_ends, ends, side="left")
            if not len(token_ends) or token_ends[-1] != ends[-1] or (token_ends[last] != ends).any():
                yield from zip(part, self.raw([" " + p for p in part]), strict=True)  # a token reaches over a piece's end
                continue
            cuts, packed = ((last + 1) * w).tolist(), ids.tobytes()
            yield from zip(part, [packed[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True)

    def known(self, pieces: list[str], table: Kept, encode) -> tuple[list[bytes], list[int]]:
        """(packed ids of distinct pieces, places of odd ones, which have none)."""
        found, lack = table.get(pieces)
        odd = []
        if lack:
            names = [pieces[k] for k in lack]
            text = " ".join(["", *names])
            if SPACED.search(text) or ODD.search(text, 1):
                odd = [k for k in lack if ODD.search(pieces[k])]
                lack = [k for k in lack if not ODD.search(pieces[k])]
                names = [pieces[k] for k in lack]
            new = list(encode(names))
            for k, (_, ids) in zip(lack, new, strict=True):
                found[k] = ids
            for k in odd:
                found[k] = b""
            table.add(dict(new))
        return found, odd

    def block(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at, flat = cut.offsets.to_numpy(), cut.flatten()
        begins = np.zeros(len(flat), bool)
        begins[at[:-1]] = True
        inner, first = (flat.filter(pa.array(m)).dictionary_encode() for m in (~begins, begins))
        ids, odd = self.known(inner.dictionary.to_pylist(), self.inner, self.joined)
        n = len(ids)
        more, strange = self.known(first.dictionary.to_pylist(), self.first, lambda ps: zip(ps, self.raw(ps), strict=True))
        ids += more
        piece = np.empty(len(flat), np.int64)
        piece[~begins], piece[begins] = inner.indices.to_numpy(), first.indices.to_numpy().astype(np.int64) + n
        whole = []
        if odd or strange:
            bad = np.zeros(len(ids), bool)
            bad[[*odd, *(k + n for k in strange)]] = True
            whole = np.flatnonzero(np.logical_or.reduceat(bad[piece], at[:-1]))
        sizes = np.array([*map(len, ids)]) // self.dtype.itemsize
        # the pieces' ids, gathered into one array of the block's
        own = sizes[piece]
        ends = np.cumsum(own)
        where = np.repeat(((np.cumsum(sizes) - sizes)[piece] - (ends - own)).astype(np.int32), own)
        where += np.arange(ends[-1], dtype=np.int32)
        packed = np.frombuffer(b"".join(ids), self.dtype)[where].tobytes()
        cuts = (np.concatenate([[0], ends[at[1:] - 1]]) * self.dtype.itemsize).tolist()
        out = [packed[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for k, x in zip(whole, self.raw([texts[k] for k in whole]) if len(whole) else (), strict=True):
            out[k] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        at = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size > BLOCK or k == len(texts) - 1:
                out += self.block(texts[at : k + 1])
                at, size = k + 1, 0
        named = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if named:
            self.tok.encode_special_tokens = False
            try:
                for k, x in zip(named, self.raw([texts[k] for k in named]), strict=True):
                    out[k] = x
            finally:
                self.tok.encode_special_tokens = True
        return out


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One for each worker and file."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def shard(number: int, docs: list[tuple[int, bytes]], width: int) -> bytes:
    """A shard file from (doc_id, packed ids)."""
    z = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
    out, entries = [], []
    for _, ids in docs:
        frame = z.compress(ids)
        out.append(frame)
        entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
    counts = np.array([len(ids) // width for _, ids in docs], "<u4")
    body = b"QTOK" + struct.pack("<HHIIQ", 1, width, number, len(docs), int(counts.sum())) + np.array([d for d, _ in docs], "<i8").tobytes() + counts.tobytes()
    out.append(struct.pack("<II", INDEX, len(body)) + body)
    entries.append((len(body) + 8, 0, 0))
    table = np.array(entries, "<u4").tobytes() + struct.pack("<IBI", len(entries), 0x80, MAGIC)
    out.append(struct.pack("<II", TABLE, len(table)) + table)
    return b"".join(out)


class Shard:
    """Reads single documents of a shard file's bytes."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        self.data = memoryview(data)
        self.table = np.frombuffer(data, "<u4", 3 * n, len(data) - 9 - 12 * n).reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.begin[n - 1])
        kind, size = struct.unpack_from("<II", data, at)
        if kind != INDEX or data[at + 8 : at + 12] != b"QTOK":
            raise ValueError("no index")
        _, width, self.number, docs, self.tokens = struct.unpack_from("<HHIIQ", data, at + 12)
        self.dtype = np.dtype(f"<u{width}")
        self.doc_ids = np.frombuffer(data, "<i8", docs, at + 32)
        self.counts = np.frombuffer(data, "<u4", docs, at + 32 + 8 * docs)
        self.z = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """The token ids of the shard's k-th document; only its frame is decompressed."""
        raw = self.z.decompress(self.data[self.begin[k] : self.begin[k + 1]], max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"shard {self.number}, frame {k}: checksum differs")
        return np.frombuffer(raw, self.dtype)


def write_tokens(docs: DataFrame, path: str, file: str, end_id: int, shard_bytes: int = 24 << 20) -> None:
    """docs(doc_id, text) -> shard files of about `shard_bytes` of text each, in ascending doc_id order."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n
    parts = docs.repartitionByRange(pieces_by_size(size, shard_bytes), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        end = np.array([end_id], enc.dtype).tobytes()
        held = []
        for batch in it:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                held += zip((NULL if d is None else d for d in part.column(0).to_pylist()), (x + end for x in enc.encode(texts)), strict=True)
                del part, texts
                pa.default_memory_pool().release_unused()
        if held:
            yield pa.record_batch([pa.array([shard(TaskContext.get().partitionId(), held, enc.dtype.itemsize)], pa.binary())], names=["blob"])

    write_binary(parts.mapInArrow(rows, "blob binary"), "blob", path, 0x8F)


def little_endian(at: str, n: int) -> Column:
    """The unsigned integer of n bytes of content, from a 1-based place on."""
    digits = ", ".join(f"hex(substring(content, {at} + {k}, 1))" for k in reversed(range(n)))
    return F.expr(f"cast(conv(concat({digits}), 16, 10) as bigint)")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Shard files -> doc_id, start, n_tokens, ids_crc32, shard, frame.

    start: tokens of all documents before it. A first, JVM-only pass takes each shard's
    number and token total out of its index: one row per file, which a window adds up.
    """
    files = read_binary(spark, path).filter("length(content) > 0")
    n = files.select("content", little_endian("length(content) - 8", 4).alias("n"))
    # the index's size stands in its own entry, the table's last; the index ends where the table's frame of 8 + 12 n + 9 bytes begins
    n = n.select("content", (F.length("content") - 17 - 12 * F.col("n")).alias("to"), little_endian("length(content) - 20", 4).alias("size"))
    n = n.select(little_endian("to - size + 17", 4).alias("shard"), little_endian("to - size + 25", 8).alias("tokens"))
    before = n.select("shard", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()), ("frame", pa.int64())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in it:
                for data in batch.column(1):
                    s, at = Shard(data.as_py()), 0
                    for k, d in enumerate(s.doc_ids.tolist()):
                        ids = s.ids(k)
                        yield None if d == NULL else d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), s.number, k
                        at += len(ids)

        yield from batches(out(), schema, 10_000)

    docs = files.mapInArrow(rows, "doc_id long, at long, n_tokens long, ids_crc32 long, shard long, frame long")
    return docs.join(before, "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "frame")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of wanted(shard, frame): only the frames asked for are decompressed.

    The wanted frames of a shard are gathered to one list, which a shard's size bounds.
    """
    lists = wanted.groupBy("shard").agg(F.collect_set("frame").alias("frames"))
    files = read_binary(spark, path).filter("length(content) > 0")
    named = files.select("path", "content", F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("shard"))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data, frames in zip(batch.column("content"), batch.column("frames").to_pylist(), strict=True):
                s = Shard(data.as_py())
                yield pa.record_batch([pa.array([None if s.doc_ids[k] == NULL else int(s.doc_ids[k]) for k in frames], pa.int64()), pa.array([s.ids(k).astype(np.int32) for k in frames], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return named.join(lists, "shard").select("content", "frames").mapInArrow(rows, "doc_id long, ids array<int>")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path)
