"""Ogg media columns: physical streams of pages, verified and taken apart.

A text's bytes, padded with zeros to a positive multiple of 64, are stored as 8-bit
samples (one byte a sample) in an Ogg physical stream of two logical streams, pages
interleaved: `pcm`, a header packet with the rate and data packets of up to 4096
samples, with granule positions that count samples; and `meta`, a header packet and a
comment packet with the unpadded length. The reader knows nothing of the writer: it
finds pages, verifies their CRC-32 (polynomial 0x04C11DB7, most significant bit first),
checks page sequence numbers, splits pages' data into packets by lacing values (255 goes
on, also into the next page), separates streams by serial number and dates each packet by
its page's granule position and the lengths of the packets after it on the page.

Serial numbers come from the content, so equal texts have equal media.
Defined cases: null or empty text is 64 zero bytes; repeated rows stay; a null doc_id
stays null; an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, written

RATE, PACKET, PAGE = 8000, 4096, 60_000
PCM, META = b"QPCM", b"QMETA"
FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def crc(page: bytes) -> int:
    """Ogg's CRC-32: zlib's of the bit-reversed bytes, reversed, with zero for its start and final masks."""
    x = zlib.crc32(page.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{x:032b}"[::-1], 2)


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); packets may go on into further pages."""
    out: list[bytes] = []
    segs, data, granule, size, open_ = bytearray(), [], -1, 0, False

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal segs, data, granule, size, open_
        flags = open_ * 1 | (not out) * 2 | last * 4
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, len(out), 0) + bytes([len(segs)]) + segs
        page = head + b"".join(data)
        out.append(page[:22] + struct.pack("<I", crc(page)) + page[26:])
        segs, data, granule, size, open_ = bytearray(), [], -1, 0, goes_on

    for k, (packet, end) in enumerate(packets):
        laces, at = lacing(len(packet)), 0
        while laces:
            fit = laces[: 255 - len(segs)]
            n = sum(fit)
            segs += fit
            data.append(packet[at : at + n])
            at, size, laces = at + n, size + n, laces[len(fit) :]
            if not laces:
                granule = end
            if k == 0 and not laces:
                flush(len(packets) == 1, False)  # a stream's first page holds its header alone
            elif len(segs) == 255 or size >= PAGE:
                flush(k == len(packets) - 1 and not laces, bool(laces))
    if segs:
        flush(True, False)
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload's samples as an Ogg file."""
    serial = zlib.crc32(payload)
    samples = [(PCM + struct.pack("<HIB", 1, RATE, 8), 0)] + [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    meta = [(META + struct.pack("<H", 1), 0), (f"LENGTH={n_bytes}".encode(), 0)]
    a, b = pages_of(samples, serial), pages_of(meta, serial ^ 0x5A5A5A5A)
    return b"".join([a[0], b[0], *[x for k in range(1, max(len(a), len(b))) for x in (a[k : k + 1] + b[k : k + 1])]])


class OggError(ValueError):
    pass


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, sequence number, flags, granule position, lacing values, body) of each page, checksums verified."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"OggS\0" or at + 27 > len(data):
            raise OggError(f"no page at {at}")
        _, _, flags, granule, serial, seq, sum_ = struct.unpack_from("<4sBBqIII", data, at)
        n = data[at + 26]
        segs = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(segs)
        if end > len(data):
            raise OggError(f"page at {at} is cut off")
        if crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != sum_:
            raise OggError(f"page at {at}: checksum differs")
        yield serial, seq, flags, granule, segs, data[at + 27 + n : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Serial number -> (packet, granule position: of the page, for the last packet that ends on it; dated() tells those between)."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    parts: dict[int, list[bytes]] = {}
    seqs: dict[int, int] = {}
    ended: set[int] = set()
    for serial, seq, flags, granule, segs, body in read_pages(data):
        if seq != seqs.get(serial, -1) + 1 or bool(flags & 2) != (seq == 0) or serial in ended:
            raise OggError(f"stream {serial}: page {seq} out of order")
        seqs[serial] = seq
        held, out, at, size = parts.setdefault(serial, []), streams.setdefault(serial, []), 0, 0
        if bool(held) != bool(flags & 1):
            raise OggError(f"stream {serial}: page {seq} doesn't go on as the last one ended")
        first = len(out)
        for s in segs:
            size += s
            if s < 255:
                held.append(body[at : at + size])
                out.append((b"".join(held), None))
                held.clear()
                at, size = at + size, 0
        if size or (segs and segs[-1] == 255):
            held.append(body[at:])
        if len(out) > first:
            out[-1] = (out[-1][0], granule)
        if flags & 4:
            ended.add(serial)
    if any(parts.values()) or ended != set(streams):
        raise OggError("a stream isn't ended")
    return streams


def dated(packets: list[tuple[bytes, int | None]], length: Callable[[bytes], int], rate: int) -> list[tuple[float, float]]:
    """(start, end) in seconds of each packet of a stream whose packets' lengths in samples are known.

    A page's granule position is that of the end of its last packet; those before it on the page lie before that by the
    lengths of what follows them. A position that disagrees with the packets since the one before is a fault; only the
    stream's last may lie before their sum, which cuts its packet short.
    """
    out: list[tuple[float, float]] = []
    at, first = 0, 0
    for k, (_, granule) in enumerate(packets):
        if granule is None:
            continue
        sizes = [length(p) for p, _ in packets[first : k + 1]]
        ends = [*accumulate(sizes, initial=at)]
        if granule > ends[-1] or granule < (ends[-2] if k == len(packets) - 1 else ends[-1]):
            raise OggError(f"packet {k}: granule position {granule} after {ends[-1]} samples")
        ends[-1] = granule
        out += [(a / rate, b / rate) for a, b in pairwise(ends)]
        at, first = granule, k + 1
    if first < len(packets):
        raise OggError("a last packet without a granule position")
    return out


def decode(media: bytes) -> tuple[bytes, int, dict]:
    """(payload, unpadded length, facts) of an Ogg file made of a pcm and a meta stream, told apart by their headers."""
    streams = demultiplex(media)
    kinds = {packets[0][0][:4]: packets for packets in streams.values()}
    pcm, meta = kinds[PCM], kinds[META[:4]]
    _, rate, bits = struct.unpack("<HIB", pcm[0][0][4:11])
    payload = b"".join(p for p, _ in pcm[1:])
    samples = pcm[-1][1]
    times = dated(pcm[1:], len, rate)
    if bits != 8 or samples != len(payload):
        raise OggError(f"{len(payload)} samples, granule position {samples}")
    return payload, int(meta[1][0].removeprefix(b"LENGTH=")), {"packets": len(pcm) - 1, "streams": len(streams), "seconds": times[-1][1], "times": times}


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64)), len(raw)


def feature(payload: bytes, facts: dict) -> str:
    """Loudness, zero crossings about the middle value, and the stream's shape."""
    x = np.frombuffer(payload, np.uint8)
    loud = float(np.sqrt(np.dot(y := x.astype(np.float32) - 128, y) / len(x)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"seconds={facts['seconds']:.6f};packets={facts['packets']};streams={facts['streams']};rms={loud:.4f};crossings={crossings};peak={int(x.max())}"


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, media (an Ogg file)."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((d, encode(*payload_of(t))) for b in it for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def from_media(media: DataFrame) -> DataFrame:
    """doc_id, media -> payload facts and features; a damaged file fails with its fault named."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in it:
                for d, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = m.as_py()
                    payload, n, facts = decode(data)
                    yield d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, facts)

        yield from batches(out(), schema)

    return media.select("doc_id", "media").mapInArrow(rows, READ)


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "ogg")
    return from_media(media)
