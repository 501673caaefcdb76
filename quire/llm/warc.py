"""Legacy archive converter: ARC files of versions 1 and 2 become WARC/1.0 files.

ARC: a file begins with a `filedesc://` record whose second line names the version
and whose third line lists the fields of the header lines that follow:

    version 1: URL IP-address Archive-date Content-type Archive-length
    version 2: URL IP-address Archive-date Content-type Result-code Checksum
               Location Offset Filename Archive-length

Each record is its header line, exactly the declared number of bytes and a newline.
Both formats are kept as one gzip member per record, as is usual.

The converter synthesises what ARC lacks: record identifiers (a name-based UUID of
file, offset and URL, so a repeated run gives the same ones), ISO timestamps, record
types, and SHA-1 digests of block and payload. Of the records with equal payloads of
at least `min_revisit` bytes, the one with the largest page number stays a response;
the others become revisit records that keep the HTTP header and name it.

Defined cases: null html is an empty payload; a null url is written as
`urn:page:unknown`; a null page_id stays null (its header is left out) and counts as
the smallest number; repeated rows are records of their own; among equal page numbers
the record identifier decides; an empty table gives no rows; further columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh_path, read_binary, remove, write_binary, written

V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BLOB = pa.schema([("blob", pa.binary())])
DIGITS = re.compile(r"\d{14}")


def member(data: bytes) -> bytes:
    """One gzip member. Its last byte is the length's highest, 0 below 16 MiB; beyond, a 0 is added, which gzip readers skip."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + b"\0"


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        z, view, parts, to = zlib.decompressobj(31), memoryview(data), [], at
        while not z.eof:
            if to >= len(data):
                raise ValueError(f"gzip member at {at} is cut off")
            parts.append(z.decompress(view[to : to + 65536]))
            to += 65536
        yield at, b"".join(parts)
        at = min(to, len(data)) - len(z.unused_data)


def digest32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def hex_of(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def arc_filedesc(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 quire\n{V1 if version == 1 else V2}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    return (head + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n").encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", hashlib.md5(block, usedforsecurity=False).hexdigest(), "-", str(offset), name]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def url_field(url: str | None) -> str:
    """White space and control characters would end the field: percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:page:unknown"


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """pages(page_id, url, html) -> ARC files, one for each partition, versions 1 and 2 in turn."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, version = f"quire-{part:06d}.arc.gz", 1 + part % 2

        def out() -> Iterator[tuple]:
            offset = 0
            for batch in it:
                for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if not offset:
                        first = member(arc_filedesc(name, version, date))
                        offset = len(first)
                        yield (first,)
                    block = http_block(i, (html or "").encode())
                    m = member(arc_record(version, name, offset, url_field(url), date, block))
                    offset += len(m)
                    yield (m,)

        yield from batches(out(), BLOB)

    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    write_binary(cols.mapInArrow(rows, "blob binary"), "blob", path, 0)


def parse_arc(data: bytes, path: str) -> Iterator[dict]:
    """The records of one ARC file after its file description, by the version this declares."""
    fields: list[str] = []
    for offset, rec in members(data):
        line, _, rest = rec.partition(b"\n")
        values = line.decode("utf-8", "surrogateescape").split(" ")
        if not fields:
            if not values[0].startswith("filedesc://"):
                raise ValueError(f"{path}: no file description")
            version, names = rest.split(b"\n")[:2]
            fields = names.decode().split(" ")
            if {b"1": V1, b"2": V2}.get(version.split(b" ")[0]) != " ".join(fields):
                raise ValueError(f"{path}: version {version!r} with fields {fields}")
            name = values[0].removeprefix("filedesc://")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{path} at {offset}: {len(values)} fields instead of {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        size = int(head["Archive-length"])
        if len(rest) != size + 1:
            raise ValueError(f"{path} at {offset}: {len(rest) - 1} bytes, {size} declared")
        yield {"file": name, "offset": offset, "url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "mime": head["Content-type"], "block": rest[:size]}


def page_of(http: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)", http)
    return int(m[1]) if m else None


RECORDS = "record_id string, page_id long, uri string, warc_date string, ip string, http binary, payload binary, sha1 binary"


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """ARC files -> one row per record, with what WARC wants made up from it."""
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("warc_date", pa.string()), ("ip", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("sha1", pa.binary())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in it:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for r in parse_arc(data.as_py(), name):
                        http, sep, payload = r["block"].partition(b"\r\n\r\n")
                        rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['file']}#{r['offset']}#{r['url']}")
                        d = r["date"] if DIGITS.fullmatch(r["date"]) else "19700101000000"
                        when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"
                        yield f"urn:uuid:{rid}", page_of(http + sep), r["url"], when, r["ip"], http + sep, payload if with_payload else len(payload).to_bytes(8, "big"), hashlib.sha1(payload, usedforsecurity=False).digest()

        yield from batches(out(), schema)

    return read_binary(spark, path).mapInArrow(rows, RECORDS)


def revisits(records: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(record_id, refers_id, refers_to) of the records that another one with an equal payload stands for.

    records: from read_arc(with_payload=False). Each digest is first summed up to its
    largest page (map-side), and only digests with several records are joined back.
    """
    ids = records.filter(F.conv(F.hex("payload"), 16, 10).cast("long") >= min_revisit).select("record_id", "sha1", F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "record_id").alias("r"))
    best = ids.groupBy("sha1").agg(F.max("r").alias("best"), F.count("*").alias("n")).filter("n > 1")
    out = ids.join(best, "sha1").filter("record_id <> best.record_id")
    return out.select("record_id", F.col("best.record_id").alias("refers_id"), F.nullif(F.col("best.p"), F.lit(-(2**63))).alias("refers_to"))


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Records with (refers_id, refers_to) -> WARC files, one for each partition, each opened by a warcinfo record."""
    cols = records.select("record_id", "page_id", "uri", "warc_date", "ip", "http", "payload", "sha1", "refers_id", "refers_to")

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun = TaskContext.get().partitionId(), False

        def out() -> Iterator[tuple]:
            nonlocal begun
            for batch in it:
                for row in batch.to_pylist():
                    if not begun:
                        begun = True
                        info = [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'quire-{part}')}>"), ("WARC-Date", row["warc_date"]), ("WARC-Filename", f"quire-{part:06d}.warc.gz"), ("Content-Type", "application/warc-fields")]
                        yield (member(warc_record("warcinfo", info, b"software: quire\r\nformat: WARC File Format 1.0\r\n")),)
                    kind = "revisit" if row["refers_id"] else "response"
                    block = row["http"] + (b"" if row["refers_id"] else row["payload"])
                    head = [("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", digest32(row["sha1"])), ("WARC-Block-Digest", digest32(hashlib.sha1(block, usedforsecurity=False).digest()))]
                    if row["refers_id"]:
                        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{row['refers_id']}>")]
                        head += [] if row["refers_to"] is None else [("X-Refers-To-Page", str(row["refers_to"]))]
                    yield (member(warc_record(kind, [*head, ("Content-Type", "application/http; msgtype=response")], block)),)

        yield from batches(out(), BLOB)

    write_binary(cols.mapInArrow(rows, "blob binary"), "blob", path, 0)


def parse_warc(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record, by its declared length."""
    if not rec.startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {rec[:20]!r}")
    head, _, rest = rec.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: block does not end at its declared length")
    return fields, rest[:size]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files -> a row for each response and revisit; digests of blocks and payloads are checked."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for batch in it:
                for data in batch.column(1):
                    for _, rec in members(data.as_py()):
                        h, block = parse_warc(rec)
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, sep, payload = block.partition(b"\r\n\r\n")
                        if digest32(hashlib.sha1(block, usedforsecurity=False).digest()) != h["warc-block-digest"]:
                            raise ValueError(f"{h['warc-record-id']}: block digest differs")
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", http + sep)[1])
                        sha = hex_of(h["warc-payload-digest"])
                        if kind == "response" and (hashlib.sha1(payload, usedforsecurity=False).hexdigest() != sha or len(payload) != size):
                            raise ValueError(f"{h['warc-record-id']}: payload differs")
                        refers = h.get("x-refers-to-page")
                        yield page_of(http + sep), size, sha, kind, None if refers is None else int(refers), h["warc-record-id"][1:-1], h["warc-target-uri"], h["warc-date"]

        yield from batches(out(), schema)

    return read_binary(spark, path).mapInArrow(rows, READ)


def convert(spark: SparkSession, arc: str, warc: str, min_revisit: int = 1000) -> None:
    """ARC folder -> WARC folder. Two passes over the archives: digests alone first, so that payloads move once at most."""
    known = written(revisits(read_arc(spark, arc, with_payload=False), min_revisit), "revisits")
    records = read_arc(spark, arc)
    if known.isEmpty():
        out = records.withColumns({"refers_id": F.lit(None).cast("string"), "refers_to": F.lit(None).cast("long")})
    else:
        out = records.join(known, "record_id", "left")
    write_warc(out, warc)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages -> ARC -> WARC -> rows as read back."""
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    remove(spark, arc)
    return read_warc(spark, warc)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
