"""ARC to WARC, token files, Ogg: exact round trips and damaged input."""

import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import ogg, tokens, warc

PAGES = "page_id long, url string, html string, lang string, payload binary"


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://a/x y", long), (9, "http://a/2", long), (5, None, long), (2, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", "n" * 2000), (7, "u", ""), (7, "u", "")]
    df = spark.createDataFrame([(*r, "xx", None) for r in rows], PAGES).repartition(3)
    got = {(r.page_id, r.payload_digest, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(spark, df).collect()}
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == long and i != 9
        want.add((i, hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None, len(b)))
    assert got == want


def test_warc_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_arc_versions_and_damage():
    rec = warc.http_block(3, b"body")
    for version in (1, 2):
        data = warc.member(warc.arc_filedesc("f", version, "20240101000000")) + warc.member(warc.arc_record(version, "f", 9, "http://u", "20240102030405", rec))
        (r,) = warc.parse_arc(data, "f")
        assert r["block"] == rec and r["url"] == "http://u" and r["date"] == "20240102030405"
        short = warc.member(warc.arc_filedesc("f", version, "20240101000000")) + warc.member(warc.arc_record(version, "f", 9, "http://u", "20240102030405", rec).replace(b"body", b"bod"))
        with pytest.raises(ValueError, match="declared"):
            list(warc.parse_arc(short, "f"))


def test_members_of_large_records():
    data = warc.member(b"a" * (17 << 20)) + warc.member(b"b")
    assert [len(x) for _, x in warc.members(data)] == [17 << 20, 1]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(data[:100]))


ODD_TEXTS = ["", None, "a  b", " x \n y ", "it's\tfine\r\n", "été là  ça", " ", "x" * 5000, "a b c", "1 2 3 ​ 4", "same text", "same text", "<|endoftext|> z"]


def encoder():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    """Ids by the library's own call, packed."""
    from tokenizers import Tokenizer

    return [np.array(Tokenizer.from_file(encoder()).encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


def test_encoder_is_the_library():
    e = tokens.Encoder(encoder())
    named = [f"a {s}{t}" for s in e.special for t in ("", " b", "<|", " " + s)]
    assert named
    texts = [t or "" for t in ODD_TEXTS] + [f"word{i} other{i % 7}\nnext line {i}." for i in range(30)] + named
    for _ in range(2):  # then from the table
        assert e.encode(texts) == plain(texts)


def test_token_files(spark):
    rows = [(100 - i if i != 3 else None, t, i) for i, t in enumerate(ODD_TEXTS)] + [(100, "again", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    from quire.llm.common import fresh_path

    path = fresh_path(spark, "t")
    tokens.write_tokens(df, path, encoder(), 2, shard_bytes=2000)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: (r.shard, r.frame))
    e, start = tokens.Encoder(encoder()), 0
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len({r.shard for r in got}) > 1
    for r, (d, t, _) in zip(got, want, strict=True):
        ids = np.append(np.frombuffer(plain([t or ""])[0], e.dtype), 2).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = spark.createDataFrame([(got[0].shard, got[0].frame), (got[-1].shard, got[-1].frame)], "shard long, frame long")
    assert sorted(len(r.ids) for r in tokens.fetch(spark, path, some).collect()) == sorted([got[0].n_tokens, got[-1].n_tokens])
    assert tokens.read_tokens(spark, path).count() == len(rows)


def test_shard_checksums():
    data = bytearray(tokens.shard(4, [(1, b"\1\0\2\0"), (2, b"\3\0" * 500)], 2))
    s = tokens.Shard(bytes(data))
    assert s.number == 4 and s.tokens == 502 and s.ids(1).tolist() == [3] * 500
    begin = int(s.begin[1])
    data[begin + 12] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or the checksum's
        tokens.Shard(bytes(data)).ids(1)


def test_token_files_of_nothing(spark):
    from quire.llm.common import fresh_path

    path = fresh_path(spark, "t")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, encoder(), 2)
    assert tokens.read_tokens(spark, path).count() == 0


def slow_crc(page: bytes) -> int:
    c = 0
    for b in page:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 255 * 16, 70_000, 200_001])
def test_ogg_round_trip(n):
    text = ("ab é\n" * n)[:n]
    payload, size = ogg.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, size) and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
    media = ogg.encode(payload, size)
    assert media == ogg.encode(payload, size)
    back, length, facts = ogg.decode(media)
    assert back == payload and length == size and facts["streams"] == 2
    for serial, _, _, granule, _, _ in ogg.read_pages(media):
        assert granule >= -1 and serial


def test_ogg_crc_and_damage():
    media = ogg.encode(b"x" * 128, 100)
    assert ogg.crc(media[:50]) == slow_crc(media[:50])
    for at in (30, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.decode(media[:-10])


def test_ogg_packets_over_pages():
    packets = [(b"h", 0), (b"a" * 255, 1), (b"b" * 70_000, 2), (b"", 3), (b"c" * 510, 4)]
    pages = ogg.pages_of(packets, 7)
    assert len(pages) > 2
    assert [p for p, _ in ogg.demultiplex(b"".join(pages))[7]] == [p for p, _ in packets]


def test_ogg_dates_every_packet():
    """Packets of known lengths lie one after another; the stream's last may be cut by its granule position."""
    sizes = [300, 70_000, 5, 0, 4000, 120_000, 7]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    packets = [(b"h", 0)] + [(b"a" * n, e) for n, e in zip(sizes, ends)]
    read = lambda ps: ogg.demultiplex(b"".join(ogg.pages_of(ps, 7)))[7][1:]
    assert any(g is None for _, g in read(packets))
    assert ogg.dated(read(packets), len, 1) == [(e - n, e) for n, e in zip(sizes, ends)]
    cut = [*packets[:-1], (b"a" * 7, ends[-1] - 3)]
    assert ogg.dated(read(cut), len, 1)[-1] == (ends[-2], ends[-1] - 3)
    for bad in ([*packets[:-1], (b"a" * 7, ends[-1] + 1)], [(b"h", 0), (b"a" * 61_000, 60_000), (b"b" * 9, 61_009)]):
        with pytest.raises(ogg.OggError):
            ogg.dated(read(bad), len, 1)
    payload, size = ogg.payload_of("x" * 10_000)
    assert ogg.decode(ogg.encode(payload, size))[2]["times"] == [(0, 4096 / 8000), (4096 / 8000, 8192 / 8000), (8192 / 8000, len(payload) / 8000)]


def test_ogg_query(spark):
    df = spark.createDataFrame([(1, "same", "z"), (2, "same", "z"), (None, None, "z"), (4, "", "z")], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in ogg.from_media(ogg.to_media(df)).collect()}
    assert rows[1].media_sha256 == rows[2].media_sha256 and rows[1].feature == rows[2].feature
    assert rows[None].payload_sha256 == rows[4].payload_sha256 == hashlib.sha256(b"\0" * 64).hexdigest()
    assert rows[1].payload_sha256 == hashlib.sha256(b"same" + b"\0" * 60).hexdigest() and rows[1].tail_crc32 == zlib.crc32(b"same" + b"\0" * 60)
    assert ogg.from_media(ogg.to_media(df.limit(0))).count() == 0
