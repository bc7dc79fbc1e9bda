"""Ogg streams: exact round trips, page checksums bit by bit, timestamps, damage."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from chronoframe.llm import ogg, queries


def slow_checksum(data: bytes) -> int:
    register = 0
    for byte in data:
        register ^= byte << 24
        for _ in range(8):
            register = ((register << 1) ^ (0x04C11DB7 if register & 0x80000000 else 0)) & 0xFFFFFFFF
    return register


@pytest.mark.parametrize("data", [b"", b"OggS", bytes(range(256)), b"\xff" * 999])
def test_checksum_bit_by_bit(data):
    assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 191, 192, 254, 255, 3840, 3841, 65025, 200_000])
@pytest.mark.parametrize("packet", [255, ogg.PACKET, 90_000])
def test_round_trip(size, packet):
    payload = bytes(i * 7 % 251 for i in range(size))
    streams = ogg.read(ogg.write(payload, packet))
    assert ogg.payload_of(streams) == payload
    assert len(streams) == ogg.STREAMS
    for stream in streams.values():
        done = 0
        for data, seconds in stream.packets:
            done += len(data)
            assert seconds is None or seconds == done / ogg.RATE
        assert stream.granule == done


@pytest.mark.parametrize("hurt", ["flip", "cut", "swap", "drop"])
def test_damage_is_told(hurt):
    media = ogg.write(bytes(range(256)) * 200)
    second = media.index(b"OggS", 4)
    third = media.index(b"OggS", second + 4)
    damaged = {
        "flip": media[:60] + bytes([media[60] ^ 1]) + media[61:],
        "cut": media[:-1],
        "swap": media[third:] + media[:third],
        "drop": media[:third],
    }[hurt]
    with pytest.raises(ogg.DamagedStream):
        ogg.read(damaged)


def test_damaged_rows_stay(spark):
    stored = spark.createDataFrame([(1, 3, bytearray(b"junk")), (2, 3, None), (3, 3, bytearray(ogg.write(b"x" * 192)))], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r for r in ogg.load(stored).collect()}
    assert found[1].payload is None and found[1].damage
    assert bytes(found[3].payload) == b"x" * 192 and found[3].damage is None


def test_query_on_whole_texts(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = {}
    for row in queries.op6_ogg_media(spark, small).collect():
        payload = ogg.padded(texts[row.doc_id])
        assert len(payload) % 192 == 0 and len(payload) > 0
        assert row.damage is None
        assert (row.n_bytes, row.payload_bytes) == (len(texts[row.doc_id]), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-16:])
        told = (row.media_bytes, row.media_sha256, row.feature)
        assert seen.setdefault(texts[row.doc_id], told) == told


def test_packets_span_pages():
    """The registered packet does not fit its page: some pages go on with a packet of the one before."""
    media = ogg.write(bytes(i % 251 for i in range(40_000)))
    flags, at = [], 0
    while at < len(media):
        head = ogg.HEADER.unpack_from(media, at)
        flags.append(head[2])
        at += ogg.HEADER.size + head[7] + sum(media[at + ogg.HEADER.size : at + ogg.HEADER.size + head[7]])
    assert any(f & ogg.CONTINUED for f in flags)


def test_repeated_and_null_keys_stay(spark):
    rows = [(1, "river"), (1, "river"), (1, None), (None, "river"), (None, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, media string")
    found = ogg.load(ogg.store(docs)).collect()
    assert sorted(((r.doc_id, bytes(r.payload)) for r in found), key=repr) == sorted(((k, ogg.padded((t or "").encode())) for k, t in rows), key=repr)


def test_awkward(awkward, nothing):
    assert ogg.load(ogg.store(awkward)).filter("damage is null").count() == awkward.count()
    assert ogg.load(ogg.store(nothing)).count() == 0


def pages(media: bytes) -> list[tuple[int, bytes]]:
    """(serial, page) of each page."""
    out, at = [], 0
    while at < len(media):
        head = ogg.HEADER.unpack_from(media, at)
        end = at + ogg.HEADER.size + head[7] + sum(media[at + ogg.HEADER.size : at + ogg.HEADER.size + head[7]])
        out.append((head[4], media[at:end]))
        at = end
    return out


@pytest.mark.parametrize("lost", [1, 2])
def test_a_lost_stream_is_told(lost):
    media = ogg.write(bytes(i % 251 for i in range(24_000)))
    with pytest.raises(ogg.DamagedStream, match="1 of 2 streams"):
        ogg.read(b"".join(p for serial, p in pages(media) if serial != lost))


def test_headers_are_held_against_the_packets():
    (_, one), (_, two), *rest = pages(ogg.write(bytes(24_000)))
    (_, other), *_ = pages(ogg.write(bytes(24_001)))
    (_, faster), *_ = pages(ogg.write(bytes(24_000), rate=16_000))
    tail = b"".join(p for _, p in rest)
    for first in (other, faster):
        with pytest.raises(ogg.DamagedStream, match="headers differ"):
            ogg.read(first + two + tail)
    (_, a), (_, b), *_ = pages(ogg.write(bytes(24_001)))
    with pytest.raises(ogg.DamagedStream, match="24000 of 24001 samples"):
        ogg.read(a + b + tail)
    with pytest.raises(ogg.DamagedStream, match="no header"):
        ogg.read(ogg.page(1, 0, ogg.FIRST | ogg.LAST, 0, ogg.lace(4), b"junk"))
    assert ogg.payload_of(ogg.read(one + two + tail)) == bytes(24_000)


def test_timestamps_go_by_the_headers_rate():
    streams = ogg.read(ogg.write(bytes(24_000), rate=16_000))
    assert sum(s.packets[-1][1] for s in streams.values()) == 24_000 / 16_000 and {s.rate for s in streams.values()} == {16_000}


def test_null_and_empty_media_are_damage(spark):
    stored = spark.createDataFrame([(1, 0, None), (2, 0, bytearray())], "doc_id long, n_bytes long, media binary")
    assert [(r.payload, r.feature, r.damage) for r in ogg.load(stored).collect()] == [(None, None, "no stream")] * 2
