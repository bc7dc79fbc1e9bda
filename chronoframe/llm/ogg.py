"""Ogg media columns: writing and reading physical streams with several logical ones.

The container is the public one of RFC 3533: pages with a capture pattern, lacing values, granule
position and checksum; packets of at most any length laced over pages; logical streams told
apart by serial number. The payload is 8-bit samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoframe.llm.common import slices

#: Samples are grouped in frames of this many bytes; payloads are padded with spaces to whole frames.
FRAME = 192
#: Bytes of a data packet (16 lacing values), logical streams that packets are dealt to in turn, samples a second,
#: lacing values of a page: packets go on from one page to the next.
PACKET, STREAMS, RATE, SEGMENTS = 20 * FRAME, 2, 8000, 40
HEADER = struct.Struct("<4sBBqIIIB")
#: The header packet of a logical stream: magic, logical streams, samples a second, samples of all streams.
TOLD = struct.Struct("<4sBIQ")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04c11db7, most significant bit first, zero at start and end.

    zlib has the same polynomial with the bits reversed, ones at start and inverted at the end; so the
    bytes are reversed for it and its result is turned round.
    """
    register = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))) + lacing
    struct.pack_into("<I", head, 22, checksum(bytes(head) + body))
    return bytes(head) + body


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write(payload: bytes, packet: int = PACKET, streams: int = STREAMS, rate: int = RATE) -> bytes:
    """A physical stream of ``payload``: its packets are dealt to the logical streams in turn.

    Each logical stream has a first page with a header packet (magic, streams, rate, samples in
    all) and then pages of up to SEGMENTS lacing values; a packet that overflows its page
    goes on in the next. The pages of the streams alternate.
    """
    dealt = [[payload[at : at + packet] for at in range(s * packet, len(payload), streams * packet)] for s in range(streams)]
    queues: list[list[bytes]] = []
    firsts: list[bytes] = []
    for s, packets in enumerate(dealt):
        serial, number, granule, pages = s + 1, 0, 0, []
        head = TOLD.pack(b"PCM8", streams, rate, len(payload))
        firsts.append(page(serial, 0, FIRST | (0 if packets else LAST), 0, lace(len(head)), head))
        lacing, body, flags, done = b"", bytearray(), 0, -1
        for k, data in enumerate(packets):
            values, at = lace(len(data)), 0
            while values:
                room = SEGMENTS - len(lacing)
                put, values = values[:room], values[room:]
                size = sum(put)
                lacing, body, at = lacing + put, body + data[at : at + size], at + size
                if not values:
                    granule = granule + len(data)
                    done = granule
                last = not values and k == len(packets) - 1
                if len(lacing) == SEGMENTS or last:
                    number += 1
                    pages.append(page(serial, number, flags | (LAST if last else 0), done, lacing, bytes(body)))
                    lacing, body, flags, done = b"", bytearray(), CONTINUED if values else 0, -1
        queues.append(pages)
    turns = max(map(len, queues), default=0)
    return b"".join(firsts) + b"".join(q[i] for i in range(turns) for q in queues if i < len(q))


@dataclass
class LogicalStream:
    """packets: (bytes, seconds at its end or None if its page does not say) after the header packet, which tells streams, rate and samples."""

    streams: int = 0
    rate: int = 0
    samples: int = 0
    packets: list[tuple[bytes, float | None]] = field(default_factory=list)
    granule: int = 0
    pages: int = 0
    ended: bool = False


class DamagedStream(ValueError):
    pass


def _told(header: bytes, serial: int) -> tuple[int, int, int]:
    """Streams, rate and samples that a header packet tells."""
    if len(header) != TOLD.size or header[:4] != b"PCM8":
        raise DamagedStream(f"stream {serial} has no header of 8-bit samples")
    _, streams, rate, samples = TOLD.unpack(header)
    if not streams or not rate:
        raise DamagedStream(f"the header of stream {serial} tells no streams or no rate")
    return streams, rate, samples


def read(media: bytes | None) -> dict[int, LogicalStream]:
    """Logical streams by serial number; timestamps go by the rate of their header.

    DamagedStream if there is nothing to read, a page is cut off, out of order or fails its checksum, headers differ, or the streams
    or samples are not as many as they tell.
    """
    streams: dict[int, LogicalStream] = {}
    open_packets: dict[int, bytearray] = {}
    at = 0
    if not media:
        raise DamagedStream("no stream")
    while at < len(media):
        if len(media) < at + HEADER.size:
            raise DamagedStream(f"page cut off at byte {at}")
        magic, version, flags, granule, serial, number, told, count = HEADER.unpack_from(media, at)
        start = at + HEADER.size + count
        lacing = media[at + HEADER.size : start]
        end = start + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < count or end > len(media):
            raise DamagedStream(f"no whole page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != told:
            raise DamagedStream(f"checksum of the page at byte {at}")
        if (serial not in streams) != bool(flags & FIRST):
            raise DamagedStream(f"stream {serial} starts wrongly")
        stream = streams.setdefault(serial, LogicalStream())
        if number != stream.pages or bool(flags & CONTINUED) != (serial in open_packets):
            raise DamagedStream(f"page {number} of stream {serial} is out of order")
        held, place, complete = open_packets.pop(serial, bytearray()), start, []
        for k, value in enumerate(lacing):
            held += media[place : place + value]
            place += value
            if value < 255:
                complete.append(bytes(held))
                held = bytearray()
            elif k == count - 1:
                open_packets[serial] = held
        if not stream.pages:
            if len(complete) != 1:
                raise DamagedStream(f"stream {serial} has no header packet")
            stream.streams, stream.rate, stream.samples = _told(complete[0], serial)
            complete = complete[1:]
        # The granule position is that of the page's last complete packet: count back from it.
        stamp = granule
        stamped: list[tuple[bytes, float | None]] = []
        for data in reversed(complete):
            stamped.append((data, stamp / stream.rate if granule >= 0 else None))
            stamp -= len(data)
        stream.packets += reversed(stamped)
        stream.granule = max(stream.granule, granule)
        stream.pages, stream.ended = stream.pages + 1, bool(flags & LAST)
        at = end
    if open_packets or not all(s.ended for s in streams.values()):
        raise DamagedStream("a stream has no end")
    headers = {(s.streams, s.rate, s.samples) for s in streams.values()}
    if len(headers) > 1:
        raise DamagedStream("headers differ")
    [(number, _, samples)] = headers
    if len(streams) != number:
        raise DamagedStream(f"{len(streams)} of {number} streams")
    held = sum(len(data) for s in streams.values() for data, _ in s.packets)
    if held != samples:
        raise DamagedStream(f"{held} of {samples} samples")
    return streams


def payload_of(streams: dict[int, LogicalStream]) -> bytes:
    """The samples of all streams, with the packets put back in turn."""
    order = [streams[s].packets for s in sorted(streams)]
    return b"".join(q[i][0] for i in range(max(map(len, order), default=0)) for q in order if i < len(q))


def described(streams: dict[int, LogicalStream], payload: bytes) -> str:
    """Features as text: seconds, pages and packets by stream, mean, RMS and zero crossings of the samples about 128."""
    parts = [f"s{n}:pages={s.pages},packets={len(s.packets)},seconds={(s.packets[-1][1] if s.packets else 0.0):.6f}" for n, s in sorted(streams.items())]
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    n = max(1, len(samples))
    crossings = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
    total, square = int(samples.sum()), int((samples * samples).sum(dtype=np.int64))
    return ";".join([*parts, f"mean={total / n:.6f}", f"rms={(square / n) ** 0.5:.6f}", f"crossings={crossings}"])


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % FRAME or (0 if text else FRAME))


def store(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media): each whole text as an Ogg stream of 8-bit samples.

    The payload is the UTF-8 text with spaces up to a positive multiple of FRAME; a null text counts as
    empty. Equal texts give equal streams. Rows are kept as they are; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            for at, to in slices(column):
                texts = [t or b"" for t in column.slice(at, to - at).to_pylist()]
                media = [write(padded(t)) for t in texts]
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def load(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media, payload, feature, damage) of every stored stream.

    A stream that can't be read, a null or empty one too, keeps its row: payload and feature are null and ``damage`` says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column("media")):
                part = batch.slice(at, to - at)
                payloads, features, damage = [], [], []
                for media in part.column("media").to_pylist():
                    try:
                        streams = read(media)
                        payload = payload_of(streams)
                        found = (payload, described(streams, payload), None)
                    except DamagedStream as why:
                        found = (None, None, str(why))
                    for column, value in zip((payloads, features, damage), found, strict=True):
                        column.append(value)
                yield pa.record_batch(
                    [*(part.column(k) for k in range(3)), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(damage, pa.string())],
                    names=[key, "n_bytes", "media", "payload", "feature", "damage"],
                )

    kind = stored.schema[key].dataType.simpleString()
    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary, payload binary, feature string, damage string")
