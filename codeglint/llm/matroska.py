"""Media columns in Matroska: a writer of 8-bit PCM tracks and a parser of EBML into packet tables.

The parser reads variable-length element ids and sizes (unknown sizes too), clusters, simple blocks and block groups, all
four kinds of lacing, and cues.  A packet is a frame of a block, with track, timestamp, key flag and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

#: Bytes of a packet: 24 ms of 8-bit mono at 8 kHz.
PACKET = 192
RATE = 8000
#: Packets laced into a block, blocks in a cluster, and ticks (nanoseconds) of a timestamp.
LACED, BLOCKS, TICK = 8, 64, 1_000_000

# Element ids of the Matroska specification (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements at the segment's own level: any of them ends a cluster of unknown size.
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class MediaError(ValueError):
    """The bytes aren't a Matroska file that this parser can read."""


def vint(n: int, length: int = 0) -> bytes:
    """A size as a variable-length integer, of the least length or of a given one."""
    k = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return ((1 << 7 * k) | n).to_bytes(k, "big")


def element(kind: int, body: bytes, length: int = 0) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body), length) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def signed_vint(n: int) -> bytes:
    """A difference of sizes in EBML lacing."""
    k = next(k for k in range(1, 9) if abs(n) < 1 << (7 * k - 1))
    return vint(n + (1 << (7 * k - 1)) - 1, k)


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block behind its flags."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1]))
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def write_media(payload: bytes, packet: int = PACKET, lacing: int = FIXED, laced: int = LACED, blocks: int = BLOCKS, rate: int = RATE) -> bytes:
    """A Matroska file with the payload as the 8-bit samples of one audio track."""
    header = element(EBML, b"".join((number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(EBML_MAX_ID, 4), number(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), number(DOC_TYPE_VERSION, 4), number(DOC_TYPE_READ_VERSION, 2))))
    ms = 1e9 / TICK / rate
    info = element(INFO, number(TIMESTAMP_SCALE, TICK) + element(DURATION, struct.pack(">d", len(payload) * ms)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, packet * 10**9 // rate) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body, at, cues = [info, element(TRACKS, element(TRACK_ENTRY, entry))], 0, []
    at = sum(map(len, body))
    per_block, per_cluster = packet * laced, packet * laced * blocks
    for start in range(0, len(payload), per_cluster):
        began = int(start * ms)
        parts = [number(TIMESTAMP, began)]
        for o in range(start, min(start + per_cluster, len(payload)), per_block):
            frames = [payload[i : i + packet] for i in range(o, min(o + per_block, len(payload)), packet)]
            kind = lacing if len(frames) > 1 else NO_LACING
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", int(o * ms) - began, 0x80 | kind << 1) + lace(frames, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, began) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body), 8)


@dataclass
class Media:
    """What a file holds; packets: (track, timestamp in ticks, key, offset, size)."""

    scale: int = TICK
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: int = 0
    #: (time, track, cluster position in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    #: Where the clusters' elements begin, as cues name them.
    cluster_starts: list[int] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position); the value is None if all its bits are set: an unknown size."""
    if at >= len(data):
        raise MediaError(f"the data end at {at}")
    first = data[at]
    if not first:
        raise MediaError(f"no variable-length integer at {at}")
    k = 9 - first.bit_length()
    if at + k > len(data):
        raise MediaError(f"the data end within the integer at {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if keep_marker:
        return n, at + k
    n &= (1 << 7 * k) - 1
    return (None if n == (1 << 7 * k) - 1 else n), at + k


def elements(data: bytes, at: int, end: int, until: set[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; until: ids that end a parent of unknown size."""
    while at < end:
        begin = at
        kind, at = read_vint(data, at, True)
        if until and kind in until:
            return
        n, at = read_vint(data, at)
        stop = end if n is None else at + n
        if stop > end:
            raise MediaError(f"the element at {begin} is longer than its parent")
        if n is None:
            stop = unknown_end(data, kind, at, end)
        yield kind, at, stop
        at = stop


def unknown_end(data: bytes, kind: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: a segment with its parent, a cluster before the next top-level element."""
    if kind == SEGMENT:
        return end
    for _, _, stop in elements(data, at, end, TOP_LEVEL):
        at = stop
    return at


def whole(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where they begin."""
    if kind == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MediaError(f"no lacing head at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise MediaError(f"{end - at} bytes aren't {n} equal frames")
        return [(end - at) // n] * n, at
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise MediaError("lacing sizes run over the block")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            begin = at
            value, at = read_vint(data, at)
            if value is None:
                raise MediaError("a lacing size is unknown")
            size = value if i == 0 else sizes[-1] + value - ((1 << (7 * (at - begin) - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("frames are longer than their block")
    return sizes, at


def read_media(data: bytes) -> Media:
    """Parses a whole file."""
    m, seen, base = Media(), False, 0
    for kind, a, b in elements(data, 0, len(data)):
        if kind == EBML:
            seen = True
            types = [data[x:y] for k, x, y in elements(data, a, b) if k == DOC_TYPE]
            if types and types[0].rstrip(b"\0") not in (b"matroska", b"webm"):
                raise MediaError(f"a file of type {types[0]!r}")
        elif kind == SEGMENT:
            base = begin = a
            for k, x, y in elements(data, a, b):
                begin, element_at = y, begin
                if k == INFO:
                    m.scale = next((whole(data, p, q) for i, p, q in elements(data, x, y) if i == TIMESTAMP_SCALE), TICK)
                elif k == TRACKS:
                    read_tracks(data, x, y, m)
                elif k == CLUSTER:
                    m.clusters += 1
                    m.cluster_starts.append(element_at)
                    read_cluster(data, x, y, m)
                elif k == CUES:
                    read_cues(data, x, y, base, m)
    if not seen:
        raise MediaError("no EBML head")
    return m


def read_tracks(data: bytes, a: int, b: int, m: Media) -> None:
    for kind, x, y in elements(data, a, b):
        if kind == TRACK_ENTRY:
            t: dict = {"type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "duration": 0}
            for k, p, q in elements(data, x, y):
                if k in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                    t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration"}[k]] = whole(data, p, q)
                elif k == CODEC_ID:
                    t["codec"] = data[p:q].decode("ascii", "replace")
                elif k == AUDIO:
                    for i, u, v in elements(data, p, q):
                        if i == SAMPLING_FREQUENCY:
                            t["rate"] = real(data, u, v)
                        elif i in (CHANNELS, BIT_DEPTH):
                            t["channels" if i == CHANNELS else "bits"] = whole(data, u, v)
            m.tracks[t.get("number", 0)] = t


def read_cluster(data: bytes, a: int, b: int, m: Media) -> None:
    began = 0
    for kind, x, y in elements(data, a, b):
        if kind == TIMESTAMP:
            began = whole(data, x, y)
        elif kind == SIMPLE_BLOCK:
            read_block(data, x, y, began, None, m)
        elif kind == BLOCK_GROUP:
            inner = list(elements(data, x, y))
            key = not any(k == REFERENCE_BLOCK for k, _, _ in inner)
            for k, p, q in inner:
                if k == BLOCK:
                    read_block(data, p, q, began, key, m)


def read_block(data: bytes, a: int, b: int, began: int, key: bool | None, m: Media) -> None:
    track, at = read_vint(data, a)
    if at + 3 > b:
        raise MediaError(f"the block at {a} has no head")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    key = bool(flags & 0x80) if key is None else key
    sizes, at = frame_sizes(data, at + 3, b, flags >> 1 & 3)
    step = m.tracks.get(track, {}).get("duration", 0) / m.scale
    for i, n in enumerate(sizes):
        m.packets.append((track, int(began + relative + i * step), key, at, n))
        at += n


def read_cues(data: bytes, a: int, b: int, base: int, m: Media) -> None:
    for kind, x, y in elements(data, a, b):
        if kind == CUE_POINT:
            inner = list(elements(data, x, y))
            time = next((whole(data, p, q) for k, p, q in inner if k == CUE_TIME), 0)
            for k, p, q in inner:
                if k == CUE_TRACK_POSITIONS:
                    of = {i: whole(data, u, v) for i, u, v in elements(data, p, q)}
                    m.cues.append((time, of.get(CUE_TRACK, 0), base + of.get(CUE_CLUSTER_POSITION, 0)))


def payload_of(data: bytes, m: Media, track: int = 1) -> bytes:
    return b"".join([data[o : o + n] for t, _, _, o, n in m.packets if t == track])


def padded(text: bytes, to: int = PACKET) -> bytes:
    """text with spaces behind up to a positive multiple of to."""
    return text.ljust(max(to, -(-len(text) // to) * to), b" ")


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lacing: int = FIXED) -> DataFrame:
    """doc_id, n_bytes and media: each whole text, padded, as a Matroska file.  A null text counts as empty: one packet."""

    def work(batches):
        import pyarrow as pa

        for b in slices(batches, 256):
            part = text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in part], pa.int64()), pa.array([write_media(padded(t), lacing=lacing) for t in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(work, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: doc_id, packet, track, timestamp_ns, key, byte_offset, byte_size; error on a row of its own where the bytes can't be parsed.

    Null media give no packets.
    """
    schema = "doc_id long, packet long, track long, timestamp_ns long, key boolean, byte_offset long, byte_size long, error string"

    def work(batches):
        import pyarrow as pa

        def rows(b):
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    m = read_media(data)
                    yield [(i, k, t, ts * m.scale, key, o, n, None) for k, (t, ts, key, o, n) in enumerate(m.packets)]
                except MediaError as e:
                    yield [(i, None, None, None, None, None, None, str(e))]

        names = ["doc_id", "packet", "track", "timestamp_ns", "key", "byte_offset", "byte_size", "error"]
        kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.string()]
        for b in batches:
            for part in rows(b):
                for a in range(0, len(part), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part[a : a + 10_000]), kinds)], names=names)

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col)).mapInArrow(work, schema)


def feature(payload: bytes, m: Media) -> str:
    """Packets, clusters, cues, last timestamp (ms), mean level, loudest packet's mean, from what was read back."""
    levels = np.frombuffer(payload, np.uint8).reshape(-1, PACKET).sum(axis=1, dtype=np.int64)
    return f"{len(m.packets)}:{m.clusters}:{len(m.cues)}:{m.packets[-1][1] * m.scale // 1_000_000}:{levels.sum() / len(payload):.6f}:{levels.max() / PACKET:.6f}"


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored media.

    One row per row, null and repeated ids too; other columns are not read, and an empty table gives an empty result.  Every
    cue must name the start of a cluster, and every cluster have a cue (MediaError).
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def work(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for b in slices(batches, 256):
            out = []
            for i, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = read_media(data)
                if {at for _, _, at in m.cues} != set(m.cluster_starts):
                    raise MediaError("a cue points to no cluster, or a cluster has none")
                p = payload_of(data, m)
                out.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(p, m)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, schema)


def stored_media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's media in a table of the shared folder, reads it back and gives its digests."""
    return media_digests(stored(with_media(docs, id_col, text_col), "media"))
