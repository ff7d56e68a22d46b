"""Matroska: exact round trips, all lacings, foreign layouts, damage."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeglint.llm import matroska as M
from codeglint.llm import registry as queries


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=5000), st.sampled_from([M.NO_LACING, M.XIPH, M.FIXED, M.EBML_LACING]), st.integers(1, 9), st.integers(1, 5))
def test_round_trip(data, lacing, laced, blocks):
    payload = M.padded(data)
    media = M.write_media(payload, lacing=lacing, laced=1 if lacing == M.NO_LACING else laced, blocks=blocks)
    m = M.read_media(media)
    assert M.payload_of(media, m) == payload
    assert [p[1] for p in m.packets] == [24 * i for i in range(len(payload) // 192)]
    assert len(m.cues) == m.clusters and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert all(media[o : o + n] == payload[192 * i : 192 * i + 192] for i, (_, _, _, o, n) in enumerate(m.packets))


def test_uneven_frames_and_groups():
    frames = [b"a" * 300, b"", b"c" * 70_000, b"d" * 5]
    for kind in (M.XIPH, M.EBML_LACING):
        body = b"\x82" + b"\x00\x05" + bytes([kind << 1]) + M.lace(frames, kind)
        cluster = M.element(M.CLUSTER, M.number(M.TIMESTAMP, 100) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, body) + M.number(M.REFERENCE_BLOCK, 1)))
        media = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + M.element(M.SEGMENT, M.element(M.INFO, b"") + cluster)
        m = M.read_media(media)
        assert [media[o : o + n] for _, _, _, o, n in m.packets] == frames
        assert {p[:3] for p in m.packets} == {(2, 105, False)}


def test_unknown_sizes():
    media = M.write_media(bytes(range(256)) * 60)
    m = M.read_media(media)
    start = media.index(M.CLUSTER.to_bytes(4, "big"))
    _, body = M.read_vint(media, start + 4)
    live = media[:start] + M.CLUSTER.to_bytes(4, "big") + b"\xff" + media[body:]
    at = live.index(M.SEGMENT.to_bytes(4, "big")) + 4
    live = live[:at] + b"\x01" + b"\xff" * 7 + live[at + 8 :]
    assert M.payload_of(live, M.read_media(live)) == M.payload_of(media, m)


@pytest.mark.parametrize("data", [b"", b"\x00", b"not media at all", M.write_media(b"x" * 192)[:-3], M.write_media(b"x" * 192)[4:]])
def test_damage_is_told(data):
    with pytest.raises(M.MediaError):
        M.read_media(data)


def expected(i, text):
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    return i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def test_op2(spark, sf, docs):
    got = queries.op2_matroska(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected(r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(odd, none):
    got = M.stored_media_digests(odd).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((expected(r.doc_id, r.text) for r in odd.collect()), key=str)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert M.stored_media_digests(none).collect() == []


def test_packet_table(spark):
    rows = [(1, M.write_media(b"y" * 960)), (2, b"junk"), (3, None)]
    got = M.packets(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert [(r.packet, r.timestamp_ns, r.byte_size) for r in got if r.doc_id == 1] == [(i, 24_000_000 * i, 192) for i in range(5)]
    assert [r.error is not None for r in got if r.doc_id != 1] == [True]
