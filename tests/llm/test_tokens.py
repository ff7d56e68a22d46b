"""Token files and BPE against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codeglint.llm import bpe, token_files
from codeglint.llm import registry as queries
from codeglint.llm.common import vocabulary_json

VOCABULARY = vocabulary_json()
LIBRARY, OWN = Tokenizer.from_str(VOCABULARY), bpe.ForcedBoundaryBPE(VOCABULARY)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def expected_files(rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library_ids(t), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_what_the_library_says(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, queries.op1_token_files(spark, sf).collect())) == sorted(expected_files(rows))


def test_token_files_of_odd_rows(odd):
    got = token_files.write_token_files(odd).digests().collect()
    want = expected_files([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_read_back_ids(odd):
    files = token_files.write_token_files(odd)
    assert {(r.doc_id, tuple(r.ids)) for r in files.documents().collect()} == {(r.doc_id, (*library_ids(r.text), 1)) for r in odd.collect()}
    bases = [s[3] for s in files.shards]
    assert bases == [sum(s[2] for s in files.shards[:i]) for i in range(len(bases))]


def test_no_documents_no_shards(none):
    files = token_files.write_token_files(none)
    assert files.shards == [] and files.digests().collect() == []


def test_32_bit_files(spark, odd):
    texts = [r.text.encode() for r in odd.collect() if r.text]
    encoder = token_files.WordEncoder(VOCABULARY, "<u4")
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library_ids(t.decode()) for t in texts]


def test_small_cache_gives_the_same(odd):
    texts = [r.text.encode() for r in odd.collect() if r.text]
    encoder, own = token_files.WordEncoder(VOCABULARY, cache_words=3), bpe.ForcedBoundaryBPE(VOCABULARY, cache_entries=3)
    for _ in range(2):
        assert [np.frombuffer(encoder.encode([t])[0], encoder.dtype).tolist() for t in texts] == [library_ids(t.decode()) for t in texts]
        assert [own.encode(t) for t in texts] == [library_ids(t.decode()) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    ids = OWN.encode(text.encode())
    assert ids == library_ids(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|endoftext", "it's I'LL", "½ ² ﬁ Å ǅ", "日本語 עברית 👩‍👩‍👧", "Σ ΑΣ ς", "a\x0bb\x0cc\x1cd\x85e f"])
def test_bpe_on_odd_texts(text):
    assert OWN.encode(text.encode()) == library_ids(text)
    assert OWN.decode(OWN.encode(text.encode())) == LIBRARY.decode(library_ids(text), skip_special_tokens=False)


def test_cuts_are_forced():
    """No token spans a cut, and cuts occur."""
    tokens = [t.removesuffix("</w>") for t in OWN.vocab]
    word = "xqzjñöß"
    bytes_of = OWN.pre_tokenizer.pre_tokenize_str(word)[0][0]
    parts = OWN.split(bytes_of)
    assert len(parts) > 1 and "".join(parts) == bytes_of
    at = 0
    for p in parts[:-1]:
        at += len(p)
        assert not any(bytes_of[at - 1 : at + 1] in t for t in tokens)


def digests(rows):
    out = []
    for i, t in rows:
        ids = library_ids(t)
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op3(spark, sf, docs):
    assert sorted(map(tuple, queries.op3_bpe(spark, sf).collect()), key=str) == digests((r.doc_id, r.text) for r in docs.collect())


def test_round_trip_of_odd_rows(odd, none):
    assert sorted(map(tuple, bpe.round_trip_digests(odd).collect()), key=str) == digests((r.doc_id, r.text) for r in odd.collect())
    assert bpe.round_trip_digests(none).collect() == []


def test_encoded_and_decoded_tables(odd):
    e = bpe.encoded(odd)
    assert {(r.doc_id, tuple(r.ids)) for r in e.collect()} == {(r.doc_id, tuple(library_ids(r.text))) for r in odd.collect()}
    assert {r.text for r in bpe.decoded(e).collect()} == {LIBRARY.decode(library_ids(r.text), skip_special_tokens=False) for r in odd.collect()}
