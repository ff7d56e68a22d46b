"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can't be joined by any merge, so it marks a certain cut.  A
pre-token is cut at all such pairs, its fragments are encoded independently (and remembered), and their ids concatenated: the
result is that of encoding the pre-token whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LATIN_LETTERS, LATIN_WORD, byte_letters, digest, per_worker, slices, splits_at_space, text_bytes, vocabulary_json

#: Entries that a worker keeps of words and of fragments each; it starts afresh beyond.
CACHE_ENTRIES = 400_000
#: Documents that are encoded together.
GROUP = 64


class ForcedBoundaryBPE:
    """Encoder and decoder for a vocabulary file of kind BPE with a word-end suffix or without one.

    The normaliser, the pre-tokenizer and the byte alphabet are the file's, as the tokenizers library applies them; added
    tokens are found in the raw text first.  The merges are done here.
    """

    def __init__(self, vocabulary: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model, base = json.loads(vocabulary), Tokenizer.from_str(vocabulary)
        self.normalizer, self.pre_tokenizer = base.normalizer, base.pre_tokenizer
        kind = model["model"]
        if kind.get("type", "BPE") != "BPE" or kind.get("dropout") or kind.get("byte_fallback") or kind.get("ignore_merges") or kind.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE vocabularies are known")
        if model.get("decoder"):
            raise ValueError("a vocabulary with a decoder isn't known")
        if not splits_at_space(base):
            raise ValueError("pre-tokens cross white space")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in model["added_tokens"]):
            raise ValueError("added tokens must stand for themselves in the raw text")
        self.vocab, self.end = kind["vocab"], kind.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in kind["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.find_added = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.decimal = {i: str(i) for i in self.tokens}
        self.inside = self.pairs_inside()
        self.cache_entries, self.words, self.older, self.fragments = cache_entries, {}, {}, {}
        self.latin = self.latin_words_are_plain()

    def pairs_inside(self) -> set[str]:
        """All pairs of adjacent byte characters inside vocabulary tokens, the suffix left out."""
        cut = len(self.end)
        bare = (t[:-cut] if cut and t.endswith(self.end) and len(t) > cut else t for t in self.vocab)
        return {t[i : i + 2] for t in bare for i in range(len(t) - 1)}

    def latin_words_are_plain(self) -> bool:
        """Whether normaliser and pre-tokenizer make of a word of Latin letters with a stop behind its lower-case bytes and the stop."""
        letters = [w for x in LATIN_LETTERS for w in (x, f"t{x}e.", f"{x}{x},")]
        for word in ("the", "Straße", "ÉTÉ.", "señorîta,", "ÿþ", *letters):
            m = LATIN_WORD.fullmatch(word)
            text = self.normalizer.normalize_str(word) if self.normalizer is not None else word
            if [t for t, _ in self.pre_tokenizer.pre_tokenize_str(text)] != [byte_letters(m[1].lower()), *m[2]]:
                return False
        return True

    def split(self, word: str) -> list[str]:
        """The word cut at every forced boundary."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def merged(self, symbols: list[str]) -> list[str]:
        """Applies the merges in order of rank, the leftmost first among equals."""
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def fragment(self, part: str, last: bool) -> bytes:
        """ids of a fragment, which bears the word's end if it is the last."""
        key = part + "\0" if last else part
        ids = self.fragments.get(key)
        if ids is None:
            symbols = list(part)
            if last:
                symbols[-1] += self.end
            if len(self.fragments) >= self.cache_entries:
                self.fragments.clear()
            ids = self.fragments[key] = np.array([self.vocab[s] for s in self.merged(symbols)], "<u4").tobytes()
        return ids

    def pre_token(self, word: str) -> bytes:
        parts = self.split(word)
        if len(parts) == 1:
            return self.fragment(word, True)
        return b"".join([*(self.fragment(p, False) for p in parts[:-1]), self.fragment(parts[-1], True)])

    def plain(self, text: str) -> bytes:
        """ids of a text without added tokens."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return b"".join([self.pre_token(word) for word, _ in self.pre_tokenizer.pre_tokenize_str(text)]) if text else b""

    def encode_word(self, text: str) -> bytes:
        if self.latin and (m := LATIN_WORD.fullmatch(text)):
            ids = self.pre_token(byte_letters(m[1].lower()))
            return ids + self.pre_token(m[2]) if m[2] else ids
        if self.find_added is None or not self.find_added.search(text):
            return self.plain(text)
        ids, at = [], 0
        for m in self.find_added.finditer(text):
            ids += [self.plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*ids, self.plain(text[at:])])

    def encode(self, text: bytes) -> list[int]:
        """ids of a whole text: of its runs between ASCII white space, each done once, as no pre-token crosses white space."""
        if len(self.words) > self.cache_entries // 2:
            self.older, self.words = self.words, {}
        words, known, older = text.split(), self.words, self.older
        for w in set(words).difference(known):
            ids = older.get(w)
            known[w] = self.encode_word(w.decode()) if ids is None else ids
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by spaces, which is what a vocabulary file without a decoder stands for."""
        return " ".join(map(self.tokens.__getitem__, ids))


def worker_bpe(vocabulary: str) -> ForcedBoundaryBPE:
    """The encoder of this Python worker, with what it has remembered."""
    return per_worker(("bpe", digest(vocabulary)), lambda: ForcedBoundaryBPE(vocabulary))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs, repeats too: the id column and ids array<int>.  Nothing is shuffled, other columns are not read.

    Null and empty texts have no ids; an empty table gives an empty result.  The id column may not be named ids (ValueError).
    """
    if id_col.lower() == "ids":
        raise ValueError("the id column and the ids would have one name")
    vocabulary = vocabulary or vocabulary_json()

    def work(batches):
        import pyarrow as pa

        bpe = worker_bpe(vocabulary)
        for b in slices(batches, GROUP):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t) for t in text_bytes(b.column(1))], pa.list_(pa.int32()))], names=[id_col, "ids"])

    d = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(work, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The id column and text: what the tokens of each row's ids say.  Null ids count as none."""
    vocabulary = vocabulary or vocabulary_json()

    def work(batches):
        import pyarrow as pa

        bpe = worker_bpe(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    d = ids.select(id_col, ids_col)
    return d.mapInArrow(work, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded text), of every whole text.

    Encodes and decodes in one pass, so ids don't leave the worker.  A null text counts as empty; null and repeated ids give a row
    for each row; an empty table gives an empty result; other columns are not read.
    """
    vocabulary = vocabulary or vocabulary_json()

    def work(batches):
        import pyarrow as pa

        bpe = worker_bpe(vocabulary)
        decimal = bpe.decimal
        for b in slices(batches, 1000):
            n, a, d = [], [], []
            for t in text_bytes(b.column(1)):
                ids = bpe.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
