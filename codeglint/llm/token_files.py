"""Token ids in flat binary files with 64-bit document offsets, read by memory map.

A set of shards holds documents in ascending id order.  For shard k there are
  k.tokens   ids one after another, little-endian unsigned, 16 bits wide if the vocabulary allows, else 32
  k.offsets  little-endian unsigned 64-bit: the global start of each document and the end of the last
  k.ids      little-endian signed 64-bit document ids
Global starts are a shard's base, the sum of the shards before it, plus the start within the shard.  Files are written under
a temporary name and renamed, with the same bytes at every attempt, so a task may be run again.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LATIN_LETTERS, LATIN_WORD, byte_letters, digest, per_worker, shared_path, sized_slices, splits_at_space, vocabulary_json

#: The id that ends a document.
END_ID = 1
#: Distinct words that a worker keeps with their ids; it starts afresh beyond.
CACHE_WORDS = 1_000_000
#: Documents, and bytes of text, that are encoded together: each of their distinct words is looked up once.
GROUP, GROUP_BYTES = 1000, 4 << 20
#: Spark gives a table whose size it doesn't know a size beyond this; its shards are as many as shuffle partitions.
UNKNOWN_SIZE = 1 << 60
#: Documents that are read back together.
READ = 1000
#: Bytes of the input's files that a shard is made of.
SHARD_BYTES = 64 << 20
#: Stands for a null document id, which comes first.
NULL_ID = -(2**63)


assert sys.byteorder == "little"


class WordEncoder:
    """ids of whole texts by the tokenizers library, which sees each distinct word once.

    No pre-token of the vocabulary crosses ASCII white space, which its pre-tokenizer drops, so the ids of a text are those of its
    words in order; ``check`` refuses other vocabularies.
    """

    def __init__(self, vocabulary: str, dtype: str | None = None, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(dtype or width(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.cache_words, self.known, self.cores, self.code = cache_words, {}, {}, {2: "H", 4: "I"}[self.dtype.itemsize]
        self.check()

    def check(self) -> None:
        probe = "Ab, c12 'll\n\td's  é ́x"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        parts = [i for w in probe.encode().split() for i in self.tokenizer.encode(w.decode(), add_special_tokens=False).ids]
        if whole != parts or not splits_at_space(self.tokenizer):
            raise ValueError("this vocabulary's tokens depend on white space: words can't be encoded alone")
        self.stops = {x: array(self.code, self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in ("", ",", ".")}
        plain = True  # until a probe tells
        letters = [w for x in LATIN_LETTERS for w in (x, f"t{x}e.", f"{x}{x},")]
        for word in ("the", "Straße", "ÉTÉ.", "señorîta,", "internationalisation", "ÿþ", *letters):
            ids = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            plain = plain and self.letters(LATIN_WORD.fullmatch(word)) == ids
        self.plain = plain

    def letters(self, m: re.Match) -> bytes:
        """ids of a word of Latin letters with a comma or stop behind, which is one pre-token and one more."""
        core = m[1].lower()
        return (self.cores.get(core) or self.core(core)) + self.stops[m[2]]

    def core(self, word: str) -> bytes:
        """ids of a lower-case word of Latin letters: by the library's model alone, without normaliser and pre-tokenizer."""
        if len(self.cores) >= self.cache_words // 2:
            self.cores.clear()
        ids = self.cores[word] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(byte_letters(word))]).tobytes()
        return ids

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words as bytes of self.dtype."""
        known, cores, stops, rest = self.known, self.cores, self.stops, []
        if len(known) > self.cache_words:
            known.clear()
        matched = LATIN_WORD.fullmatch if self.plain else lambda text: None
        out = list(map(known.get, words))
        for i, w in enumerate(words):
            if out[i] is not None:
                continue
            text = w.decode()
            m = matched(text)
            if m is None:
                rest.append((i, w, text))
                continue
            word, stop = m.groups()
            word = word.lower()
            ids = cores.get(word) or self.core(word)
            out[i] = known[w] = ids + stops[stop] if stop else ids
        for e, (i, w, _) in zip(self.tokenizer.encode_batch_fast([t for _, _, t in rest], add_special_tokens=False), rest, strict=True):
            out[i] = known[w] = array(self.code, e.ids).tobytes()
        return out

    def encode_column(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of an Arrow string column: the ids of all texts one after another, end_id behind each.

        Words are split and numbered by Arrow; their ids are gathered by position, so Python meets distinct words only.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = lists.flatten().dictionary_encode()
        names = numbered.dictionary
        words = names.cast(pa.large_binary() if pa.types.is_large_string(names.type) else pa.binary()).to_pylist()
        ids = [*self.ids_of(words), np.array([end_id], self.dtype).tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        at = np.insert(numbered.indices.to_numpy().astype(np.int64), offsets[1:], len(words))
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        place = np.repeat(begins[at] - (ends - lengths), lengths)
        place += np.arange(len(place))
        last = ends[offsets[1:] + np.arange(len(texts))]
        return np.frombuffer(b"".join(ids), self.dtype)[place], np.diff(last, prepend=0)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of self.dtype, without an end."""
        import pyarrow as pa

        flat, lengths = self.encode_column(pa.array([t.decode() for t in texts], pa.string()), 0)
        stops = np.cumsum(lengths)
        return [flat[e - n : e - 1].tobytes() for e, n in zip(stops.tolist(), lengths.tolist())]


def width(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def opened(uri: str):
    """File system and path of a URI; local folders, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def put(uri: str, parts: Iterator[bytes] | list[bytes]) -> None:
    """Writes parts to a file that appears whole or not at all."""
    store, path = opened(uri)
    context = TaskContext.get()
    temporary = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    with store.open_output_stream(temporary) as f:
        for p in parts:
            f.write(p)
    store.move(temporary, path)


class Ranges:
    """A remote file's numbers, of which only the ranges that are asked for are read."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)
        self.n = file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: slice) -> np.ndarray:
        a, b, _ = at.indices(self.n)
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * size, a * size), self.dtype) if b > a else np.empty(0, self.dtype)


def mapped(uri: str, dtype: str) -> np.ndarray | Ranges:
    """A file's numbers, to be sliced: by memory map from a local folder, else by reads of ranges."""
    store, path = opened(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    return Ranges(store.open_input_file(path), dtype)


class TokenFiles:
    """A written set of shards."""

    def __init__(self, spark: SparkSession, uri: str, dtype: str, shards: list[tuple[int, int, int, int]]):
        #: shards: (shard, documents, tokens, base)
        self.spark, self.uri, self.dtype, self.shards = spark, uri, dtype, shards

    def rows(self, per_shard, schema: str) -> DataFrame:
        """per_shard(uri, dtype, shard, documents, tokens, base) gives Arrow batches; one task a shard."""
        uri, dtype, shards = self.uri, self.dtype, self.shards

        def read(batches):
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield from per_shard(uri, dtype, *shards[k])

        return self.spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian) from the files."""
        return self.rows(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def documents(self) -> DataFrame:
        """doc_id, start and the ids."""
        return self.rows(_documents, "doc_id long, start long, ids array<int>")


def _shard(uri: str, dtype: str, shard: int):
    base = f"{uri}/{shard:08d}"
    return mapped(f"{base}.tokens", dtype), mapped(f"{base}.offsets", "<u8"), mapped(f"{base}.ids", "<i8")


def _id_list(ids: np.ndarray) -> list:
    return [None if i == NULL_ID else i for i in ids.tolist()]


def _digests(uri, dtype, shard, documents, tokens, base):
    import pyarrow as pa

    flat, offsets, ids = _shard(uri, dtype, shard)
    for a in range(0, documents, READ):
        b = min(documents, a + READ)
        starts = offsets[a : b + 1].astype(np.int64) - base
        part, at = flat[int(starts[0]) : int(starts[-1])], starts - starts[0]
        crc = [zlib.crc32(part[x:y].astype("<u4").tobytes()) for x, y in zip(at.tolist(), at[1:].tolist())]
        columns = [_id_list(ids[a:b]), starts[:-1] + base, np.diff(starts), crc]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _documents(uri, dtype, shard, documents, tokens, base):
    import pyarrow as pa

    flat, offsets, ids = _shard(uri, dtype, shard)
    for a in range(0, documents, READ):
        b = min(documents, a + READ)
        starts = offsets[a : b + 1].astype(np.int64) - base
        values = pa.array(flat[int(starts[0]) : int(starts[-1])].astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([pa.array(_id_list(ids[a:b]), pa.int64()), pa.array(starts[:-1] + base), lists], names=["doc_id", "start", "ids"])


def write_token_files(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, uri: str | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> TokenFiles:
    """Encodes every whole text, appends end_id, and writes the shards under uri (default: in the shared folder).

    Documents are dealt by ranges of id and a hash of the text, one shard for about shard_bytes of input and four for each core
    at least, so a document is in one shard, shards ascend, and rows of one id or of none may fill many.  Equal ids go by the
    hash.  Null texts count as empty (only end_id), null ids come first.  An empty table gives no shards.  Other columns of
    docs are not read.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_json()
    uri = uri or shared_path(spark, "tokens")
    dtype = WordEncoder(vocabulary).dtype.str

    def write(batches):
        import pyarrow as pa

        encoder = per_worker(("encoder", digest(vocabulary)), lambda: WordEncoder(vocabulary, dtype))
        shard = TaskContext.get().partitionId()
        lengths, ids = [], []

        def encoded():
            for b in sized_slices(batches, 1, GROUP, GROUP_BYTES):
                ids.append(np.array([NULL_ID if i is None else i for i in b.column(0).to_pylist()], "<i8"))
                flat, n = encoder.encode_column(b.column(1), end_id)
                lengths.append(n)
                yield flat.tobytes()

        parts = encoded()
        first = next(parts, None)
        if first is None:
            return
        put(f"{uri}/{shard:08d}.tokens", (x for some in ([first], parts) for x in some))
        put(f"{uri}/{shard:08d}.ids", [x.tobytes() for x in ids])
        put(f"{uri}/{shard:08d}.lengths", [x.astype("<u8").tobytes() for x in lengths])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "documents": pa.array([sum(map(len, ids))], pa.int64()), "tokens": pa.array([int(sum(n.sum() for n in lengths))], pa.int64())})

    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards_for = -(-size // shard_bytes) if size < UNKNOWN_SIZE else int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(4 * spark.sparkContext.defaultParallelism, shards_for)
    order = [F.col("id"), F.xxhash64("text")]
    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(write, "shard long, documents long, tokens long").collect()  # one small row a shard
    shards, base = [], 0
    for r in sorted(made):
        shards.append((r.shard, r.documents, r.tokens, base))
        base += r.tokens
    files = TokenFiles(spark, uri, dtype, shards)
    if shards:
        files.rows(_offsets, "shard long").collect()
    return files


def _offsets(uri, dtype, shard, documents, tokens, base):
    """Adds a shard's base to its own starts."""
    import pyarrow as pa

    lengths = mapped(f"{uri}/{shard:08d}.lengths", "<u8")[:]
    put(f"{uri}/{shard:08d}.offsets", [(np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64) + np.uint64(base)).astype("<u8").tobytes()])
    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())})
