"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import threading
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the control characters 9 to 13, in Java's and RE2's syntax.
SPACES = r"[ \x09-\x0D]+"
WORD = r"[^ \x09-\x0D]+"
#: The vocabulary that encoders take unless told otherwise.
VOCABULARY = "word_bpe_49k.json"

#: A word of Latin letters with a comma or stop behind, and the byte alphabet of byte-level vocabularies for its bytes.
LATIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: The letters of LATIN_WORD, and ASCII white space.
LATIN_LETTERS = [chr(c) for c in range(256) if LATIN_WORD.fullmatch(chr(c))]
ASCII_SPACE = " \t\n\x0b\x0c\r"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Rows of an Arrow batch in what stored() runs: rows may be long texts or pairs of shingle sets.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500

#: Short rows that one file of a stored table holds.
FILE_ROWS = 20_000

_lock = threading.Lock()
_inside: dict[str, int] = {}
_before: dict[str, str] = {}
_own_dirs: dict[str, str] = {}
_kept: dict[object, object] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if its files give fewer tasks than there are cores: a file of one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def vocabulary_json(path: str | None = None) -> str:
    """Text of a vocabulary file, read on the driver; executors get the text, so they need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="codeglint-"))
    return f"{root.rstrip('/')}/codeglint-{app}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Bounds the rows of an Arrow batch while jobs run; the last of several at once puts the setting back."""
    app = spark.sparkContext.applicationId
    with _lock:
        if not _inside.get(app):
            _before[app] = spark.conf.get(ARROW_ROWS)
            rows = int(_before[app])
            spark.conf.set(ARROW_ROWS, str(min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS))
        _inside[app] = _inside.get(app, 0) + 1
    try:
        yield
    finally:
        with _lock:
            _inside[app] -= 1
            if not _inside[app]:
                spark.conf.set(ARROW_ROWS, _before.pop(app))


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, and a lost executor loses nothing.

    files: into how many files at most; see files_for().
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with small_batches(spark):
        (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for a table of about so many short rows: as many as the rows need, and two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave and that no later result reads."""
    for t in tables:
        p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def new_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(key: Column | str, modulus: int) -> Column:
    """crc32 of the key as decimal text, modulo modulus; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(key: object, modulus: int) -> int:
    """What fold() gives, in Python."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % modulus


def byte_letters(text: str) -> str:
    """text's UTF-8 in the byte alphabet."""
    return text.encode().decode("latin-1").translate(_BYTE_LETTERS)


def splits_at_space(tokenizer) -> bool:
    """Whether a vocabulary's normaliser and pre-tokenizer drop ASCII white space and join nothing across it, by probes of each space
    between letters, digits, marks, accents and quotes."""

    def parts(text: str) -> list[str]:
        text = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer is not None else text
        return [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if text else []

    if tokenizer.pre_tokenizer is None:
        return False
    ends = ("a", "Z", "7", "'", "'s", "!", "\u0301", "é", "ß", "\u4e00", "\U0001f600", "\u200d", "\x1c", "-", "<|x|>")
    return all(parts(f"{x}{gap}{y}") == parts(x) + parts(y) for x in ends for y in ends for gap in (*ASCII_SPACE, " \n", "  "))


def per_worker(key: object, build):
    """build(), kept for the later tasks of this Python worker, which keeps only the last such thing."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def slices(batches, rows: int):
    """Arrow batches in parts of so many rows: what Python holds of a batch at once stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def sized_slices(batches, column: int, rows: int, size: int):
    """Arrow batches in parts of at most so many rows, and so many bytes of a text column beyond the first row."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(total, done + size, "right"))))
            yield b.slice(at, stop - at)
            at = stop


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def lowered(text: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return text.lower()
