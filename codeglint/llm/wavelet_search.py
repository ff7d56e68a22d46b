"""Ranked lexical search over shards of dual-sorted wavelet trees.

A shard holds some documents, numbered by ascending id.  Its postings are one sequence of document numbers: term by term, and
within a term by falling impact.  A wavelet tree over that sequence, its levels laid out one after the other as in a wavelet
matrix, halves the range of document numbers at each level and keeps the order within a node.  So the sequence is sorted twice:
a term's interval in a node lists the node's documents by impact, its first element bounds the term's impact below the node, and
the leaves come in the order of ids.

A search starts with the intervals of a query's terms in the root and opens the nodes of largest bound first, some at a time, each
into two children whose intervals follow by rank.  At a leaf the bound is the document's score.  It ends when no open node can
hold a better document than the k-th found, at equal scores one of smaller id, so the result is exact.

An index is one table, a row a shard; every document and every term is in it.  Only the counts of documents and terms go through
the driver, and the queries, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, sized_slices, text_bytes

#: A term is a maximal run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A shard is closed when its texts have so many bytes, or at so many documents; what a worker holds of it grows with that.
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 16
#: Texts are split into terms in pieces of so many bytes, cut between terms.
PIECE = 1 << 20
#: Queries go to the executors in blocks of at most so many items, and so many bytes beyond the first.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20
#: Postings of the part of a shard's tree that is unpacked at a time, for as many queries as have no more (one at least).
VIEW_POSTINGS = 1_000_000
#: Nodes that are opened at a time.
BATCH = 48

#: A posting is packed into 64 bits: 27 of its term's number, 20 of its impact, 17 of its document's number.
_IMPACT_BITS, _DOC_BITS = 20, 17
_SCHEMA = "n_docs int, levels int, ids binary, no_id binary, terms binary, starts binary, impacts binary, bits binary, documents long, length long"

_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, A-Z lower-cased, in order, some at a time."""
    spaced, at = text.translate(_SPACED), 0
    while at < len(spaced):
        stop = spaced.find(b" ", at + PIECE)
        stop = len(spaced) if stop < 0 else stop
        yield spaced[at:stop].split()
        at = stop


def term_counts(text: bytes) -> Counter:
    counts: Counter = Counter()
    for terms in term_lists(text):
        counts.update(terms)
    return counts


def n_terms(text: Column) -> Column:
    """Number of terms; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).cast("long")


# a shard


class Shard:
    """Postings under construction."""

    def __init__(self) -> None:
        import array

        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths, self.distinct = array.array("q"), array.array("q")
        self.terms, self.tf = array.array("i"), array.array("q")
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts, number = term_counts(text), self.numbers.setdefault
        self.terms.extend([number(t, len(self.numbers)) for t in counts])
        self.tf.extend(counts.values())
        self.ids.append(doc_id)
        self.lengths.append(sum(counts.values()))
        self.distinct.append(len(counts))
        self.size += len(text)

    @property
    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def row(self, documents: int, length: int) -> dict:
        """The shard as a row of an index over so many documents with terms, and so many terms."""
        import numpy as np

        none = np.array([i is None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        by_id = np.lexsort((ids, none))  # null after all others
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        n = np.frombuffer(self.lengths, np.int64) if self.lengths else np.zeros(0, np.int64)
        m = _norms(n, documents, length)
        repeats = np.frombuffer(self.distinct, np.int64) if self.distinct else np.zeros(0, np.int64)
        tf = np.frombuffer(self.tf, np.int64) if self.tf else np.zeros(0, np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, repeats))
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        terms = rank[np.frombuffer(self.terms, np.int32)] if self.terms else np.zeros(0, np.int64)
        top = (1 << _IMPACT_BITS) - 1
        packed = terms << (_IMPACT_BITS + _DOC_BITS) | (top - impacts) << _DOC_BITS | np.repeat(place, repeats)
        packed.sort()
        sequence = (packed & ((1 << _DOC_BITS) - 1)).astype(np.int32)
        impacts = (top - (packed >> _DOC_BITS & top)).astype(np.int32)
        starts = np.searchsorted(packed >> (_IMPACT_BITS + _DOC_BITS), np.arange(len(names) + 1)).astype(np.int64)
        levels, bits = max(1, (len(ids) - 1).bit_length()), []
        for shift in range(levels - 1, -1, -1):
            one = (sequence >> shift & 1).astype(bool)
            bits.append(np.packbits(one).tobytes())
            sequence = np.concatenate([sequence[~one], sequence[one]])
        return {
            "n_docs": len(ids), "levels": levels, "ids": ids[by_id].tobytes(), "no_id": none[by_id].tobytes(), "terms": b" ".join(names), "starts": starts.tobytes(),
            "impacts": impacts.tobytes(), "bits": b"".join(bits), "documents": documents, "length": length,
        }


def _norms(n, documents: int, length: int):
    """m of documents of n terms; in Python's integers where 64 bits might not do."""
    import numpy as np

    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // length for x in n], np.int64)
    return 25 + 75 * n * documents // max(1, length)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs, a table of one row a shard, written to the shared folder.

    A null text has no terms; a null id sorts after all others; rows of one id are documents of their own.  Other columns are
    left aside.  An empty table gives an index without shards, which finds nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    count = n_terms(F.col("text"))
    stats = texts.select(count.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(stats[0]), int(stats[1])

    def shards(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in _SCHEMA.split(", "))])
        shard = Shard()
        for b in sized_slices(batches, 1, 500, 1 << 20):
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                shard.add(i, t)
                if shard.full:
                    yield pa.RecordBatch.from_pylist([shard.row(documents, length)], schema)
                    shard = Shard()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row(documents, length)], schema)

    path = shared_path(spark, "wavelet-index")
    with small_batches(spark):
        texts.mapInArrow(shards, _SCHEMA).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path)


# search in a shard


class Tree:
    """A shard's row, opened: rank over the bits of each level, and the intervals of terms in the root."""

    def __init__(self, row: dict) -> None:
        import numpy as np

        self.levels = row["levels"]
        self.ids, self.no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool)
        self.starts, self.impacts = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["impacts"], np.int32)
        self.bits = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        self.n = len(self.impacts)

    def view(self, terms) -> View:
        """The tree of the postings of some terms alone (ascending numbers), found by rank in the levels of the whole tree."""
        import numpy as np

        lengths = self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[terms] - (ends - lengths), lengths) + np.arange(n)
        zeros, impacts = np.zeros((self.levels, n + 1), np.int32), np.zeros((self.levels + 1, n + 1), np.int32)
        impacts[0, :n] = self.impacts[at]
        for level, bits in enumerate(self.bits):
            ones_before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            byte, place = bits[at >> 3].astype(np.uint16), (at & 7).astype(np.uint16)
            one = (byte >> (7 - place) & 1).astype(bool)
            rank = ones_before[at >> 3] + np.bitwise_count(byte >> (8 - place))
            np.cumsum(~one, out=zeros[level, 1:])
            at = np.concatenate([(at - rank)[~one], (self.n - ones_before[-1] + rank)[one]])
            impacts[level + 1, :n] = np.concatenate([impacts[level, :n][~one], impacts[level, :n][one]])
        return View(self.levels, n, ends - lengths, ends, zeros.ravel(), impacts.ravel(), zeros[:, n].astype(np.int64))


@dataclass
class View:
    """zeros: elements of bit 0 before each place, by level; impacts: in each level's order, one level more; split: zeros of a level."""

    levels: int
    n: int
    starts: object
    ends: object
    zeros: object
    impacts: object
    split: object

    def best(self, terms, weights, k: int, least: int = 0):
        """(scores, document numbers) of the k best documents above 0 by (score falling, number), of those that score least or more.

        terms: places in the view; weights: of 64-bit integers.
        """
        import numpy as np

        width = self.n + 1
        start, end = self.starts[terms][None, :], self.ends[terms][None, :]
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.where(start < end, self.impacts[start], 0).astype(np.int64) @ weights
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = max(1, least)
        while len(bound):
            if len(scores) == k:
                open_ = (bound > scores[-1]) | ((bound == scores[-1]) & (first < found[-1]))
                open_ &= bound >= floor
            else:
                open_ = bound >= floor
            if not open_.all():
                start, end, level, first, bound = start[open_], end[open_], level[open_], first[open_], bound[open_]
                if not len(bound):
                    break
            rest = None
            if len(bound) > BATCH:
                order = np.lexsort((first, -bound))
                rest, order = order[BATCH:], order[:BATCH]
                later = start[rest], end[rest], level[rest], first[rest], bound[rest]
                start, end, level, first = start[order], end[order], level[order], first[order]
            base, split = (level * width)[:, None], self.split[level][:, None]
            s0, e0 = self.zeros[base + start].astype(np.int64), self.zeros[base + end].astype(np.int64)
            start, end = np.concatenate([s0, split + start - s0]), np.concatenate([e0, split + end - e0])
            half = 1 << (self.levels - 1 - level)
            first, level = np.concatenate([first, first + half]), np.concatenate([level, level]) + 1
            bound = np.where(start < end, self.impacts[(level * width)[:, None] + start], 0).astype(np.int64) @ weights
            leaf = (level == self.levels) & (bound >= floor)
            if leaf.any():
                scores, found = np.concatenate([scores, bound[leaf]]), np.concatenate([found, first[leaf]])
                order = np.lexsort((found, -scores))[:k]
                scores, found = scores[order], found[order]
            inner = (level < self.levels) & (bound >= floor)
            start, end, level, first, bound = start[inner], end[inner], level[inner], first[inner], bound[inner]
            if rest is not None:
                start, end, level, first, bound = (np.concatenate([a, b]) for a, b in zip((start, end, level, first, bound), later, strict=True))
        return scores, found


# search in an index


@dataclass
class Block:
    """Queries: the terms of all, and for each the places of its terms with their repeats; weights come with the index."""

    terms: list[bytes] = field(default_factory=list)
    items: list[list[tuple[int, int]]] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)


def _block(texts: list[str | None]) -> Block:
    block, place = Block(), {}
    for text in texts:
        counts = term_counts((text or "").encode())
        block.items.append([(place.setdefault(t, len(place)), c) for t, c in counts.items()])
    block.terms = list(place)
    return block


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _present(row: dict, wanted: dict[bytes, int]) -> dict[int, int]:
    """Which of the wanted terms the shard has: their place in the block, and their number in the shard."""
    return {wanted[t]: i for i, t in enumerate(row["terms"].split(b" ")) if t in wanted} if row["terms"] else {}


def _weights(index: DataFrame, terms: list[bytes], documents: int) -> list[int]:
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def frequencies(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(len(sent.value), np.int64)
        for row in _rows(batches):
            starts = np.frombuffer(row["starts"], np.int64)
            for place, i in _present(row, sent.value).items():
                total[place] += starts[i + 1] - starts[i]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], names=["term", "df"])

    df = dict(index.select("terms", "starts").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    return [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]


def _searched(index: DataFrame, block: Block, k: int) -> DataFrame:
    """(item int, doc_id long, score long): each task's k best for each query of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        q = sent.value
        wanted = {t: i for i, t in enumerate(q.terms)}
        best: list[list] = [[] for _ in q.items]  # (-score, no id, id), ascending
        for row in _rows(batches):
            tree, present = Tree(row), _present(row, wanted)
            own = [[(present[p], q.weights[p] * c) for p, c in item if p in present and q.weights[p] > 0] for item in q.items]
            for items in _together(own, tree.starts):
                terms = np.unique(np.array([t for i in items for t, _ in own[i]], np.int64))
                view = tree.view(terms)
                for i in items:
                    places = np.searchsorted(terms, np.array([t for t, _ in own[i]], np.int64))
                    weights = np.array([w for _, w in own[i]], np.int64)
                    least = -best[i][-1][0] if len(best[i]) == k else 0
                    scores, docs = view.best(places, weights, k, least)
                    found = [(-s, bool(tree.no_id[d]), int(tree.ids[d])) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)]
                    best[i] = heapq.nsmallest(k, best[i] + found)
        rows = [(i, None if none else d, -s) for i, found in enumerate(best) for s, none, d in found]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = pa.int32(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["item", "doc_id", "score"])

    return index.drop("documents", "length").mapInArrow(search, "item int, doc_id long, score long")


def _together(own: list[list[tuple[int, int]]], starts) -> Iterator[list[int]]:
    """Queries with a term in the shard, in groups whose terms have VIEW_POSTINGS postings at most, or of one query."""
    group: list[int] = []
    terms: set[int] = set()
    total = 0
    for i, item in enumerate(own):
        new = {t for t, _ in item} - terms
        more = sum(int(starts[t + 1] - starts[t]) for t in new)
        if group and total + more > VIEW_POSTINGS:
            yield group
            group, terms, total = [], set(), 0
            new = {t for t, _ in item}
            more = sum(int(starts[t + 1] - starts[t]) for t in new)
        if item:
            group.append(i)
            terms |= new
            total += more
    if group:
        yield group


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of an index for each row of queries, those that score above 0.

    Equal scores rank by ascending doc_id, null last.  A query without terms, or whose terms no document has, gets no row; rows
    of one item are queries of their own.  The terms' weights follow from the index.
    """
    spark = index.sparkSession
    kind = queries.schema[id_col].dataType
    about = index.select("documents", "length").first()
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    if about is None:
        return empty
    out = None
    for ids, texts in _query_blocks(queries.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))):
        block = _block(texts)
        block.weights = _weights(index, block.terms, about["documents"])
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = _searched(index, block, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind.simpleString()}")
        part = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return empty if out is None else out


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, list[str | None]]]:
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for i, text in queries.toLocalIterator():
        ids.append(i)
        texts.append(text)
        size += len(text or "")
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
