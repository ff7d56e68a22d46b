"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every text becomes its set of hashed word shingles, a MinHash signature and band keys.  Texts of equal sets are one class,
   and one of each class goes on.
2. Classes that share a band key are candidates.  In buckets up to SMALL members all pairs are; a larger bucket gives the pairs
   of its members with one central member, so the number of pairs grows with the members, not with their square.
3. Signatures of a pair are compared batch by batch; a pair is pruned once the posterior probability that its similarity
   reaches the threshold falls below the chosen miss probability.  Survivors are verified on their full sets.
4. Links are contracted to components.  A large bucket whose members then lie in several components is searched once more:
   blocks of the members outside its main component meet blocks of all its members inside a task, pruned and verified in
   the same way, and only links leave it.  No pair of texts that share a band goes unexamined unless both already are in one
   component.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, files_for, lowered, new_name, per_worker, slices, stored, text_bytes

#: A bucket of up to so many members gives all its pairs.
SMALL = 8
#: Members from which a large bucket's central member is chosen.
CENTRAL_SAMPLE = 64
#: Members of a block in the search of large buckets: outside the main component, and all; and about how many bytes of sets.
MINOR_BLOCK, PROBE_BLOCK, BLOCK_BYTES = 256, 2048, 16 << 20
#: Up to so many ids (8 bytes each) are broadcast to fetch their texts or components; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: An id is a hub from HUB links on, or from one link in HUBS of all ids on if that is more: so there are at most HUBS times the
#: mean number of links of an id.
HUB, HUBS = 100_000, 100_000
#: A key is hot from HOT rows on, or from one row in HUBS of all on if that is more: so there are at most HUBS hot keys.
HOT = 1000
#: Distinct words that a worker keeps with their hashes.
CACHE_WORDS = 300_000
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """words of a shingle; similarity = of / 100 at least; rows of a band; miss: bound on losing a pair at the threshold."""

    words: int = 5
    of: int = 80
    rows: int = 5
    miss: float = 1e-6
    batch: int = 25
    seed: int = 1

    @property
    def bands(self) -> int:
        """Bands that lose a pair at the threshold with probability `miss` at most."""
        return math.ceil(math.log(self.miss) / math.log(1 - (self.of / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """(n, least m) at each batch: with fewer of n hashes equal, P(similarity >= of / 100 | data) < miss.

        Uniform prior: the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
        """
        t, out = self.of / 100, []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out

    def similar(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.of * (a + b - common)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to sets of shingle hashes and signatures."""

    def __init__(self, s: Settings):
        import xxhash

        self.s, self.digest = s, xxhash.xxh3_64_intdigest
        r = np.random.default_rng(s.seed)
        self.a = r.integers(0, 1 << 63, s.hashes, dtype=np.uint64) * np.uint64(2) + _ONE
        self.b = r.integers(0, 1 << 63, s.hashes, dtype=np.uint64) * np.uint64(2)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes; without words none."""
        words = lowered(text).split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > CACHE_WORDS:
            known.clear()
        k = min(self.s.words, len(h))
        n = len(h) - k + 1
        x = mixed(h[:n] + np.uint64(k))
        for i in range(1, k):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(x)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.s.hashes, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), 2048):
            part = shingles[None, at : at + 2048]
            np.minimum(out, ((self.a[:, None] * part + self.b[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=out)
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.s.bands, self.s.rows).astype(np.uint64)
        x = mixed(np.arange(1, self.s.bands + 1, dtype=np.uint64))
        for i in range(self.s.rows):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return x.view(np.int64)


def prepared(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest of the set, signature, bands; the last three null for empty sets."""

    def work(batches):
        import pyarrow as pa

        sh = per_worker(("shingler", s), lambda: Shingler(s))
        for b in slices(batches, 1000):
            out = []
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                x = sh.shingles(t)
                if not len(x):
                    out.append((i, 0, None, None, None))
                    continue
                sig = sh.signature(x)
                out.append((i, len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), sig.tobytes(), sh.band_keys(sig)))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.list_(pa.int64()))], names=["id", "n_shingles", "digest", "sig", "bands"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.mapInArrow(work, "id long, n_shingles long, digest binary, sig binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id and shingles (binary of sorted 64-bit hashes) of the rows whose id is in ids."""

    def work(batches):
        import pyarrow as pa

        sh = per_worker(("shingler", s), lambda: Shingler(s))
        for b in slices(batches, 200):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sh.shingles(t).tobytes() for t in text_bytes(b.column(1))], pa.binary())], names=["id", "shingles"])

    few = ids.count() <= BROADCAST_IDS
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return d.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(work, "id long, shingles binary")


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def survivors(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Of pairs of signatures (rows of a and b), the places of those that no batch prunes."""
    left, at, equal = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in s.least_matches():
        equal = equal + (a[left, at:n] == b[left, at:n]).sum(axis=1)
        kept = equal >= least
        left, equal, at = left[kept], equal[kept], n
        if not len(left):
            break
    return left


def unpruned(pairs: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of pairs with their signatures (sig_a, sig_b) that sequential verification doesn't prune."""
    k = s.hashes

    def work(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, k) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).take(pa.array(survivors(x, y, s)))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of pairs with their sets (set_a, set_b) that are similar enough."""

    def work(batches):
        import pyarrow as pa

        for b in batches:
            kept = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if s.similar(common_count(x, y), len(x), len(y)):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def with_both(pairs: DataFrame, side: DataFrame, value: str, name: str) -> DataFrame:
    """pairs with the value of side (id, value) for a and for b."""
    for x in "ab":
        pairs = pairs.join(side.select(F.col("id").alias(x), F.col(value).alias(f"{name}_{x}")), x)
    return pairs


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, n: int) -> DataFrame:
    """rows with `value`: what table (id, p, degree) of n rows says of `key`; every key is there.

    A small table is broadcast.  Of a larger one the rows of many neighbours are, whose number is bounded as their neighbours
    are rows of their own: a hub's rows stay where they are, and the others are joined by a shuffle without hot keys.
    """
    side = table.select(F.col("id").alias(key), F.col("p").alias(value))
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(side), key)
    hubs = table.filter(F.col("degree") >= max(HUB, n // HUBS)).select(F.col("id").alias(key), F.col("p").alias(value))
    found = rows.join(F.broadcast(hubs), key, "left")
    return found.filter(F.col(value).isNotNull()).unionByName(found.filter(F.col(value).isNull()).drop(value).join(side, key))


def met(rows: DataFrame, key: str, table: DataFrame, n: str, total: int) -> DataFrame:
    """rows with the columns of table (key, ...), which has a row a key at most; rows of other keys go.

    n: the table's column of how many of the `total` rows, about, have the key.  Hot keys are broadcast, and their rows stay where
    they are; the others meet by a shuffle that has no hot key.
    """
    many = F.col(n) >= max(HOT, total // HUBS)
    hot = table.filter(many)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(~many), key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Each round sends every id to its smallest neighbour, twice, and contracts the links; the number of rounds is logarithmic in
    the size of a component, and nothing but counts reaches the driver.  Rounds write as many files as their rows need.
    """
    spark = links.sparkSession
    edges = stored(links.select("a", "b").filter("a != b").distinct(), f"{name}-links")
    steps, done = [], []
    while n := edges.count():
        files = files_for(spark, n)
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("p"), F.count(F.lit(1)).alias("degree"))
        nearest = stored(nearest, f"{name}-nearest", files)
        ids = nearest.count()
        step = nearest.select("id", "degree", "p")
        parent = looked_up(step.withColumnRenamed("p", "x"), "x", nearest, "p", ids).select("id", "p", "degree")
        parent = stored(parent, f"{name}-parents", files)
        lifted = looked_up(looked_up(edges, "a", parent, "x", ids), "b", parent, "y", ids)
        lifted = lifted.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        done += [edges, nearest]
        edges = stored(lifted.distinct(), f"{name}-links", files)
        steps.append((parent, ids))
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # every id of a later round is the component of some id of the one before
    assigned = steps[0][0].select("id", F.col("p").alias("component"))
    for parent, ids in steps[1:]:
        later = parent.select(F.col("id").alias("component"), "p")
        assigned = assigned.join(F.broadcast(later) if ids <= BROADCAST_IDS else later, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    assigned = stored(assigned, f"{name}-assigned", files_for(spark, steps[0][1]))
    dropped(edges, *done, *(p for p, _ in steps))
    return assigned


def small_pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, within buckets of up to SMALL members (key, n, id)."""
    m = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return m.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def central_pairs(large: DataFrame, total: int, sigs: DataFrame, s: Settings) -> DataFrame:
    """Pairs of each large bucket's members with its central one: of a bounded sample, that nearest to the sample's most
    frequent hashes.  Which it is changes the work that is left, not the result."""
    k = s.hashes
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id", "key"), "id"))
    sample = large.select("key", "n", "id").distinct().withColumn("rank", rank).filter(F.col("rank") <= CENTRAL_SAMPLE).join(sigs, "id").select("key", "n", "id", "sig")

    def central(key, table):
        import pyarrow as pa

        order = np.argsort(table.column("id").to_numpy())
        ids, x = table.column("id").to_numpy()[order], np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, k)[order]
        score = (x[:, None, :] == x[None, :, :]).sum(axis=(1, 2))
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "n": table.column("n")[:1].combine_chunks(), "hub": pa.array([int(ids[score.argmax()])], pa.int64())})

    hubs = stored(sample.groupBy("key").applyInArrow(central, "key long, n long, hub long"), "dup-central")
    pairs = met(large.select("key", "id"), "key", hubs, "n", total).filter("id != hub")
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def searched(mixed_members: DataFrame, s: Settings) -> DataFrame:
    """Links between members of different components in large buckets.

    mixed_members: key, id, component, minor (outside the bucket's main component), sig, shingles.  A pair is examined in the
    first of the bands that its signatures share.
    """
    k, rows = s.hashes, s.rows
    n_minors = F.greatest(F.ceil(F.col("n_minor") / MINOR_BLOCK), F.ceil(F.col("minor_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    n_probes = F.greatest(F.ceil(F.col("n_all") / PROBE_BLOCK), F.ceil(F.col("all_bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    side = mixed_members.withColumn("minor_block", F.pmod(F.xxhash64("id"), n_minors)).withColumn("probe_block", F.pmod(F.xxhash64("id", F.lit(1)), n_probes))
    columns = ["key", "mb", "pb", "is_minor", "id", "component", "sig", "shingles"]
    minors = side.filter("minor").withColumn("pb", F.explode(F.sequence(F.lit(0), n_probes - 1))).withColumn("mb", F.col("minor_block").cast("int")).withColumn("is_minor", F.lit(True))
    probes = side.withColumn("mb", F.explode(F.sequence(F.lit(0), n_minors - 1))).withColumn("pb", F.col("probe_block").cast("int")).withColumn("is_minor", F.lit(False))

    def search(key, table):
        import pyarrow as pa

        ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, k)
        sets, minor = table.column("shingles"), table.column("is_minor").to_numpy(zero_copy_only=False)
        sh, out = Shingler(s), []
        bucket, probe_at = key[0].as_py(), np.flatnonzero(~minor)
        band = next(i for i, x in enumerate(sh.band_keys(sigs[0])) if x == bucket)
        sizes: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sizes:
                sizes[i] = np.frombuffer(sets[i].as_buffer(), np.uint64)
            return sizes[i]

        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for i in np.flatnonzero(minor).tolist():
            there = probe_at[(comps[probe_at] != comps[i]) & (ids[probe_at] != ids[i])]
            left = there[survivors(np.broadcast_to(sigs[i], (len(there), k)), sigs[there], s)]
            if not len(left):
                continue
            equal = sigs[left] == sigs[i]
            first = equal.reshape(len(left), -1, rows).all(axis=2).argmax(axis=1) == band
            left, near = left[first], equal.sum(axis=1)[first]
            for j in left[np.argsort(-near, kind="stable")].tolist():
                a, b = root(int(comps[i])), root(int(comps[j]))
                if a != b and s.similar(common_count(of(i), of(j)), len(of(i)), len(of(j))):
                    joined[max(a, b)] = min(a, b)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return minors.select(*columns).unionByName(probes.select(*columns)).groupBy("key", "mb", "pb").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id: the smallest doc_id reachable over links, the row's own included; kept: it is the row's own id.  Null and
    empty texts and texts without words have no shingle and no link.  Rows of one doc_id count as one document; a row of null
    id follows the component of its set, and is never kept.  An empty table gives an empty result.
    """
    p = stored(prepared(docs, s, id_col, text_col), "dup-prepared")
    files = files_for(docs.sparkSession, p.count())
    classes = p.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes, "dup-classes", files)
    # one of each class goes on, met by its id and set together: neither the copies of a text nor the rows of an id are one key
    one = classes.filter("rep is not null").select(F.col("rep").alias("id"), "digest")
    reps = p.select("id", "digest", "sig", "bands").join(one, ["id", "digest"]).dropDuplicates(["id", "digest"])
    reps = stored(reps.select("id", "sig", "bands"), "dup-representatives", files)
    sigs, total = reps.select("id", "sig"), reps.count() * s.bands
    banded = reps.select("id", F.explode("bands").alias("key"))
    shared = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dup-shared", files)
    members = stored(met(banded, "key", shared, "n", total), "dup-members", files)
    large = members.filter(F.col("n") > SMALL)
    sizes = p.filter("digest is not null").groupBy("id").agg(F.max("n_shingles").alias("size"))
    pairs = small_pairs(members).union(central_pairs(large, total, sigs, s)).distinct()
    pairs = stored(unpruned(with_both(pairs, sigs, "sig", "sig"), s), "dup-pairs", files)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = stored(ids.union(large.select("id")).distinct(), "dup-ids", files)
    sets = stored(shingle_sets(docs, ids, s, id_col, text_col), "dup-sets")
    links = stored(verified(with_both(pairs, sets, "shingles", "set"), s), "dup-links", files)
    found = components(links, "dup-first")
    placed = large.join(found, "id", "left").join(sizes, "id").select("key", "id", F.coalesce("component", "id").alias("component"), "size")
    placed = stored(placed, "dup-placed", files)
    by = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("sizes"))
    main = F.max_by(F.struct("component", "count", "sizes"), F.struct("count", "component"))
    by = by.groupBy("key").agg(F.count(F.lit(1)).alias("n_comps"), main.alias("m"), F.sum("count").alias("n_all"), (8 * F.sum("sizes")).alias("all_bytes")).filter("n_comps > 1")
    by = by.select(
        "key", F.col("m.component").alias("main"), "n_all", "all_bytes",
        (F.col("n_all") - F.col("m.count")).alias("n_minor"), (F.col("all_bytes") - 8 * F.col("m.sizes")).alias("minor_bytes"),
    )
    open_members = met(placed, "key", stored(by, "dup-open", files), "n_all", total).withColumn("minor", F.col("component") != F.col("main"))
    open_members = open_members.join(sigs, "id").join(sets, "id")
    more = stored(searched(open_members, s), "dup-more-links")
    if not more.isEmpty():
        found = components(links.union(more), "dup-second")
    dropped(reps, shared, members, placed, pairs, ids, sets, links, more)
    nothing = F.lit(None).cast("long").alias("_component")
    whole = classes.filter("rep is not null").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("_component"))
    whole = stored(whole.unionByName(classes.filter("rep is null").select("digest", "n", nothing)), "dup-whole", files)
    rows = p.select("id", "n_shingles", "digest")
    out = met(rows.filter("digest is not null"), "digest", whole, "n", rows.count()).drop("n").unionByName(rows.filter("digest is null").withColumn("_component", nothing))
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of docs; all rows without words stay.

    Where every id is there once, that is the row of the smallest id.  Where ids are null or repeated, rows are documents of
    their own: they are numbered in a written copy, and the first row of a component stays, one with an id before one without.
    So of exact repeats one row stays, whatever their ids.
    """
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    alone = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty()
    row, columns = id_col, docs.columns
    if not alone:
        row = new_name(docs, "row")
        late = F.when(F.col(f"`{id_col}`").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id() + late), "dup-numbered")
    gone = stored(near_duplicates(docs, s, row, text_col).filter("not kept").select(F.col("doc_id").alias(row)), "dup-gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in columns])
