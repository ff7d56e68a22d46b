"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

The score of a word after two others is s = (c1 * r[w-1] + c2 * r[w-2]) . q[w] + b[w].  It splits into one table per context
position, and log Z depends on the two context words only: batched matrix products give both tables and log Z of all context
pairs once, so every token of the corpus gets its exactly normalised probability from look-ups.

The model knows the most frequent words; the others share a class, within which a word has its smoothed share of training
counts.  Counts and training cover the whole training part, every word of every document: each partition trains its own copy of
the parameters on an executor, and their mean starts the next round.  At every size training goes over the text once: each round
takes the documents of another share of ids, by hash.  The parameters depend on how the rows are dealt to partitions, so clusters
that deal them otherwise get other scores; base scores and counts don't depend on it.  The number of words that the model knows grows with the
square root of the training tokens, up to MOST_CLASSES.  The HEAD most frequent words, a bounded table, go to every worker; counts of
all other words are found by a join, whose keys can't be hot as the hot words are in the head.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, lowered, per_worker, slices, stored, text_bytes

#: Words that a worker counts before it passes them on.
FLUSH = 200_000
#: Words whose counts every worker holds; least classes of the model: the rest, the end, then the most frequent words.
HEAD, CLASSES = 131_072, 1024
REST, END = 0, 1
#: Bound of CLASSES: the tables of a worker are three squares of them (see the README for what more would take).
MOST_CLASSES = 2048
#: Noise words are drawn once a batch and shared by its targets.
DIM, NOISE = 24, 64
#: Rounds of training, each over another share of the documents.
ROUNDS = 4
BATCH, RATE = 2048, 0.1
#: States of parameters that a task averages, and that the driver does; a state has at most 0.8 MB.
MEANS, LAST_MEANS = 32, 8
#: Tokens that are shuffled together.
BUFFER = 131_072
#: The end's name among words; no word is empty.
END_WORD = b""


def word_counts(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> DataFrame:
    """word (binary) and c: how often the rows outside fold `held` have it; the end counts once a row."""

    def work(batches):
        import pyarrow as pa

        def flushed(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        count: Counter = Counter()
        for b in slices(batches, 256):
            for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                if fold_of(i, folds) != held:
                    count.update(lowered(t).split())
                    count[END_WORD] += 1
                    if len(count) > FLUSH:
                        yield flushed(count)
                        count = Counter()
        if count:
            yield flushed(count)

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    return d.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, head: int) -> list:
    """The `head` most frequent rows of (word, c), ties in byte order; the end is always among them (head: 1 at least).

    Bounds come from a histogram of counts in 64 steps an octave: the bins that fit whole, and of the next one its first rows
    in order.  No more than the table itself reaches the driver.
    """
    step = F.floor(F.log2("c") * 64)
    bins = sorted(counts.groupBy(step.alias("bin")).count().collect(), reverse=True)
    end = [r for r in counts.filter(F.col("word") == F.lit(END_WORD)).collect()]
    room, whole, part = head - len(end), [], None
    for r in bins:
        if r["count"] > room:
            part = r.bin
            break
        whole.append(r.bin)
        room -= r["count"]
    others = counts.filter(F.col("word") != F.lit(END_WORD))
    top = others.filter(step >= whole[-1]).collect() if whole else []
    if part is not None and room > 0:
        top += others.filter(step == part).orderBy(F.desc("c"), "word").limit(room).collect()
    return sorted(top + end, key=lambda r: (-r.c, bytes(r.word)))


def added_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """out[ids] += rows, with repeated ids."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out[ids[starts]] += np.add.reduceat(rows[order], starts, axis=0)


def contexts_of(seq: np.ndarray) -> np.ndarray:
    """(N, 2): the last word and the one before of each word of a whole text, whose start follows two ends."""
    padded = np.concatenate([np.array([END, END], seq.dtype), seq])
    return np.stack([padded[1:-1], padded[:-2]], axis=1)


class LogBilinear:
    """Parameters and their training."""

    NAMES = ("r", "q", "c", "b")

    def __init__(self, unigram: np.ndarray, dim: int = DIM, seed: int = 3):
        r = np.random.default_rng(seed)
        n = len(unigram)
        self.noise = unigram / unigram.sum()
        self.r, self.q = (r.normal(0, 0.1, (n, dim)).astype(np.float32) for _ in range(2))
        self.c = np.full((2, dim), 0.5, np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.steps = {name: np.full_like(getattr(self, name), 1e-8) for name in self.NAMES}

    def state(self) -> np.ndarray:
        """Parameters and AdaGrad's sums in one row."""
        return np.concatenate([x.ravel() for x in (*(getattr(self, name) for name in self.NAMES), *self.steps.values())])

    def load(self, state: np.ndarray) -> LogBilinear:
        at = 0
        for x in (*(getattr(self, name) for name in self.NAMES), *self.steps.values()):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def train(self, contexts: np.ndarray, targets: np.ndarray, epochs: int = 1, k: int = NOISE, rate: float = RATE, seed: int = 5) -> None:
        """contexts (N, 2): the last word and the one before.  AdaGrad on the noise-contrastive loss, k noise words a batch."""
        rng, n = np.random.default_rng(seed), len(self.b)
        log_noise, cdf = np.log(k * self.noise).astype(np.float32), np.cumsum(self.noise)
        for _ in range(epochs):
            order = rng.permutation(len(targets))
            for take in np.array_split(order, max(1, round(len(order) / BATCH))):
                ctx1, ctx2, words, m = contexts[take, 0], contexts[take, 1], targets[take], np.float32(len(take))
                drawn = np.minimum(np.searchsorted(cdf, rng.random(k), "right"), n - 1)
                r1, r2, qw, qn = self.r[ctx1], self.r[ctx2], self.q[words], self.q[drawn]
                hidden = self.c[0] * r1 + self.c[1] * r2
                # d loss / d score, of targets and of noise words
                p = (1 / (1 + np.exp(-(np.einsum("md,md->m", hidden, qw) + self.b[words] - log_noise[words]))) - 1) / m
                pn = 1 / (1 + np.exp(-(hidden @ qn.T + (self.b - log_noise)[drawn]))) / m
                dh = p[:, None] * qw + pn @ qn
                grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
                added_rows(grads["q"], words, p[:, None] * hidden)
                np.add.at(grads["q"], drawn, pn.T @ hidden)
                grads["b"] += np.bincount(words, p, n) + np.bincount(drawn, pn.sum(axis=0), n)
                added_rows(grads["r"], ctx1, dh * self.c[0])
                added_rows(grads["r"], ctx2, dh * self.c[1])
                grads["c"] += np.stack([np.einsum("md,md->d", dh, r1), np.einsum("md,md->d", dh, r2)])
                for name, g in grads.items():
                    self.steps[name] += g * g
                    getattr(self, name).__isub__(np.float32(rate) * g / np.sqrt(self.steps[name]))

    def train_texts(self, texts, seed: int) -> int:
        """Goes once over texts as arrays of classes, BUFFER tokens or one longer text at a time; their tokens."""
        total, held, size = 0, [], 0

        def flush():
            self.train(np.concatenate([contexts_of(x) for x in held]), np.concatenate(held), seed=seed + total)

        for seq in texts:
            held.append(seq)
            size += len(seq)
            if size >= BUFFER:
                flush()
                total, held, size = total + size, [], 0
        if size:
            flush()
        return total + size

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, log_z): natural-log scores by (last word, word), by (word before, word), and log Z by both.

        b is in the first.  A row of log_z needs one matrix product of all words before with all words.
        """
        first = ((self.r * self.c[0]) @ self.q.T + self.b).astype(np.float32)
        second = ((self.r * self.c[1]) @ self.q.T).astype(np.float32)
        # exp(first[i] + second[j]) summed over words is a product of two matrices, scaled to stay in range
        top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        z = np.exp((first - top1).astype(np.float64)) @ np.exp((second - top2).astype(np.float64)).T
        return first, second, (np.log(z) + top1 + top2.T).astype(np.float32)


class Scorer:
    """What workers need: words of the head with their counts, and the model's tables."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tables, classes: int):
        self.words, self.counts, self.tables = words, counts, tables
        self.known = min(classes - 2, sum(w != END_WORD for w in words))
        inside = int(counts[self.in_model()].sum())
        members = int(self.in_model().sum())
        #: log10 of the denominators of a word's share in all tokens and of its share in the class of the rest
        self.log_all, self.log_rest = np.log10(total + distinct + 1), np.log10(total - inside + distinct - members + 1)

    def __getstate__(self):
        return self.__dict__ | {"words": b"\n".join(self.words)}

    def __setstate__(self, state):
        self.__dict__ |= state | {"words": state["words"].split(b"\n") if len(state["counts"]) else []}

    def classes_of(self) -> np.ndarray:
        """The model's class of each word of the head."""
        out, n = np.zeros(len(self.words), np.intp), 2
        for i, w in enumerate(self.words):
            if w == END_WORD:
                out[i] = END
            elif n < self.known + 2:
                out[i], n = n, n + 1
        return out

    def in_model(self) -> np.ndarray:
        return self.classes_of() != REST

    def ready(self):
        """Builds the look-ups of a worker."""
        self.index = {w: i for i, w in enumerate(self.words)}
        self.classes = np.append(self.classes_of(), REST)
        seen = np.append(self.counts, 0)
        self.log_count, self.is_known = np.log10(seen + 1.0), seen > 0
        self.in_head = np.append(np.ones(len(self.words), bool), False)
        self.end = self.index.get(END_WORD, len(self.words))
        return self

    def group(self, texts: list[bytes]):
        """For texts: n_tokens, n_known, sum of log10(c + 1), model's log10 sum without the counts of the tail, n of the class
        rest, and each text's words outside the head."""
        words = [lowered(t).split() for t in texts]
        lengths = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, int(ends[-1])
        at, unknown = np.full(n, self.end, np.intp), len(self.words)
        for w, s in zip(words, starts):
            at[s : s + len(w)] = np.fromiter(map(self.index.get, w, repeat(unknown)), np.intp, len(w))
        cls = self.classes[at]
        padded = np.concatenate([[END, END], cls])
        last, before = padded[1:-1].copy(), padded[:-2].copy()
        last[starts] = END
        before[starts] = END
        more = starts[lengths > 1] + 1
        before[more] = END
        first, second, log_z = self.tables
        score = (first[last, cls] + second[before, cls] - log_z[last, before]).astype(np.float64) / np.log(10)
        rest = cls == REST
        head = self.in_head[at]
        score += np.where(rest, self.log_count[at] - self.log_rest, 0.0)
        sums = [np.add.reduceat(x.astype(np.float64), starts) for x in (self.is_known[at], self.log_count[at], score)]
        tail = [[] for _ in texts]
        for i, p in zip((owner := np.searchsorted(ends, np.flatnonzero(~head), "right")).tolist(), (np.flatnonzero(~head) - starts[owner]).tolist()):
            if p < len(words[i]):
                tail[i].append(words[i][p])
        return lengths, *sums, tail


def classes_for(total: int) -> int:
    """Classes of a model of so many training tokens."""
    return max(CLASSES, min(MOST_CLASSES, int(total**0.5 / 4)))


def mean_state(rows) -> tuple[int, np.ndarray | None]:
    """Tokens and mean state of (part, n, state), weighted by tokens, in the order of parts so that reruns agree."""
    total, mean = 0, None
    for _, n, state in sorted(rows, key=lambda r: r[0]):
        if n:
            x = np.frombuffer(bytes(state), np.float32) * float(n)
            total, mean = total + n, x.astype(np.float64) if mean is None else mean + x
    return total, None if mean is None else (mean / total).astype(np.float32)


def averaged(states: DataFrame, parts: int) -> tuple[int, np.ndarray | None]:
    """mean_state() of one row a partition.  Tasks take means of about MEANS rows, in as many levels as it takes until the driver's
    share is LAST_MEANS rows, whatever the number of partitions."""

    def work(batches):
        import pyarrow as pa

        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        n, mean = mean_state(got)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([min(r[0] for r in got)], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["part", "n", "state"])

    while parts > LAST_MEANS:
        parts = math.ceil(parts / MEANS)
        states = states.repartition(parts, "part").mapInArrow(work, "part int, n long, state binary")
    return mean_state(states.collect())


def trained_model(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, empty: Scorer, unigram: np.ndarray, total: int) -> tuple[LogBilinear, int]:
    """The model after ROUNDS rounds, together one pass over all rows outside fold `held`, and the tokens it was trained on in all."""
    model, id_of_index, trained = LogBilinear(unigram), uuid.uuid4().hex, 0
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("_text"))
    parts = d.rdd.getNumPartitions()
    for at in range(ROUNDS if total else 0):
        start = model.state()

        def work(batches, at=at, start=start):
            import pyarrow as pa

            index = per_worker(("lm-train", id_of_index), empty.ready)
            unknown, part = len(index.words), TaskContext.get().partitionId()
            classes = index.classes.astype(np.uint16)

            def texts():
                for b in slices(batches, 256):
                    for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                        if fold_of(i, folds) != held:
                            ws = lowered(t).split()
                            yield np.append(classes[np.fromiter(map(index.index.get, ws, repeat(unknown)), np.intp, len(ws))], np.uint16(END))

            mine = LogBilinear(unigram).load(start)
            n = mine.train_texts(texts(), seed=1_000_003 * at + part)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([mine.state().tobytes()], pa.binary())], names=["part", "n", "state"])

        now = d.filter(F.pmod(F.xxhash64(F.lit("lm"), "id"), F.lit(ROUNDS)) == at)
        n, mean = averaged(now.mapInArrow(work, "part int, n long, state binary"), parts)
        if n:
            model.load(mean)
            trained += n
    return model, trained


def trained_scorer(docs: DataFrame, counts: DataFrame, id_col: str, text_col: str, folds: int, held: int, head: int = HEAD, classes: int | None = None) -> tuple[Scorer, int]:
    """The scorer and the number of training tokens.  counts: a stored word_counts()."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    classes = classes or classes_for(total)
    top = most_frequent(counts, head)
    words, seen = [bytes(r.word) for r in top], np.array([r.c for r in top], np.int64)
    empty = Scorer(words, seen, total, distinct, None, classes)
    by_class = np.zeros(classes)
    np.add.at(by_class, empty.classes_of(), seen)
    by_class[REST] += total - seen.sum()
    model, _ = trained_model(docs, id_col, text_col, folds, held, empty, by_class + 1.0, total)
    return Scorer(words, seen, total, distinct, model.tables(), classes), total


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, head: int = HEAD, classes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs.

    Learns from the rows whose fold isn't `held`, scores all.  A null text counts as empty: the end alone.  Null ids count as
    empty text for the fold.  Rows of one id, or alike in all, are documents each; other columns are not read.  An empty table gives
    an empty result; without training rows every count is 0.
    """
    counts = stored(word_counts(docs, id_col, text_col, folds, held), "lm-counts")
    scorer, total = trained_scorer(docs, counts, id_col, text_col, folds, held, head, classes)
    log_all, id_of_model = float(scorer.log_all), uuid.uuid4().hex

    def work(batches):
        import pyarrow as pa

        ready = per_worker(("lm", id_of_model), scorer.ready)
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_count", "model", "tail"]
        for b in slices(batches, 256):
            n, known, log_count, model, tail = ready.group(text_bytes(b.column(1)))
            part = b.column(0).to_pylist()
            columns = [pa.array(range(row, row + len(part)), pa.int64()), pa.array(part, pa.int64()), pa.array([fold_of(i, folds) == held for i in part], pa.bool_())]
            columns += [pa.array(n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(log_count), pa.array(model), pa.array(tail, pa.list_(pa.binary()))]
            row += len(part)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"))
    head_part = stored(d.mapInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_count double, model double, tail array<binary>"), "lm-head")
    tail = head_part.select("row", F.explode("tail").alias("word")).join(counts, "word")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("_log"))
    out = head_part.drop("tail").join(tail, "row", "left")
    more = F.coalesce(F.col("_log"), F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.col("_known"), F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("log_count") + more - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
