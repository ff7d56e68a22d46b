"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Both directions run over windows of WINDOW bytes, which together cover the whole text; the network gives label probabilities at
every position, and a document's probabilities are their mean.  Training is backpropagation through time on the driver, over
the whole texts of a bounded sample of labelled rows; prediction runs on the executors, many windows at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, text_bytes

UNDETERMINED = "und"
HIDDEN, WINDOW = 8, 64
#: Bound of the training sample: about so many rows; fewer if their whole texts would hold more than about so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32 << 20
#: Hashes of ids are taken modulo this, so a sample can be drawn from any number of rows.
MODULUS = 1 << 62
STEPS, BATCH, RATE = 300, 256, 0.02
#: Windows that prediction advances together.
WIDE = 1024
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


@dataclass
class Direction:
    """Input table (3H, 256), with biases in it; recurrent matrix (3H, H) and bias of the candidate (H, 1)."""

    table: np.ndarray
    u: np.ndarray
    b: np.ndarray


class BiGRU:
    """Gates z, r and candidate n: h += z * (n - h), with n = tanh(x_n + r * (U_n h + b))."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.3, (3 * hidden, 256))
            self.p[f"u{d}"] = r.normal(0, 0.4 / np.sqrt(hidden), (3 * hidden, hidden))
            self.p[f"c{d}"] = np.zeros((hidden, 1))
            self.p[f"x{d}"][:hidden] -= 1.0  # updates begin small
        self.p["w"] = r.normal(0, 0.3, (len(langs), 2 * hidden))
        self.p["o"] = np.zeros((len(langs), 1))

    # Training -----------------------------------------------------------------------------------------------------

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (T, H, B) in the order of x (T, B), and what going back needs."""
        h, n = np.zeros((self.hidden, x.shape[1])), self.hidden
        states, kept = np.empty((len(x), n, x.shape[1])), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g, xt = self.p[f"u{d}"] @ h, self.p[f"x{d}"][:, x[t]]
            z, r = (1 / (1 + np.exp(-(g[i * n : i * n + n] + xt[i * n : i * n + n]))) for i in (0, 1))
            q = g[2 * n :] + self.p[f"c{d}"]
            c = np.tanh(xt[2 * n :] + r * q)
            kept.append((t, h, z, r, q, c))
            h = h + z * (c - h)
            states[t] = h
        return states, kept

    def back(self, x: np.ndarray, d: str, kept: list, ds: np.ndarray, grads: dict) -> None:
        n, u = self.hidden, self.p[f"u{d}"]
        dh = np.zeros_like(ds[0])
        gx, gu, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(self.p[f"c{d}"])
        for t, h, z, r, q, c in reversed(kept):
            dh = dh + ds[t]
            dn = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            dq = dn * r
            inner = np.concatenate([dz, dr, dq])
            outer = np.concatenate([dz, dr, dn])
            gu += inner @ h.T
            gc += dq.sum(axis=1, keepdims=True)
            np.add.at(gx.T, x[t], outer.T)
            dh = dh * (1 - z) + u.T @ inner
        grads |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of every position's label, and gradients.  x: bytes (T, B); y: labels (B); mask (T, B)."""
        (f, kf), (b, kb) = self.run(x, "f"), self.run(x, "b")
        s = np.concatenate([f, b], axis=1)
        logits = self.p["w"] @ s + self.p["o"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        at = (np.arange(len(x))[:, None], y[None, :], np.arange(len(y))[None, :])
        total = mask.sum()
        value = float(-(np.log(p[at] + 1e-12) * mask).sum() / total)
        p[at] -= 1
        p *= mask[:, None, :] / total
        grads = {"w": np.einsum("tkb,thb->kh", p, s), "o": p.sum(axis=(0, 2))[:, None]}
        ds = self.p["w"].T @ p
        self.back(x, "f", kf, ds[:, : self.hidden], grads)
        self.back(x, "b", kb, ds[:, self.hidden :], grads)
        return value, grads

    def train(self, windows: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> list[float]:
        """Adam over random batches, each language as often as the others.  windows (N, T) of bytes."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        share = 1 / np.bincount(y, minlength=len(self.langs)).clip(1)[y]
        share, losses = share / share.sum(), []
        for step in range(1, steps + 1):
            at = r.choice(len(y), size=min(batch, len(y)), p=share)
            mask = (np.arange(windows.shape[1])[:, None] < lengths[at][None, :]).astype(float)
            value, grads = self.loss(windows[at].T.astype(np.intp), y[at], mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(value)
        return losses

    # Prediction ---------------------------------------------------------------------------------------------------

    def frozen(self) -> Frozen:
        return Frozen(self.langs, self.hidden, {k: a.astype(np.float32) for k, a in self.p.items()})


class Frozen:
    """Trained parameters in single precision, for many windows at once."""

    def __init__(self, langs: list[str], hidden: int, p: dict[str, np.ndarray]):
        self.langs, self.hidden, self.dirs = langs, hidden, {}
        for d in "fb":
            half = np.ones((3 * hidden, 1), np.float32)
            half[: 2 * hidden] = 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
            self.dirs[d] = Direction(np.ascontiguousarray(p[f"x{d}"] * half), np.ascontiguousarray(p[f"u{d}"] * half), p[f"c{d}"])
        self.w, self.o = p["w"], p["o"]

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        n, q = self.hidden, self.dirs[d]
        b = x.shape[1]
        h, out = np.zeros((n, b), np.float32), np.empty((len(x), n, b), np.float32)
        g, xt = np.empty((3 * n, b), np.float32), np.empty((3 * n, b), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.matmul(q.u, h, out=g)
            np.take(q.table, x[t], axis=1, out=xt, mode="clip")
            gates, c = g[: 2 * n], g[2 * n :]
            gates += xt[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            c += q.b
            c *= gates[n:]
            c += xt[2 * n :]
            np.tanh(c, out=c)
            c -= h
            c *= gates[:n]
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, languages, B) at every position of windows (T, B)."""
        p = self.w[:, : self.hidden] @ self.states(x, "f")
        p += self.w[:, self.hidden :] @ self.states(x, "b")
        p += self.o
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def documents(self, texts: list[bytes], window: int = WINDOW, wide: int = WIDE) -> np.ndarray:
        """Mean probabilities (documents, languages) over all positions; no position: 0."""
        counts = np.array([-(-len(t) // window) for t in texts])
        flat = np.zeros((int(counts.sum()), window), np.uint8)
        raw, starts = flat.reshape(-1), np.concatenate([[0], np.cumsum(counts)])
        for t, s in zip(texts, starts):
            raw[s * window : s * window + len(t)] = np.frombuffer(t, np.uint8)
        owner = np.repeat(np.arange(len(texts)), counts)
        sizes = np.array([len(t) for t in texts])
        left = np.clip(sizes[owner] - (np.arange(len(flat)) - starts[owner]) * window, 0, window)
        sums = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(flat), wide):
            p = self.positions(flat[a : a + wide].T.astype(np.intp))
            n = left[a : a + wide]
            if n.min() < window:
                p *= (np.arange(window)[:, None] < n[None, :])[:, None, :]
            np.add.at(sums, owner[a : a + wide], p.sum(axis=0, dtype=np.float64).T)
        return sums / np.maximum(sizes, 1)[:, None]


def windows_of(text: bytes, window: int = WINDOW) -> list[bytes]:
    """The windows that cover the whole text."""
    return [text[a : a + window] for a in range(0, len(text), window)]


def sampled(labelled: DataFrame, rows_there: int, rows: int, id_col: str) -> DataFrame:
    """About `rows` of the rows_there rows, by a hash of the id."""
    if rows_there <= rows:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(F.lit("lang"), F.col(f"`{id_col}`")), F.lit(MODULUS)) < MODULUS * rows // rows_there)


def train_language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Frozen | None:
    """Trains on the whole texts of about `rows` rows of labelled, chosen by a hash of the id.

    Of rows whose texts hold more than SAMPLE_BYTES, a share of that size is taken.  Rows without language, or whose text has
    no letter, are left out; without any row there is no model (None).  A draw without rows from labelled ones is an error.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    known = labelled.filter(lang.isNotNull() & text.isNotNull())
    rows_there = known.count()
    chosen = sampled(known, rows_there, rows, id_col)
    size = chosen.agg(F.sum(F.octet_length(text))).first()[0]
    if rows_there and size is None:
        raise RuntimeError("no labelled row was drawn")
    if (size or 0) > SAMPLE_BYTES:
        chosen = sampled(known, rows_there, max(1, int(min(rows, rows_there) * SAMPLE_BYTES / size)), id_col)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = [(lang, t) for lang, t in zip(b.column(1).to_pylist(), text_bytes(b.column(0)), strict=True) if has_letter(t)]
            columns = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary()))], names=["lang", "bytes"])

    got = chosen.select(text, lang).mapInArrow(cut, "lang string, bytes binary").collect()
    if not got:
        return None
    got = sorted((r.lang, bytes(r.bytes)) for r in got)
    langs = sorted({lang for lang, _ in got})
    parts = [(lang, w) for lang, t in got for w in windows_of(t)]
    raw = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, w in parts), np.uint8).reshape(-1, WINDOW)
    number = {lang: i for i, lang in enumerate(langs)}
    model = BiGRU(langs)
    model.train(raw, np.array([len(w) for _, w in parts]), np.array([number[lang] for lang, _ in parts]), steps)
    return model.frozen()


def predicted(docs: DataFrame, model: Frozen | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, the extra columns, lang_pred and score for every row of docs.

    `und` with score 0 where the text is null or has no letter, or there is no model.
    """

    def work(batches):
        import pyarrow as pa

        for b in slices(batches, 128):
            part = text_bytes(b.column(1))
            langs, scores = [UNDETERMINED] * len(part), [0.0] * len(part)
            lettered = [i for i, t in enumerate(part) if has_letter(t)] if model is not None else []
            if lettered:
                for i, p in zip(lettered, model.documents([part[i] for i in lettered])):
                    langs[i], scores[i] = model.langs[int(p.argmax())], min(1.0, float(p.max()))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *[f.name for f in b.schema][2:], "lang_pred", "score"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), *extra)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[2:])
    return d.mapInArrow(work, f"doc_id long, {kept + ', ' if kept else ''}lang_pred string, score double")


def held_out_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose fold isn't 0, predicted for all."""
    held = (fold("doc_id", folds) == 0).alias("held_out")
    return predicted(docs, train_language_model(docs.filter(fold("doc_id", folds) != 0)), extra=(held,))
