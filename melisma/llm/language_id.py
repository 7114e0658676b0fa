"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time.  It reads a text
in windows of 64 bytes from both ends, gives every position a distribution over
the languages, and a document's probabilities are the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside_text, bound_batches, give_back, table, train_row, training_sample
from .textvec import raw_bytes, text_slices

WINDOW, HIDDEN = 64, 8
#: The bound of the training sample: documents of each language, characters of each.
TRAIN_DOCS, TRAIN_CHARS, STEPS, BATCH = 400, 4000, 260, 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """One reading direction: input table per byte, recurrent weights, and the
    recurrent bias of the candidate gate.  Gate order: update, reset, candidate."""

    table: np.ndarray  # 3H x 256
    inner: np.ndarray  # 3H x H
    bias: np.ndarray  # H x 1

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """States of each step, H x B, and what the way back needs."""
        h = np.zeros((self.inner.shape[1], ids.shape[1]), np.float32)
        n_h, states, kept = len(h), np.empty((len(ids), *h.shape), np.float32), []
        for t, now in enumerate(ids):
            a, g = self.table[:, now], self.inner @ h
            zr = _sigmoid(a[: 2 * n_h] + g[: 2 * n_h])
            z, r, q = zr[:n_h], zr[n_h:], g[2 * n_h :] + self.bias
            n = np.tanh(a[2 * n_h :] + r * q)
            kept.append((h, z, r, q, n))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def backward(self, ids: np.ndarray, kept: list, d_states: np.ndarray) -> list[np.ndarray]:
        d_table, d_inner, d_bias = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.bias)
        d_h, one_hot = np.zeros_like(d_states[0]), np.eye(256, dtype=np.float32)
        for t in range(len(ids) - 1, -1, -1):
            h, z, r, q, n = kept[t]
            d = d_h + d_states[t]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * q * r * (1 - r)
            d_q = d_n * r
            outer = np.concatenate([d_z, d_r, d_n])
            inner = np.concatenate([d_z, d_r, d_q])
            d_table += outer @ one_hot[ids[t]]
            d_inner += inner @ h.T
            d_bias += d_q.sum(1, keepdims=True)
            d_h = d * z + self.inner.T @ inner
        return [d_table, d_inner, d_bias]

    def states(self, ids: np.ndarray, out: np.ndarray, order: range) -> None:
        """As ``forward`` in the given order of steps, into ``out``, in place."""
        n_h = self.inner.shape[1]
        scale = np.repeat(np.float32([0.5, 0.5, 1]), n_h)[:, None]
        table, inner = self.table * scale, self.inner * scale
        h, a, g = np.zeros((n_h, ids.shape[1]), np.float32), np.empty((3 * n_h, ids.shape[1]), np.float32), np.empty((3 * n_h, ids.shape[1]), np.float32)
        zr, z, r, n, q = a[: 2 * n_h], a[:n_h], a[n_h : 2 * n_h], a[2 * n_h :], g[2 * n_h :]
        for t in order:
            np.take(table, ids[t], axis=1, out=a, mode="clip")
            np.matmul(inner, h, out=g)
            zr += g[: 2 * n_h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            q += self.bias
            q *= r
            n += q
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            out[t] = h


@dataclass
class Model:
    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # C x 2H
    out_bias: np.ndarray  # C x 1

    def pooled(self, windows: np.ndarray, sizes: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Sums of the positions' probabilities: languages x windows."""
        total = np.zeros((len(self.langs), len(windows)))
        n_h = self.ahead.inner.shape[1]
        states = np.empty((WINDOW, 2 * n_h, min(at_once, max(1, len(windows)))), np.float32)
        for i in range(0, len(windows), at_once):
            ids, n = np.ascontiguousarray(windows[i : i + at_once].T).astype(np.intp), sizes[i : i + at_once]
            both = states[:, :, : ids.shape[1]]
            self.ahead.states(ids, both[:, :n_h], range(WINDOW))
            self.back.states(ids, both[:, n_h:], range(WINDOW - 1, -1, -1))
            for t in range(WINDOW):
                p = self.out @ both[t]
                p += self.out_bias
                p -= p.max(0)
                np.exp(p, out=p)
                p *= (n > t) / p.sum(0)
                total[:, i : i + at_once] += p
        return total

    def positions(self, text: str) -> np.ndarray:
        """Probabilities of every byte's label: bytes x languages."""
        windows, sizes, _ = to_windows(*raw_bytes(pa.array([text])))
        ids = windows.T.astype(np.intp)
        both = np.empty((WINDOW, self.out.shape[1], len(windows)), np.float32)
        n_h = self.ahead.inner.shape[1]
        self.ahead.states(ids, both[:, :n_h], range(WINDOW))
        self.back.states(ids, both[:, n_h:], range(WINDOW - 1, -1, -1))
        logits = np.einsum("ch,thb->btc", self.out, both) + self.out_bias[:, 0]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        return p.reshape(-1, len(self.langs))[: int(sizes.sum())]


def to_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text's bytes, zero-filled at a text's end; the bytes in
    each; the index of each text's first window."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - offsets[:-1], length)] = data
    sizes = np.full(int(first[-1]), WINDOW)
    some = count > 0
    sizes[first[1:][some] - 1] = length[some] - (count[some] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), sizes, first


def train(sample: list[tuple[str, str]], seed: int = 5, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH) -> Model | None:
    """Fit on ``(language, text)`` pairs; None without any.  Batches hold windows
    of the languages in equal shares; the loss is the mean over positions."""
    langs = sorted({y for y, t in sample if t})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    pools = []
    for lang in langs:
        windows, sizes, _ = to_windows(*raw_bytes(pa.array([t for y, t in sample if y == lang])))
        pools.append((windows, sizes))
    n_c = len(langs)
    init = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    model = Model(langs, Direction(init(3 * hidden, 256), init(3 * hidden, hidden), np.zeros((hidden, 1), np.float32)), Direction(init(3 * hidden, 256), init(3 * hidden, hidden), np.zeros((hidden, 1), np.float32)), init(n_c, 2 * hidden), np.zeros((n_c, 1), np.float32))
    weights = [x for d in (model.ahead, model.back) for x in (d.table, d.inner, d.bias)] + [model.out, model.out_bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, (steps if n_c > 1 else 0) + 1):
        y = rng.integers(0, n_c, batch)
        pick = [rng.integers(0, len(pools[c][0])) for c in y]
        ids = np.stack([pools[c][0][i] for c, i in zip(y, pick, strict=True)], 1).astype(np.intp)
        live = np.arange(WINDOW)[:, None] < np.array([pools[c][1][i] for c, i in zip(y, pick, strict=True)])
        ahead, kept_a = model.ahead.forward(ids)
        back, kept_b = model.back.forward(ids[::-1])
        both = np.concatenate([ahead, back[::-1]], 1)
        logits = np.matmul(model.out, both) + model.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(batch)] -= 1
        p *= (live / live.sum())[:, None, :]
        p = p.astype(np.float32)
        d_both = np.matmul(model.out.T, p)
        grads = model.ahead.backward(ids, kept_a, d_both[:, :hidden]) + model.back.backward(ids[::-1], kept_b, d_both[::-1, hidden:])
        grads += [np.einsum("tcb,thb->ch", p, both), p.sum((0, 2))[:, None]]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = 0.02 * (1 - step / (steps + 1)) ** 0.5
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``df`` without ``text``, and ``lang_pred, score``.

    Null texts and texts without a letter get ``und`` and 0, as does every text
    when nothing could be learned.  Every byte of a text is labelled, however long
    it is; ties go to the first language by name.  Rows pass one by one (no
    shuffle), so repeated rows, null ids and an empty table need no care;
    existing columns ``lang_pred`` and ``score`` are replaced.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    has = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    rows = beside_text(df, keep, F.when(has, F.col(text)))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            names, scores = [], []
            for a, b in text_slices(column):
                part = column.slice(a, b - a)
                if model is None:
                    names += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                windows, sizes, first = to_windows(*raw_bytes(part))
                sums = np.concatenate([np.zeros((len(model.langs), 1)), np.cumsum(model.pooled(windows, sizes), 1)], 1)
                p = sums[:, first[1:]] - sums[:, first[:-1]]
                p /= np.maximum(p.sum(0), 1e-30)
                best = p.argmax(0)
                known = first[1:] > first[:-1]
                names += [model.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
                scores += [min(1.0, float(p[i, j])) if k else 0.0 for j, (i, k) in enumerate(zip(best, known, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
            give_back()

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, per_class: int = TRAIN_DOCS, text_chars: int = TRAIN_CHARS) -> Model | None:
    """Train on the bounded sample of training rows that have a language."""
    classes = docs.where(train_row()).select("doc_id", F.col("lang").alias("y"))
    return train(training_sample(docs, classes, per_class, text_chars))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (~train_row()).alias("held_out"), "text")
    return identify(rows, learn(docs))
