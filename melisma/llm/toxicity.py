"""Toxicity by a linear-chain conditional random field over words.

The field has two labels, features of a word's form, its prefixes and the forms
before and after it, and a 2 x 2 transition table.  Tokens are labelled first by a
likelihood-ratio test of forms and prefixes on distinct documents; the field learns
these sequences and then relabels them itself: in further rounds a token's label is
its forward-backward posterior given its document's label (a toxic document has a
toxic token somewhere, a clean one has none, but for a stated share of wrong labels),
so it unlearns words that the test named wrongly and learns those it missed.

A document's score is the probability that not all tokens of its most offending
sequence of 64 words are clean, from the forward pass, so a long text gathers no
score from its length alone; the marginals give the offending offsets.
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
from .textvec import Words, mix64, shingles, text_slices, words_of

#: The bound of the training sample: documents of each label, characters of each.
TRAIN_DOCS, TRAIN_CHARS = 4000, 100_000
PREFIXES = (4, 5, 6)
BITS, SEQUENCE = 22, 64
#: Least likelihood ratio, and share of a marker's documents that are toxic.
LEAST_G2, PURITY = 20.0, 0.8
SPAN_AT = 0.3
#: A feature occurs in so many distinct documents of the sample.
LEAST_DOCS = 2
#: The share of labels that is taken to be wrong, either way.
NOISE = 0.02
#: Rounds over token labels, and over document labels.
SEED_ROUNDS, ROUNDS = 3, 6


def features(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and 64-bit hashes of their features: a row for the form and one for
    each prefix, 0 where a word is shorter than the prefix."""
    w = words_of(column, PREFIXES)
    rows = [w.hash | np.uint64(1)] + [np.where(w.end - w.start >= k, mix64(w.prefix[k]) | np.uint64(1), np.uint64(0)) for k in PREFIXES]
    return w, np.stack(rows)


def sequences(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text's words into sequences of 64: the start and the size of each,
    and each text's first sequence."""
    count = -(-np.diff(first) // SEQUENCE)
    bound = np.concatenate([[0], np.cumsum(count)])
    inside = np.arange(int(bound[-1])) - np.repeat(bound[:-1], count)
    start = np.repeat(first[:-1], count) + inside * SEQUENCE
    return start, np.minimum(SEQUENCE, np.repeat(first[1:], count) - start), bound


@dataclass
class Field:
    keys: np.ndarray  # hashes of the features with a weight, sorted
    weights: np.ndarray  # 3 x keys: for the word itself, the next word, the word before
    bias: float
    chain: np.ndarray  # 2 x 2, log potentials from label to label

    def marginals(self, emit: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over sequences: ``emit`` is steps x sequences, the log
        odds of toxic; past a sequence's size all is clean and certain.  Gives the
        toxic marginals, each sequence's summed pair marginals (2 x 2 x sequences)
        and the log probability that all of a sequence is clean."""
        steps, n = emit.shape
        t = np.exp(self.chain)
        e = np.exp(np.clip(emit, -30, 30))
        live = np.arange(steps)[:, None] < size
        f, scale = np.empty((steps, 2, n)), np.empty((steps, n))
        f[0, 0], f[0, 1] = 1.0, e[0]
        for i in range(steps):
            if i:
                np.matmul(t.T, f[i - 1], out=f[i])
                f[i, 1] *= e[i]
            scale[i] = f[i, 0] + f[i, 1]
            f[i] /= scale[i]
        clean = np.maximum(size - 1, 0) * self.chain[0, 0] - np.where(live, np.log(scale), 0.0).sum(0)
        b = np.ones((2, n))
        p = np.empty((steps, n))
        joint = np.zeros((2, 2, n))
        for i in range(steps - 1, -1, -1):
            if i < steps - 1:
                into = b.copy()
                into[1] *= e[i + 1]
                into = np.where(live[i + 1], into, 1.0)
                each = f[i][:, None] * t[:, :, None] * into[None]
                joint += each * (live[i + 1] / each.sum((0, 1)))
                b = np.where(live[i + 1], t @ into, 1.0)
                b /= b.sum(0)
            q = f[i] * b
            p[i] = q[1] / q.sum(0)
        return np.where(live, p, 0.0), joint, np.minimum(clean, 0.0)

    def emissions(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each word; ``first`` bounds each text's words.  A bitmap over
        the hashes' last bits passes the few words whose features may have a weight;
        the search is exact."""
        out = np.full(rows.shape[1], self.bias)
        mask = np.uint64((1 << BITS) - 1)
        maybe = np.zeros(1 << BITS, bool)
        maybe[self.keys & mask] = True
        for i, row in enumerate(rows):
            at = np.flatnonzero(maybe[row & mask])
            place = np.searchsorted(self.keys, row[at])
            place[place == len(self.keys)] = 0
            same = self.keys[place] == row[at] if len(self.keys) else np.zeros(0, bool)
            at, place = at[same], place[same]
            out[at] += self.weights[0, place]
            if i == 0 and len(at):
                text = np.searchsorted(first, at, "right") - 1
                before, after = at > first[text], at + 1 < first[text + 1]
                out[at[after] + 1] += self.weights[1, place[after]]
                out[at[before] - 1] += self.weights[2, place[before]]
        return out


def _grid(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of words as steps x sequences, 0 past a sequence's end."""
    at = start + np.arange(SEQUENCE)[:, None]
    return np.where(np.arange(SEQUENCE)[:, None] < size, values[np.minimum(at, max(0, len(values) - 1))], 0)


def _shards(row: np.ndarray, bits: int = 3) -> Iterator[np.ndarray]:
    """Places of a row's features by their first bits: what is counted over them
    takes an eighth of the memory at a time."""
    first = (row >> np.uint64(64 - bits)).astype(np.uint8)
    for k in range(1 << bits):
        yield np.flatnonzero(first == k)


def mark(rows: list[np.ndarray], text_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each word, whether it carries a marker and its text is toxic."""
    n_pos, n = int(toxic.sum()), len(toxic)
    marked = np.zeros(len(text_of), bool)
    if not n_pos or n_pos == n:
        return marked
    q = n_pos / n
    for row in rows:
        for at in _shards(row):
            keys, index = np.unique(row[at], return_inverse=True)
            seen = np.unique((index.astype(np.int64) << 32) | text_of[at])
            feature, of = seen >> 32, seen & 0xFFFFFFFF
            total = np.bincount(feature, minlength=len(keys)).astype(float)
            pos = np.bincount(feature, weights=toxic[of], minlength=len(keys))
            neg = total - pos
            with np.errstate(divide="ignore", invalid="ignore"):
                g2 = 2 * (np.where(pos > 0, pos * np.log(pos / (total * q)), 0) + np.where(neg > 0, neg * np.log(neg / (total * (1 - q))), 0))
            marked[at] |= ((g2 >= LEAST_G2) & (pos >= PURITY * total) & (keys != 0))[index]
    return marked & toxic[text_of]


class Distinct:
    """Tells texts that are no copy or near copy of an earlier one: texts that
    share one of four min-hashes of word triples count as copies, for a copied
    toxic document would make all of its words look toxic."""

    def __init__(self, tries: int = 4) -> None:
        self.tries, self.seen = tries, set()

    def __call__(self, words: Words) -> np.ndarray:
        h, bound = shingles(words, 3)
        at = np.minimum(bound[:-1], max(0, len(h) - 1))
        least = [np.minimum.reduceat(mix64(h + np.uint64(977 * i)), at) for i in range(self.tries)] if len(h) else []
        out = np.zeros(len(bound) - 1, bool)
        for i in np.flatnonzero(np.diff(bound)):
            keys = [(j, int(x[i])) for j, x in enumerate(least)]
            out[i] = self.seen.isdisjoint(keys)
            self.seen.update(keys)
        return out


def prepare(sample: list[tuple[int, str]], at_once: int = 256) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature rows (an array each) of the sample's distinct texts, the bounds of each text's words
    and whether it is toxic; worked through a few texts at a time."""
    new, parts, sizes, toxic = Distinct(), [[] for _ in range(1 + len(PREFIXES))], [], []
    for i in range(0, len(sample), at_once):
        part = sample[i : i + at_once]
        w, own = features(pa.array([t for _, t in part], pa.large_string()))
        alone = new(w)
        keep = alone[w.text_of()]
        for k, row in enumerate(own):
            parts[k].append(row[keep])
        sizes.append(np.diff(w.first)[alone])
        toxic.append(np.array([int(y) == 1 for y, _ in part])[alone])
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    rows = []
    for part in parts:
        rows.append(np.concatenate(part))
        part.clear()
    return rows, first, np.concatenate(toxic)


def _features_kept(rows: list[np.ndarray], text_of: np.ndarray) -> np.ndarray:
    """Hashes of the features in ``LEAST_DOCS`` texts at least, in order; 0 comes
    first and stands for all others."""
    found = [np.zeros(1, np.uint64)]
    for row in rows:
        for at in _shards(row):
            at = at[np.argsort(row[at], kind="stable")]  # a feature's words stay in order of their texts
            key, text = row[at], text_of[at]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            keys, count = np.unique(key[new], return_counts=True)
            found.append(keys[count >= LEAST_DOCS])
    return np.unique(np.concatenate(found))


class _Learner:
    """Adagrad on the field's weights, by batches of whole documents."""

    def __init__(self, field: Field, index: list[np.ndarray], first: np.ndarray, rate: float) -> None:
        self.field, self.index, self.first, self.rate = field, index, first, rate
        self.start, self.size, self.bound = sequences(first)
        self.squares, self.chain_squares, self.bias_square = np.full(field.weights.shape, 1e-2), np.full((2, 2), 1e-2), 1e-2
        # The forms before and after each word; 0 at a text's ends.
        form = index[0]
        self.before, self.after = np.zeros(len(form), np.int32), np.zeros(len(form), np.int32)
        self.before[1:], self.after[:-1] = form[:-1], form[1:]
        held = np.diff(first) > 0
        self.before[first[:-1][held]] = 0
        self.after[first[1:][held] - 1] = 0

    def batches(self, rng: np.random.Generator, most: int = 512) -> Iterator[np.ndarray]:
        """Documents in random order, some 512 sequences at a time."""
        docs = rng.permutation(np.flatnonzero(np.diff(self.bound) > 0))
        part = np.cumsum(np.diff(self.bound)[docs]) // most
        yield from np.split(docs, np.flatnonzero(np.diff(part)) + 1)

    def step(self, docs: np.ndarray, pull) -> None:
        """One step: ``pull`` gives, of the documents, the sequences' bounds, their
        marginals and clean log probabilities, the wanted change of the marginals
        and of the summed pairs."""
        f = self.field
        pick = np.concatenate([np.arange(self.bound[d], self.bound[d + 1]) for d in docs])
        s, n = self.start[pick], self.size[pick]
        at = np.minimum(s + np.arange(SEQUENCE)[:, None], len(self.before) - 1)
        live = np.arange(SEQUENCE)[:, None] < n
        ids, before, after = np.stack([x[at] for x in self.index]), self.before[at], self.after[at]
        emit = f.weights[0][ids].sum(0) + f.weights[1][before] + f.weights[2][after] + f.bias
        p, joint, clean = f.marginals(np.where(live, emit, 0), n)
        d, g = pull(docs, np.repeat(np.arange(len(docs)), np.diff(self.bound)[docs]), at, live, p, joint, clean, n)
        k = f.weights.shape[1]
        flat = d.ravel()
        own = np.bincount(ids.ravel(), weights=np.broadcast_to(d, ids.shape).ravel(), minlength=k)
        grad = np.stack([own, np.bincount(before.ravel(), weights=flat, minlength=k), np.bincount(after.ravel(), weights=flat, minlength=k)])
        grad -= np.array([[1e-3], [1e-1], [1e-1]]) * f.weights
        grad[:, 0] = 0.0
        self.squares += grad * grad
        f.weights += self.rate * grad / np.sqrt(self.squares)
        g = g - 1e-2 * f.chain
        self.chain_squares += g * g
        f.chain += self.rate * g / np.sqrt(self.chain_squares)
        self.bias_square += d.sum() ** 2
        f.bias += self.rate * d.sum() / np.sqrt(self.bias_square)


def train(sample: list[tuple[int, str]], rate: float = 0.5, rounds: int = ROUNDS) -> Field:
    """Fit on ``(0 or 1, text)`` pairs.  Without toxic pairs, or without a word that
    the likelihood-ratio test names, the field calls everything clean.  Weights near
    0 are left out of the field."""
    empty = Field(np.zeros(0, np.uint64), np.zeros((3, 0)), -12.0, np.zeros((2, 2)))
    if not any(int(y) == 1 for y, _ in sample):
        return empty
    rows, first, toxic = prepare(sample)
    text_of = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(first))
    y = mark(rows, text_of, toxic)
    if not y.any():
        return empty
    keys = _features_kept(rows, text_of)
    index = []
    while rows:
        row = rows.pop(0)
        place = np.searchsorted(keys, row).astype(np.int32)
        place[place == len(keys)] = 0
        index.append(np.where(keys[place] == row, place, np.int32(0)))
    del text_of
    give_back()
    field = Field(keys, np.zeros((3, len(keys))), -6.0, np.zeros((2, 2)))
    learner, rng = _Learner(field, index, first, rate), np.random.default_rng(3)

    def to_tokens(docs, of, at, live, p, joint, clean, n):
        gold = np.where(live, y[at], 0).astype(float)
        before, after, both = gold[:-1], gold[1:], live[1:]
        seen = np.array([[((1 - before) * (1 - after) * both).sum(), ((1 - before) * after * both).sum()], [(before * (1 - after) * both).sum(), (before * after * both).sum()]])
        return np.where(live, gold - p, 0.0), seen - joint.sum(2)

    def to_documents(docs, of, at, live, p, joint, clean, n):
        # The gradient of the label's log likelihood: the posterior of the tokens
        # given the label less their marginals is a multiple of the marginals.
        none = np.exp(np.bincount(of, weights=clean, minlength=len(docs)))
        sure = 1 - 2 * NOISE
        some = NOISE + sure * (1 - none)
        pull = np.where(toxic[docs], sure * none / some, -sure * none / (1 - some))[of]
        pairs = joint * pull
        lost = np.array([[((n - 1) * pull).sum(), 0.0], [0.0, 0.0]])
        return p * pull, pairs.sum(2) - lost

    for i in range(SEED_ROUNDS + rounds):
        for docs in learner.batches(rng):
            learner.step(docs, to_tokens if i < SEED_ROUNDS else to_documents)
    strong = np.abs(field.weights).max(0) > 0.05
    strong[0] = False
    field.keys, field.weights = keys[strong], field.weights[:, strong]
    return field


def score(df: DataFrame, field: Field, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of ``df`` without ``text``, ``score``, and with ``spans`` the
    offending words: byte offsets in the UTF-8 text and their marginals.

    The score is the greatest probability, over sequences of 64 words, that some
    word is toxic.  Null texts,
    and texts without a word, score 0 and have no spans.  Whole texts are scored,
    however long; rows pass one by one (no shuffle), so repeated rows,
    null ids and empty tables need no care.  Existing columns ``score`` and
    ``spans`` are replaced.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, "score", "spans")]
    rows = beside_text(df, keep, F.col(text))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType()), *([T.StructField("spans", span)] if spans else [])])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            scores, found = [], []
            for a, b in text_slices(column):
                w, hashes = features(column.slice(a, b - a))
                start, size, bound = sequences(w.first)
                p, clean = np.zeros((SEQUENCE, 0)), np.zeros(0)
                if len(start):
                    p, _, clean = field.marginals(_grid(field.emissions(hashes, w.first), start, size), size)
                top = np.append(1 - np.exp(clean), 0.0)
                best = np.maximum.reduceat(top, np.minimum(bound[:-1], len(top) - 1)) if b > a else top[:0]
                scores += np.where(bound[1:] > bound[:-1], best, 0.0).tolist()
                if spans:
                    step, seq = np.nonzero(p.T >= SPAN_AT)[::-1]
                    word = start[seq] + step
                    of = np.searchsorted(w.first, word, "right") - 1
                    hits = [[] for _ in range(b - a)]
                    for i, j, k, s in zip(of.tolist(), word.tolist(), step.tolist(), seq.tolist(), strict=True):
                        hits[i].append({"start": int(w.start[j] - w.offsets[i]), "end": int(w.end[j] - w.offsets[i]), "p": float(p[k, s])})
                    found += hits
            columns = [pa.array(scores, pa.float64())] + ([pa.array(found, arrow_span)] if spans else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=[*keep, "score", *(["spans"] if spans else [])])

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, text_chars: int = TRAIN_CHARS) -> Field:
    """Train on the bounded sample of labelled training rows.  A document with
    several labels counts as toxic if any of them says so."""
    known = labels.where(F.col("toxic").isNotNull() & train_row()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return train(training_sample(docs, known, per_class, text_chars))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (~train_row()).alias("held_out"), "text")
    return score(rows, field).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
