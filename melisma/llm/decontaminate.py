"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF rows over the words they use, with document
frequencies counted over the whole corpus.  A distributed randomised SVD of these
rows gives the latent space, one for each block of no more pieces than dimensions,
so that no piece loses weight in it.  Every passage of every document (blocks of words,
two by two, so that neighbours overlap by half) is projected into it and compared
with the benchmark by cosine.  Candidates are then checked by the longest common
subsequence of words and, for paraphrases, by the words of the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, table, work_dir, written
from .textvec import Words, text_slices, words_of

#: Words of half a passage; a benchmark text is cut into pieces of as many words
#: as a passage, so that each piece can be found on its own.
HALF = 32
#: Dimensions of the latent space, the sketch's extra ones, and power iterations.
RANK, EXTRA, POWER = 256, 16, 2
#: A candidate's cosine, and the share of a piece's weight that it must hold.
COSINE, COVER = 0.3, 0.4
#: A piece is found if its common subsequence with the passage has this share of
#: its words, or the lower share and the answer is there too.
VERBATIM, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.7, 0.5, 0.8, 8
#: Values of the blocks' bases (64 MB) that one search takes at a time.
SEARCH_VALUES = 8_000_000
#: Words whose document frequencies one pass counts.
VOCABULARY = 4_000_000


@dataclass
class Pieces:
    """A block of the benchmark's pieces."""

    item: np.ndarray  # item id of each piece
    words: list[np.ndarray]  # word hashes in order
    vocab: np.ndarray  # sorted hashes of all words
    idf: np.ndarray  # of each
    latent: np.ndarray | None = None  # pieces x rank
    basis: np.ndarray | None = None  # vocabulary x rank


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of item texts: ``item, nth, words``."""
    for batch in batches:
        w = words_of(batch.column(1))
        item, nth, words = [], [], []
        for i, name in enumerate(batch.column(0).to_pylist()):
            own = w.hash[w.first[i] : w.first[i + 1]].view(np.int64)
            # Halves two by two, so that pieces overlap by half as passages do.
            halves = np.array_split(own, 2 * max(1, round(len(own) / (2 * HALF))))
            for k, part in enumerate([own] if len(halves) == 2 else [np.concatenate(x) for x in zip(halves, halves[1:])]):
                if len(part):
                    item.append(name)
                    nth.append(k)
                    words.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(nth, pa.int32()), pa.array(words, pa.list_(pa.int64()))], names=["item", "nth", "words"])


def benchmark_pieces(bench: DataFrame, item_id: str, text: str, path: str) -> DataFrame:
    """The benchmark's texts cut into pieces, as a written table ``item, nth, words``."""
    known = bench.select(F.col(item_id).cast("bigint").alias("item"), F.col(text).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    return written(known.mapInArrow(_cut, "item bigint, nth int, words array<bigint>"), path)


def blocks_of(pieces: DataFrame, vocab: np.ndarray, idf: np.ndarray) -> Iterator[Pieces]:
    """Blocks of ``RANK`` pieces, in order; the driver holds one at a time."""
    held: list[tuple] = []

    def block() -> Pieces:
        words = [np.array(w, np.int64).view(np.uint64) for _, w in held]
        own = np.unique(np.concatenate(words))
        return Pieces(np.array([i for i, _ in held], np.int64), words, own, idf[np.searchsorted(vocab, own)])

    for r in pieces.orderBy("item", "nth", "words").toLocalIterator():
        held.append((r["item"], r["words"]))
        if len(held) == RANK:
            yield block()
            held.clear()
    if held:
        yield block()


def _places(w: Words, vocab: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that are in the vocabulary: their places in the text and in it."""
    at = np.flatnonzero(maybe[w.hash & np.uint64(len(maybe) - 1)])
    if not len(vocab):
        return at[:0], at[:0]
    place = np.searchsorted(vocab, w.hash[at])
    place[place == len(vocab)] = 0
    same = vocab[place] == w.hash[at]
    return at[same], place[same]


def _bitmap(vocab: np.ndarray, bits: int = 22) -> np.ndarray:
    maybe = np.zeros(1 << bits, bool)
    maybe[vocab & np.uint64((1 << bits) - 1)] = True
    return maybe


def document_frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each benchmark word occurs, over all documents, and
    how many documents there are.  Tasks sum before the shuffle: a task sends at
    most one row per word of the benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, total, n = _bitmap(vocab), np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a, b in text_slices(batch.column(0)):
                w = words_of(batch.column(0).slice(a, b - a))
                at, place = _places(w, vocab, maybe)
                of = np.searchsorted(w.first, at, "right") - 1
                seen = np.unique(of * np.int64(len(vocab)) + place) % max(1, len(vocab))
                total += np.bincount(seen, minlength=len(vocab))
        give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["w", "n"])

    counts = docs.mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocab), np.int64)
    words = counts[counts["w"] >= 0]
    df[words["w"].to_numpy()] = words["n"].to_numpy()
    return df, int(counts.loc[counts["w"] < 0, "n"].sum())


def _rows(words: list[np.ndarray], vocab: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each piece as a sparse row: places in the vocabulary and TF-IDF weights, a
    word that occurs n times counting 1 + log n times."""
    out = []
    for own in words:
        some, count = np.unique(own, return_counts=True)
        place = np.searchsorted(vocab, some)
        out.append((place, idf[place] * (1 + np.log(count))))
    return out


def randomised_svd(spark: SparkSession, pieces: Pieces, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Orthonormal basis (vocabulary x rank) of the pieces' leading right singular
    vectors, by a randomised range finder with power iterations.

    The rows lie in Spark partitions; a pass sends A'(A Q) of each partition, a
    matrix whose size is the vocabulary's times the rank's, summed in a tree.
    """
    idf, vocab = pieces.idf, pieces.vocab
    width = min(rank + EXTRA, len(pieces.words), len(vocab))
    n_parts = max(1, min(64, len(pieces.words) // 200))
    rows = spark.createDataFrame(pd.DataFrame({"words": [x.view(np.int64).tolist() for x in pieces.words]}), "words array<bigint>").repartition(n_parts)

    def sketch(q: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(q)
            for batch in batches:
                for own in batch.column(0).to_pylist():
                    (place, weight), = _rows([np.array(own, np.int64).view(np.uint64)], vocab, idf)
                    total[place] += np.outer(weight, weight @ q[place])
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["w", "row"])

        return run

    q = np.random.default_rng(seed).normal(size=(len(vocab), width))
    for _ in range(POWER + 1):
        parts = rows.mapInArrow(sketch(q), "w bigint, row array<double>")
        summed = parts.groupBy("w").agg(F.array(*(F.sum(F.col("row")[i]) for i in range(width))).alias("row")) if n_parts > 1 else parts
        got = summed.toPandas()
        y = np.zeros((len(vocab), width))
        if len(got):
            y[got["w"].to_numpy()] = np.stack(got["row"].to_numpy())
        q = np.linalg.qr(y)[0]
    # The sketch's small side: rotate to singular vectors and drop the extra ones.
    b = np.stack([weight @ q[place] for place, weight in _rows(pieces.words, vocab, idf)])
    return q @ np.linalg.svd(b, full_matrices=False)[2].T[:, :rank]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = at.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Block:
    """What a search needs of a block of pieces, as it goes to the tasks."""

    def __init__(self, pieces: Pieces) -> None:
        rows = _rows(pieces.words, pieces.vocab, pieces.idf)
        self.item, self.vocab = pieces.item, pieces.vocab
        # The most that one occurrence of a word can add to a product with a piece.
        self.reach = np.zeros(len(pieces.vocab))
        for place, weight in rows:
            self.reach[place] = np.maximum(self.reach[place], weight)
        self.reach *= pieces.idf
        self.norm2 = np.array([(w * w).sum() for _, w in rows])
        self.latent_norm = np.linalg.norm(pieces.latent, axis=1)
        self.unit = pieces.latent / np.maximum(self.latent_norm, 1e-12)[:, None]
        # A passage whose words reach less than this covers no piece.
        self.least = COVER * self.norm2.min(initial=np.inf) * 0.999
        self.projected = pieces.idf[:, None] * pieces.basis
        self.ordered = [x.view(np.int64).tolist() for x in pieces.words]

    def passages(self, w: Words, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Text, first half, vocabulary places and term factors of each passage heavy
        enough."""
        of = np.searchsorted(w.first, at, "right") - 1
        half = (at - w.first[of]) // HALF
        key = of.astype(np.int64) << 32 | half
        keys, start = np.unique(key, return_index=True)
        end = np.append(start[1:], len(key))
        mass = np.add.reduceat(self.reach[place], start) if len(start) else np.zeros(0)
        for i, k in enumerate(keys.tolist()):
            j = i + 1 if i + 1 < len(keys) and keys[i + 1] == k + 1 else i
            alone = i == 0 or keys[i - 1] != k - 1
            if j == i and not alone:
                continue  # the passage before has this half
            if mass[i] + (mass[j] if j > i else 0.0) >= self.least:
                own, count = np.unique(place[start[i] : end[j]], return_counts=True)
                yield k >> 32, k & 0xFFFFFFFF, own, 1 + np.log(count)

    def candidates(self, w: Words, at: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """Text, first half, piece and cosine of passages near a piece."""
        heavy = list(self.passages(w, at, place))
        for c in range(0, len(heavy), 512):
            some = heavy[c : c + 512]
            mine = np.stack([tf @ self.projected[p] for _, _, p, tf in some])
            dots = mine @ self.unit.T
            cos = dots / np.maximum(np.linalg.norm(mine, axis=1), 1e-12)[:, None]
            cover = dots * self.latent_norm / self.norm2
            for i, k in zip(*np.nonzero((cos >= COSINE) & (cover >= COVER)), strict=True):
                yield some[i][0], some[i][1], k, float(cos[i, k])


def _search(blocks: list[_Block], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = np.unique(np.concatenate([block.vocab for block in blocks]))
        maybe, inside = _bitmap(vocab), []
        for block in blocks:
            own = np.full(len(vocab), -1, np.int64)
            own[np.searchsorted(vocab, block.vocab)] = np.arange(len(block.vocab))
            inside.append(own)
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                w = words_of(batch.column(0).slice(a, b - a))
                found: dict[tuple[int, int], tuple] = {}
                at, place = _places(w, vocab, maybe)
                for block, own in zip(blocks, inside, strict=True):
                    mine = own[place] >= 0
                    for text, half, k, cos in block.candidates(w, at[mine], own[place[mine]]):
                        piece = block.ordered[k]
                        # A piece may begin before the passage or end after it.
                        low = max(int(w.first[text]), int(w.first[text]) + half * HALF - len(piece))
                        high = min(int(w.first[text + 1]), int(w.first[text]) + (half + 2) * HALF + len(piece))
                        here = w.hash[low:high].view(np.int64).tolist()
                        share = common_subsequence(piece, here) / len(piece)
                        answer = piece[-ANSWER_WORDS:]
                        said = common_subsequence(answer, here) / len(answer)
                        if share >= VERBATIM or (share >= PARAPHRASE and said >= ANSWER):
                            key = (text, int(block.item[k]))
                            found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (share, said, cos))
                keys = list(found)
                rows = pa.array([a + t for t, _ in keys], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i + 1).take(rows) for i in range(len(names))), pa.array([k for _, k in keys], pa.int64()), *(pa.array([found[k][i] for k in keys], pa.float64()) for i in range(3))],
                    names=[*names, "item_id", "lcs_share", "answer_share", "cosine"],
                )
            give_back()

    return run


def leaks(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns of ``keep``, and ``item_id, lcs_share, answer_share,
    cosine``: one row for each document (row) and benchmark item of which it holds a
    piece.

    Null and empty texts leak nothing and null or empty items are found nowhere;
    repeated rows of ``docs`` each give their rows, repeated items one.  Of pieces of
    one item, and of equal passages, the best counts by share, answer and cosine in
    this order, so ties can't be seen.  Rows with a null id are searched too and give
    a null id.  Very long texts are searched whole.  An empty table gives no rows.
    Other columns are not read and may have any name.

    Passes over the texts without a shuffle of them: one for document frequencies,
    one for each search.  The benchmark goes to the tasks in blocks of ``RANK``
    pieces, all of them against all documents; a search takes as many blocks as have
    ``SEARCH_VALUES`` values in their bases.  The driver holds the benchmark's
    vocabulary (16 bytes a word) and the blocks of one search.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = work_dir(spark, "leaks")
    names = ["doc_id", *(f"__keep{i}" for i in range(len(keep)))]
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"), *(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)))
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("lcs_share", "answer_share", "cosine"))])
    pieces = benchmark_pieces(bench, item_id, item_text, f"{path}/pieces")
    words = pieces.select(F.explode("words").alias("w")).distinct().toPandas()["w"].to_numpy(np.int64)
    vocab = np.sort(words.view(np.uint64))
    results: list[DataFrame] = []
    if len(vocab):
        idf = np.empty(len(vocab))
        for i in range(0, len(vocab), VOCABULARY):
            df, n = document_frequencies(rows.select("text"), vocab[i : i + VOCABULARY])
            idf[i : i + VOCABULARY] = np.log((n + 1) / (df + 1)) + 1e-3
        held, values, parts = [], 0, blocks_of(pieces, vocab, idf)
        part = next(parts, None)
        while part:
            part.basis = randomised_svd(spark, part)
            part.latent = np.stack([weight @ part.basis[place] for place, weight in _rows(part.words, part.vocab, part.idf)])
            held.append(_Block(part))
            values += part.basis.size
            part = next(parts, None)
            # All pieces of an item are in one search, which keeps the best of them.
            if part is None or (values >= SEARCH_VALUES and part.item[0] != held[-1].item[-1]):
                found = rows.mapInArrow(_search(held, names), schema)
                # Of several searches each is written, so that its blocks can go.
                results.append(found if part is None and not results else written(found, f"{path}/search-{len(results)}"))
                held, values = [], 0
    out = spark.createDataFrame([], schema)
    if results:
        out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    out = out.select("doc_id", *(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)), "item_id", "lcs_share", "answer_share", "cosine")
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
