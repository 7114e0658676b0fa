"""Token counts: Arrow batches in, lengths out.

Texts are encoded by the tokenizer's own library in slices of about equal bytes.
A long text is cut only where the pre-tokenizer always ends a piece, so the counts
of the parts add up to the count of the whole: between a non-space character and
the white space after it, and between a letter or number and an East Asian
punctuation mark on either side of it.  A run of letters without either is one
piece to the tokenizer too and stays whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside_text, bound_batches, table

#: The last character of a piece, before the one at which a new piece starts.
_MARKS = "\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\u300c\u300d\u300e\u300f\uff08\uff09\u2026"
_CUT = re.compile(rf"\S(?=[ \t\n\r\u3000])|[^\W_](?=[{_MARKS}])|[{_MARKS}](?=[^\W_])")


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def safe_parts(text: str, size: int) -> list[str]:
    """Cut ``text`` into parts of about ``size`` bytes or a little more, at safe
    boundaries only; a text without one stays whole."""
    total = n_bytes(text)
    if total <= size:
        return [text]
    size = max(1, size * len(text) // total)  # in characters
    parts, at = [], 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size - 1)
        if not found:
            break
        parts.append(text[at : found.end()])
        at = found.end()
    parts.append(text[at:])
    return parts


class _Counter:
    """Counts tokens with the library that the vocabulary file belongs to."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splits = path.endswith(".json")
        if self.splits:
            from tokenizers import Tokenizer

            self._t = Tokenizer.from_file(path)
            self._t.no_truncation()
            self._t.no_padding()
        else:
            import sentencepiece

            self._t = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        if self.splits:
            return [len(x) for x in self._t.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in self._t.encode(texts, num_threads=1)]


def _resolve(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(texts: list[str], sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose texts have about ``limit`` bytes together."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 20, part_bytes: int = 1 << 16) -> DataFrame:
    """Replace column ``text`` by ``n_bytes`` and ``n_tokens``; all other columns stay.

    ``vocabulary`` is a file path, the same on every executor, or a name that the
    installed tokenizer package resolves: ``.json`` is read by ``tokenizers``,
    ``.model`` by ``sentencepiece`` (whose texts stay whole: it puts a word mark
    before each part).  No tokens are added, cut off or padded; special strings
    inside texts are encoded as the library does by default.

    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows and null ids
    pass through row by row, an empty table gives an empty table, and the columns
    that come back are those of ``df``, so nothing can clash except existing
    columns named ``n_bytes`` or ``n_tokens``, which are replaced.  The plan has
    no shuffle: a hot source is only more rows of the scan.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens")]
    source = beside_text(df, keep, F.col(text))
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(_resolve(vocabulary))
        for batch in batches:
            column = batch.column(len(keep))
            lengths, n_tokens = [], []
            for at in range(0, batch.num_rows, 256):
                texts = [x or "" for x in column.slice(at, 256).to_pylist()]
                sizes = [n_bytes(x) for x in texts]
                lengths += sizes
                got = [0] * len(texts)
                parts = []
                for i, (x, n) in enumerate(zip(texts, sizes, strict=True)):
                    if count.splits and n > part_bytes:
                        parts += [(i, p, n_bytes(p)) for p in safe_parts(x, part_bytes)]
                    elif n:
                        parts.append((i, x, n))
                for a, b in slices([p for _, p, _ in parts], [n for _, _, n in parts], batch_bytes):
                    for (i, _, _), n in zip(parts[a:b], count([p for _, p, _ in parts[a:b]]), strict=True):
                        got[i] += n
                n_tokens += got
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(lengths, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 1024)
