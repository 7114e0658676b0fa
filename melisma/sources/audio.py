"""16-bit audio as samples in [-1, 1]."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in one row: a long recording is cut, so no row grows with it.
BLOCK = 1 << 16
SCHEMA = "path string, ci int, rate int, first bigint, samples array<float>"


def read_wav(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """``path, ci, rate, first, samples``: blocks of samples with the first one's index."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                with wave.open(io.BytesIO(bytes(content))) as w:
                    n = w.getnchannels()
                    at = 0
                    while raw := w.readframes(BLOCK):
                        x = np.clip(np.frombuffer(raw, "<i2").reshape(-1, n) / 32768.0, -1, 1).astype(np.float32)
                        yield pd.DataFrame([(p, c, w.getframerate(), at, x[:, c].tolist()) for c in range(n)], columns=["path", "ci", "rate", "first", "samples"])
                        at += len(x)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def samples(blocks: DataFrame, center: bool = False) -> DataFrame:
    """``path, ci, rate, i, x``: one row per sample, without the mean if asked."""
    rows = blocks.select("path", "ci", "rate", "first", F.posexplode("samples").alias("k", "x")).select("path", "ci", "rate", (F.col("first") + F.col("k")).alias("i"), F.col("x").cast("double").alias("x"))
    if not center:
        return rows
    means = rows.groupBy("path", "ci").agg(F.avg("x").alias("__m"))
    return rows.join(F.broadcast(means), ["path", "ci"]).withColumn("x", F.col("x") - F.col("__m")).drop("__m")
