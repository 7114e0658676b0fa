"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written


def connected_components(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """``node, comp`` for each node of ``edges`` (``a, b``); ``comp`` is the least
    node reached.  Each round is two joins with one row per node on one side, which
    adaptive execution splits where a node has very many edges, and is written to
    ``path``; the rounds end when the edges stay the same."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}-0")
    mark = _mark(now)
    for i in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = written(small.where("a <> b").distinct(), f"{path}-{i}")
        drop_path(edges.sparkSession, f"{path}-{i - 1}")
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
