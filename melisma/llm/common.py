"""Shared plumbing: the folder for written tables, row restriction, exact ranks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A set of row ids up to this many rows is broadcast (8 bytes a row, some 64 MB
#: as a hashed relation); a larger one goes through a shuffled join.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session a temporary folder is set;
    on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="melisma-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the rows outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that one Arrow batch holds, an eighth of the default.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small.  The setting is read when a plan runs, so
    it stays on the session; a smaller one that is already there is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that a task has freed to the system.  Workers are used again, so
    what one task's texts took would stay beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_enough(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``bound`` rows, counted no further than that."""
    return df.limit(bound + 1).count() <= bound


def only_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``left_semi``) or is not (``left_anti``) in ``keys``.

    The key set is broadcast when its counted size is within ``bound``, so long
    texts in ``df`` aren't shuffled; beyond it the join is a shuffled one.
    """
    return df.join(F.broadcast(keys) if small_enough(keys, bound) else keys, on, how)


#: Equal rows that one task counts out.
REPEATS = 100_000


def numbered_repeats(df: DataFrame, nth: str = "__nth") -> DataFrame:
    """The rows of ``df``, equal ones numbered from 0 in column ``nth``: a row key
    that is the same on every run.  Equal rows are counted on the map side and
    dealt out again in pieces, so a group of any size is nobody's single task."""
    counted = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("__n"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    few = counted.where(F.col("__n") <= REPEATS).withColumn(nth, upto(F.col("__n")))
    piece = counted.where(F.col("__n") > REPEATS).withColumn("__piece", upto(F.ceil(F.col("__n") / REPEATS).cast("bigint")))
    piece = piece.repartition(shuffle_partitions(df.sparkSession), "__piece", *(F.col(f"`{c}`") for c in df.columns))
    many = piece.withColumn(nth, upto(F.least(F.lit(REPEATS), F.col("__n") - F.col("__piece") * REPEATS).cast("bigint")))
    many = many.withColumn(nth, F.col(nth) + F.col("__piece") * REPEATS)
    return few.drop("__n").unionByName(many.drop("__n", "__piece"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def beside_text(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """The kept columns and a text, under names of their own that can't clash."""
    return df.select(*(df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)), text.cast("string").alias("text"))


def train_row(doc_id: str = "doc_id") -> Column:
    """True for rows that a model may learn from: crc32 of the id's decimal text
    modulo 4 is not 2.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 != 2, F.lit(False))


def training_sample(docs: DataFrame, classes: DataFrame, per_class: int, text_chars: int, seed: int = 11) -> list[tuple]:
    """``(label, text)`` of at most ``per_class`` documents of each class, the same
    on every run: ids whose hash falls below the class's share, then trimmed by
    hash.  ``docs`` has ``doc_id, text``, ``classes`` ``doc_id, y``; null labels
    are left out.

    Every class is sampled.  The picked ids are about ``1.3 * per_class + 50`` a
    class at most, so they are broadcast to the texts.  Of rows that share an id one
    text stays, and the trimming is done before the driver gets the rows: at most
    ``per_class`` texts a class of at most ``text_chars`` characters, from a place
    that the hash gives.
    """
    classes = classes.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "y")
    sizes = classes.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.3 * per_class + 50) / F.col("n")).alias("share")
    h = F.xxhash64(F.lit(seed), "doc_id")
    grain = float(1 << 52)
    picked = classes.join(F.broadcast(sizes.select("y", share)), "y").where(F.pmod(h, F.lit(1 << 52)) < F.col("share") * grain).select("doc_id", "y").distinct()
    text = text_or_empty()
    start = F.when(F.length(text) > text_chars, F.pmod(F.xxhash64(h), F.length(text) - text_chars + 1)).otherwise(0)
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    got = got.select("y", h.alias("h"), F.substr(text, start.cast("int") + 1, F.lit(text_chars)).alias("t"))
    got = got.groupBy("y", "h").agg(F.min("t").alias("t"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    got = got.withColumn("place", place).where(F.col("place") <= per_class).select("y", "h", "t").toPandas()
    got = got.sort_values(["y", "h"], kind="stable")
    return list(zip(got["y"].tolist(), got["t"].tolist(), strict=True))
