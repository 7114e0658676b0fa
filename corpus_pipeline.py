"""From documents to shards: five stages, each on all that the one before kept.

Each stage decides by row: rows that share an id, or have none, are told apart by
the file and the place they are read from.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melisma.llm import decontaminate, language_id, minhash, mixing, sharding
from melisma.llm.common import only_keys, small_enough, table, work_dir, written

#: Below this a document's language is a guess between languages; even odds of
#: four languages give 0.25.
LEAST_LANGUAGE_SCORE = 0.3
#: A row's key: a hash of its file's path, and its place in the file.
ROW = ("__row_file", "__row_place")


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``ROW``; where it isn't a plain read of files, it is
    written first."""
    key = (F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
    try:
        return docs.select("*", *key)
    except AnalysisException:
        return written(docs, work_dir(spark, "docs")).select("*", *key)


def _without(spark: SparkSession, docs: DataFrame, gone: DataFrame, tag: str) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``gone``."""
    gone = written(gone.select(*ROW).distinct(), work_dir(spark, tag))
    return only_keys(docs, gone, list(ROW), "left_anti").drop(*ROW)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null and empty texts among them, and those
    whose language stays undecided.  The network learns from the documents of the
    stage itself.  Rows pass one by one: repeated rows, ids that several rows share
    and null ids fare as their texts do, ties can't occur, texts are judged whole,
    and an empty table stays empty."""
    model = language_id.learn(docs)
    named = language_id.identify(docs.withColumn("__body", F.col("text")), model)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumnRenamed("__body", "text").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: that of the least id, null last;
    of repeated rows, and of near copies under one id, one.  Rows that share an id
    and no text are strangers.  Null and empty texts are copies of each other.  An
    empty table stays empty."""
    keyed = _keyed(spark, docs)
    classes = minhash.near_duplicates(keyed, keep=ROW)
    return _without(spark, keyed, classes.where("NOT kept"), "near-gone")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark passage, and no others that share their
    id; repeated rows go together.  Null and empty texts hold none.  An empty table,
    or an empty benchmark, leaves all as it is."""
    keyed = _keyed(spark, docs)
    return _without(spark, keyed, decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), keep=ROW), "leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the mix does: not at all, once or twice; repeated
    rows and null ids are units of their own, a null source is a source.  A text
    without a word, null or empty, is taken once.  An empty table stays empty."""
    keyed = _keyed(spark, docs)
    mixed = mixing.mix(keyed, [3, 1, 2], keep=ROW)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    plan = written(mixed.select(*ROW, copies.alias("__copies")).where("__copies <> 1"), work_dir(spark, "copies"))
    plan = F.broadcast(plan) if small_enough(plan) else plan
    found = keyed.join(plan, list(ROW), "left")
    return found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.coalesce("__copies", F.lit(1))))).select(docs.columns)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row that is left its shard and slot.  Null text is empty text;
    repeated rows and null ids take a place each, equal rows may stand for each
    other, and an empty table gives no rows."""
    return sharding.shard_rows(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Models, signatures and balanced sampling are not SQL; tests compare the stages
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
