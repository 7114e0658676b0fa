"""Exact dedup as a stateful stream over disk-backed keyed state.

The stream keeps, per digest and without expiry, the number of rows seen, the
largest stable id and the locator (file, row) of that row's content in a RocksDB
state store checkpointed to the shared folder.  A digest seen more than once is a
hit: its rows' full bytes are compared with the content that the locator names, and
rows that differ under one digest are grouped by their bytes instead.  The located
row is the one that stays.

With a ``state`` folder of the caller's own, the state and the digests found so far
stay there, and a later call reads only the files that are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, only_keys, small_enough, text_or_empty, work_dir, written

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: A state partition is a store of its own with some megabytes of fixed files, and
#: stays for the life of the stream: one for so many bytes of input, eight at least.
STATE_PARTITION_BYTES = 32 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does exactly that on ASCII strings and is
    quick there; other strings go through ``translate``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, lower))


def _pattern(path: str) -> str:
    """The path as a pattern for itself alone: a stream takes one file so, as well as
    a folder of files."""
    at = max(i for i, c in enumerate(path) if c.isalnum())
    return f"{path[:at]}[{path[at]}]{path[at + 1 :]}"


def digest_state(spark: SparkSession, path: str, doc_id: str, text: str, bits: int, max_bytes_per_trigger: int, tag: str) -> DataFrame:
    """Run the stream over the files at ``path`` until all that is there is read.

    Returns one row per digest: ``__digest, __keep, __n, __file, __row``.  Each
    micro-batch writes the digests that it changed under ``tag``; a digest's last
    row is the one with the highest count, for counts only grow.  Where ``tag`` has
    the state of an earlier run, the stream goes on from there.

    The state's settings are read when the stream starts, so they are set on a
    session of the stream's own.
    """
    mine = spark.newSession()
    table = spark.read.parquet(path)
    n_bytes = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    for k, v in (_STATE_CONF | {"spark.sql.streaming.internal.stateStore.partitions": str(max(8, -(-n_bytes // STATE_PARTITION_BYTES)))}).items():
        mine.conf.set(k, v)
    files = mine.readStream.schema(table.schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(_pattern(path))
    seen = files.select(
        _digest(text_or_empty(text), bits).alias("__digest"),
        F.struct(F.col(doc_id).alias("__id"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")).alias("__at"),
    )
    state = seen.groupBy("__digest").agg(F.max("__at").alias("__at"), F.count(F.lit(1)).alias("__n"))
    columns = ["__digest", F.col("__at.__id").alias("__keep"), "__n", F.col("__at.__file").alias("__file"), F.col("__at.__row").alias("__row")]

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.select(*columns).write.mode("overwrite").parquet(f"{tag}/updates/batch={epoch}")

    mine.createDataFrame([], state.select(*columns).schema).write.mode("append").parquet(f"{tag}/updates/batch=-1")
    state.writeStream.outputMode("update").option("checkpointLocation", f"{tag}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    updates = spark.read.schema(state.select(*columns).schema).parquet(f"{tag}/updates")
    last = F.max(F.struct("__n", "__keep", "__file", "__row")).alias("__last")
    return written(updates.groupBy("__digest").agg(last).select("__digest", "__last.__keep", "__last.__n", "__last.__file", "__last.__row"), work_dir(spark, "digests"))


def _digest(text: Column, bits: int) -> Column:
    full = F.unhex(F.sha2(ascii_lower(text), 256))
    return full if bits == 256 else F.substring(full, 1, bits // 8)


def exact_dedup(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", digest_bits: int = 256, max_bytes_per_trigger: int = 256 << 30, state: str | None = None) -> DataFrame:
    """One row per row of the parquet table at ``path``: id, ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.

    Texts are equal when identical after lower-casing A-Z, whole texts however long;
    the row with the largest id of a group stays, of repeated rows with that id one.
    Null text counts as empty.  A null id never wins over another (a group of null
    ids only has a null ``keep_id`` and one of its rows stays).  An empty table gives
    no rows; columns besides the two named are not read and may have any name.

    The path is one file or folder; one with characters of a pattern is refused.
    ``state`` is a shared folder in which the stream's state stays for the next call
    with the same arguments; without it the state is deleted at the end.

    Only 32-byte digests, ids and locators are shuffled.  A group that holds a
    third of all rows is summed on the map side; the rows find their group by a
    join whose other side has one row per digest, which adaptive execution splits.
    """
    path = path.rstrip("/")
    if set(path) & set("[]{}*?\\"):
        raise ValueError(f"a path with characters of a pattern: {path}")
    tag = work_dir(spark, "exact-dedup")
    groups = digest_state(spark, path, doc_id, text, digest_bits, max_bytes_per_trigger, state or tag)
    here = [F.col("_metadata.file_path").alias("__own_file"), F.col("_metadata.row_index").alias("__own_row")]
    docs = spark.read.parquet(path).select(F.col(doc_id).alias("__id"), text_or_empty(text).alias("__text"), *here)
    hashed = docs.withColumn("__norm", ascii_lower(F.col("__text"))).withColumn("__digest", _digest(F.col("__text"), digest_bits))
    located = (F.col("__own_row") == F.col("__row")) & (F.xxhash64("__own_file") == F.col("__place"))
    hits = groups.where("__n > 1").select("__digest", "__row", F.xxhash64("__file").alias("__place"))
    hits = F.broadcast(hits) if small_enough(hits) else hits
    differ = written(
        hashed.select("__digest", "__norm", "__own_file", "__own_row").join(hits, "__digest")
        .groupBy("__digest").agg(F.max(F.when(located, F.col("__norm"))).alias("__kept"), F.min("__norm").alias("__a"), F.max("__norm").alias("__b"))
        .where("__kept <> __a OR __kept <> __b").select("__digest"),
        f"{tag}/differ",
    )
    if not state:
        drop_path(spark, f"{tag}/state")
    sha = F.sha2(F.col("__norm"), 256).alias("text_sha256")
    parts = ["__id", "__own_file", "__own_row"]
    group = ["__keep", "__n", "__file", "__row"]
    if differ.isEmpty():
        rows = hashed.select(*parts, "__digest", (F.lower(F.hex("__digest")).alias("text_sha256") if digest_bits == 256 else sha))
        found = rows.join(groups, "__digest")
    else:
        bad = only_keys(hashed, differ, ["__digest"])
        last = F.max(F.struct("__id", F.col("__own_file").alias("__file"), F.col("__own_row").alias("__row"))).alias("__last")
        by_bytes = bad.groupBy("__digest", "__norm").agg(last, F.count(F.lit(1)).alias("__n")).select("__digest", "__norm", F.col("__last.__id").alias("__keep"), "__n", "__last.__file", "__last.__row")
        good = only_keys(hashed, differ, ["__digest"], "left_anti").join(groups, "__digest")
        found = good.select(*parts, *group, sha).unionByName(bad.join(by_bytes, ["__digest", "__norm"]).select(*parts, *group, sha))
    return found.select(
        F.col("__id").alias(doc_id), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
        ((F.col("__own_row") == F.col("__row")) & (F.col("__own_file") == F.col("__file"))).alias("kept"), "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
