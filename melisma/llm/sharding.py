"""Sharding by balanced label propagation.

Documents linked through a hub (here: equal texts) start with a label from a hash.
Round by round a hub asks for the commonest label of its documents among the shards
with room for all of them, larger hubs first, until none is left that fits.  Other
documents cut no edge wherever they lie, so they fill what is left of each quota,
to the row.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered_repeats, table, text_or_empty, work_dir, written

_MOVE_BINS = 128


def propagate(nodes: DataFrame, hub: list[str], quota: list[int], path: str) -> DataFrame:
    """Give linked ``nodes`` (with ``hub`` columns and ``__label``) the label most
    of their hub has among the shards with room for the hub; ties fall by hash, so
    that no shard is favoured.  Hubs that fit no shard get the label ``len(quota)``.

    Only hubs that have their shard take room: documents of the others lie nowhere
    yet.  Asked rows are summed by shard, size class (power of two) and one of 128
    hash bins of their hubs; a shard takes whole bins while they fit, else a bin's
    first hub, and smaller classes wait until no larger hub was refused.  So a hub
    moves as one, each round settles one at least, and the driver sees at most
    shards x classes x 128 sums.  Ends when no hub is left that fits.
    """
    k, spark, room = len(quota), nodes.sparkSession, list(quota)
    tally = nodes.groupBy(*hub, "__label").agg(F.count(F.lit(1)).alias("__n"))
    counts = F.map_from_entries(F.collect_list(F.struct("__label", "__n")))
    waiting = tally.groupBy(*hub).agg(F.sum("__n").alias("__m"), counts.alias("__tally"))
    waiting = written(waiting.withColumn("__class", F.floor(F.log2("__m")).cast("int")), f"{path}-hubs")
    cell, settled, turn = ["__want", "__class", "__bin"], [], 0
    while True:
        fits = [F.when(F.col("__m") <= room[j], F.struct(F.coalesce(F.col("__tally")[j], F.lit(0)).alias("n"), F.xxhash64(F.lit(j), F.lit(turn), *hub).alias("tie"), F.lit(j).alias("label"))) for j in range(k)]
        own = F.xxhash64(F.lit(turn), *hub)
        asked = waiting.withColumn("__want", F.array_max(F.array(*fits))["label"]).where("__want IS NOT NULL").withColumn("__own", own).withColumn("__bin", F.pmod("__own", F.lit(_MOVE_BINS)).cast("int"))
        asked = written(asked, f"{path}-{turn}-asked")
        sums = asked.groupBy(*cell).agg(F.sum("__m").alias("n"), F.max(F.struct("__own", "__m")).alias("lead")).collect()
        if not sums:
            break
        taken, refused = [], None
        for r in sorted(sums, key=lambda r: (-r["__class"], r["__want"], r["__bin"])):
            want, size = r["__want"], r["__class"]
            if refused is not None and size < refused:
                break
            if r["n"] <= room[want]:
                room[want] -= r["n"]
                taken.append((want, size, r["__bin"], None))
                continue
            refused = size
            if r["lead"]["__m"] <= room[want]:
                room[want] -= r["lead"]["__m"]
                taken.append((want, size, r["__bin"], r["lead"]["__own"]))
        admitted = spark.createDataFrame(taken, "__want int, __class int, __bin int, __lead bigint").withColumn("__in", F.lit(True))
        ok = F.coalesce(F.col("__in") & (F.col("__lead").isNull() | (F.col("__lead") == F.col("__own"))), F.lit(False))
        done = written(asked.join(F.broadcast(admitted), cell, "left").withColumn("__ok", ok), f"{path}-{turn}")
        settled.append(done.where("__ok").select(*hub, "__want"))
        waiting = done.where("NOT __ok").select(*hub, "__m", "__tally", "__class")
        turn += 1
    places = spark.createDataFrame([], asked.select(*hub, "__want").schema)
    for some in settled:
        places = places.unionByName(some)
    return nodes.join(places, hub, "left").withColumn("__label", F.coalesce("__want", F.lit(k))).drop("__want")


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)).cast("bigint") for v in values)), (at + 1).cast("int"))


def shard_rows(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of ``keep`` (default: the id) with ``size, text_crc32, law, shard,
    slot, grown_shard`` for each row; law ``rows``: shard counts differ by one at most.

    Linked documents are those of equal text.  A group of more than a quarter of a
    shard is split by hash into pieces of at most about that, since no shard could
    hold a group of a third of all rows.  Null text is empty text.  Null or
    repeated ids and repeated rows each take a place of their own; rows that are
    equal in all that is read may stand for each other.  Fewer rows than shards
    leave shards empty; an empty table gives no rows.  Whole texts are hashed, however
    long; columns that aren't in ``keep`` may have any name.

    Slots are exact ranks: counts per (label, hash bucket) give each bucket its
    first rank, and rows are numbered inside buckets only, so no task sees more
    than a bucket.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "shards")
    keep = keep or [doc_id]
    body = text_or_empty(text)
    rows = docs.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)),
        F.col(doc_id).alias("__id"), (F.octet_length(body) + 8).cast("bigint").alias("__size"), F.crc32(body).alias("__crc"),
        F.xxhash64(body).alias("__text_hash"),
    )
    # The number among equal rows keeps many repeats of one row from being one piece.
    rows = written(numbered_repeats(rows).withColumn("__h", F.xxhash64("__id", "__text_hash", "__nth")).drop("__nth"), f"{path}/rows")
    n = rows.count()
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    hub = ["__text_hash", "__crc", "__size"]
    groups = rows.groupBy(*hub).agg(F.count(F.lit(1)).alias("__copies")).where("__copies > 1")
    piece = F.pmod("__h", F.ceil(F.col("__copies") / max(1, quota[-1] // 4)).cast("bigint"))
    start = F.pmod(F.xxhash64(F.lit("start"), "__h"), F.lit(shards)).cast("int")
    linked = rows.join(groups, hub).withColumn("__piece", piece).withColumn("__label", start).drop("__copies")
    linked = propagate(written(linked, f"{path}/linked"), [*hub, "__piece"], quota, f"{path}/round")
    single = rows.join(groups, hub, "left_anti").withColumn("__label", F.lit(shards))
    all_rows = linked.drop("__piece").unionByName(single)

    bins = max(1, min(1 << 16, n // 4000))
    all_rows = all_rows.withColumn("__bin", F.pmod(F.xxhash64("__h", F.lit("bin")), F.lit(bins)).cast("int"))
    counts = written(all_rows.groupBy("__label", "__bin").agg(F.count(F.lit(1)).alias("__n")), f"{path}/counts")
    per_label = {r["__label"]: r["n"] for r in counts.groupBy("__label").agg(F.sum("__n").alias("n")).collect()}
    before = F.sum("__n").over(Window.partitionBy("__label").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("__label", "__bin", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__label", "__bin").orderBy("__h", "__id", "__text_hash", "__crc", "__size"))
    ranked = all_rows.withColumn("__in", inside).join(F.broadcast(first) if (shards + 1) * bins <= 500_000 else first, ["__label", "__bin"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__in") - 1)

    have = [per_label.get(j, 0) for j in range(shards)]
    held = [min(a, q) for a, q in zip(have, quota, strict=True)]
    spare = [a - h for a, h in zip(have, held, strict=True)]
    spare_before = [0, *accumulate(spare)]
    gap_end = list(accumulate(q - h for q, h in zip(quota, held, strict=True)))
    free = F.when(F.col("__label") == shards, F.col("__rank") + spare_before[shards]).when(F.col("__rank") >= _pick([*held, 0], F.col("__label")), F.col("__rank") - _pick([*held, 0], F.col("__label")) + _pick(spare_before, F.col("__label")))
    ranked = ranked.withColumn("__free", free)
    into = F.size(F.filter(F.array(*(F.lit(int(g)).cast("bigint") for g in gap_end)), lambda g: g <= F.col("__free")))
    shard = F.when(F.col("__free").isNull(), F.col("__label")).otherwise(into).cast("int")
    ranked = ranked.withColumn("__shard", shard)
    gap_start = [0, *gap_end[:-1]]
    slot = F.when(F.col("__free").isNull(), F.col("__rank")).otherwise(_pick(held, F.col("__shard")) + F.col("__free") - _pick(gap_start, F.col("__shard")))
    return ranked.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"), slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_edges(placed: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of linked documents in all and those that lie in two shards, from
    counts per (group, shard)."""
    each = placed.groupBy(*group, "shard").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy(*group).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("together"))
    return per.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("edges"), F.sum(F.col("m") * (F.col("m") - 1) / 2 - F.col("together")).alias("cut"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
