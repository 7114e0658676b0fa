"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes if a 100-byte string that covers it also starts earlier.  Every
100-byte window has an anchor, the 32-byte string of least hash in it, which
depends on the window's bytes alone: equal windows have equal anchors at equal
offsets.  So only the suffixes at anchors that occur more than once are sorted.

Tasks sort the suffixes at their anchors (with the bytes before the anchor as the
end of the key), keep the earliest of equal ones, and exchange the sorted runs
front-coded: the length of the prefix shared with the suffix before, and the
rest.  A loser tree that carries common-prefix lengths combines a bucket's runs,
comparing bytes only from the known prefix on, and leaves the prefix lengths of
neighbours in the merged order: windows are equal where these reach far enough
and the bytes before the anchor are the same.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, only_keys, shuffle_partitions, small_enough, table, text_or_empty, work_dir, written
from .textvec import mix64, raw_bytes, text_slices

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # anchors to choose from in a window; offsets 0 to 68
LEFT = LENGTH - GRAM
KEY = LENGTH + LEFT + 2  # right bytes, left bytes from the anchor back, both sizes
#: A chunk of a very long text, and suffixes that one run sorts at a time.
CHUNK, RUN_ROWS = 1 << 22, 150_000
#: Suffixes that one bucket gets on average (170 bytes each while they are merged).
BUCKET_ROWS = 150_000
#: Removed spans that may be broadcast in all; beyond it they are joined by shuffle.
BROADCAST_SPANS = 4_000_000
_MASK = (1 << 64) - 1
#: The place of a row that only tells of an anchor.
WITNESS = -(1 << 62)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling."""
    h = mix64(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n, a = 1, 0x9E3779B97F4A7C15
    while n < GRAM:
        h = h[:-n] * np.uint64(a) + h[n:]
        a = a * a & _MASK
        n *= 2
    return mix64(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all windows inside texts: text, first and last window start,
    anchor place, hash.  A window's anchor is its gram of least hash, the leftmost
    of equal ones."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    g = gram_hashes(data)
    # 40 bits of hash and 24 of place: a minimum also says where it is.
    m, n = (g & np.uint64(_MASK << 24 & _MASK)) | np.arange(len(g), dtype=np.uint64), 1
    while n * 2 <= SPAN:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if SPAN > n:
        m = np.minimum(m[: len(m) - (SPAN - n)], m[SPAN - n :])
    place = (m & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.arange(len(place))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[text + 1]
    start, place, text = start[inside], place[inside], text[inside]
    if not len(start):
        return start, start, start, start, np.zeros(0, np.uint64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0)) + 1
    low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    return text[low], start[low], start[high], place[low], g[place[low]]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, shift of places, bytes and offsets of parts to anchor; a very
    long text comes in chunks that overlap by a window."""
    for a, b in text_slices(column):
        data, offsets = raw_bytes(column.slice(a, b - a))
        if len(data) <= 2 * CHUNK or b - a > 1:
            yield a, 0, data, offsets
            continue
        for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
            part = data[at : at + CHUNK + LENGTH - 1]
            yield a, at, part, np.array([0, len(part)])


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, ord, at`` of every anchor.  Anchors that a batch holds more than once are
    known to be repeated: they go out as negative places under hashes of their own,
    so that a very common one is dealt over all tasks, and one witness of it tells
    the other batches."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        hashes, owners, places = [], [], []
        for row, shift, data, offsets in _pieces(batch.column(1)):
            text, low, high, place, h = anchors(data, offsets)
            at = place - offsets[text] + shift
            hashes.append(h)
            owners.append(ids[row + text])
            places.append(at << 14 | (place - low) << 7 | (place - high))
        if not hashes:
            continue
        h, owner, at = np.concatenate(hashes), np.concatenate(owners).astype(np.int64), np.concatenate(places)
        keys, index, count = np.unique(h, return_inverse=True, return_counts=True)
        sure = count[index] > 1
        spread = mix64(owner[sure].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[sure].view(np.uint64))
        seen = keys[count > 1]
        h = np.concatenate([h[~sure], spread, seen]).view(np.int64)
        owner = np.concatenate([owner[~sure], owner[sure], np.zeros(len(seen), np.int64)])
        at = np.concatenate([at[~sure], -1 - at[sure], np.full(len(seen), WITNESS)])
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(owner), pa.array(at)], names=["h", "ord", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``h``, those whose ``h`` occurs more than once and those
    known to be repeated; holds one batch and one row."""
    last: tuple | None = None  # the last row, if it isn't out yet
    last_h = None
    for batch in batches:
        h, ids, at = (batch.column(i).to_numpy() for i in range(3))
        if not len(h):
            continue
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[0] = last_h is not None and last_h == h[0]
        more = same.copy()
        more[:-1] |= same[1:]
        out = (more & (at >= 0)) | ((at < 0) & (at != WITNESS))
        keep_ids, keep_at = ids[out], np.where(at[out] < 0, -1 - at[out], at[out])
        if same[0] and last:
            keep_ids, keep_at = np.append(keep_ids, last[0]), np.append(keep_at, last[1])
        last_h, last = h[-1], None if out[-1] or at[-1] == WITNESS else (ids[-1], at[-1])
        if len(keep_ids):
            yield pa.RecordBatch.from_arrays([pa.array(keep_ids), pa.array(keep_at)], names=["ord", "at"])


def sorted_keys(keys: np.ndarray) -> np.ndarray:
    """Order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel(), kind="stable")


def shared_prefix(keys: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return out


def front_code(keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> bytes:
    """A sorted run as one compressed value: sizes of shared prefixes, ids and
    places, and the bytes after the prefixes."""
    shared = shared_prefix(keys)
    tails = keys[np.arange(keys.shape[1]) >= shared[:, None]]
    body = shared.astype(np.uint8).tobytes() + ids.astype("<i8").tobytes() + at.astype("<i8").tobytes() + tails.tobytes()
    return struct.pack("<II", len(keys), len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def front_decode(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<II", blob)
    body = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    shared = list(body[:n])
    ids, at = np.frombuffer(body, "<i8", n, n), np.frombuffer(body, "<i8", n, 9 * n)
    rows, place, row = [], 17 * n, b""
    for s in shared:
        end = place + KEY - s
        row = row[:s] + body[place:end]
        rows.append(row)
        place = end
    return rows, shared, ids, at


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of sorted runs of ``(rows, shared prefixes)``.

    Gives the order as ``(run, row)`` and, for each, the bytes it shares with the
    row before it.  Every contender carries the prefix that it shares with the
    last winner: the longer wins without looking at bytes, and only of equal ones
    the bytes after the prefix are compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    row: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    loser = [0] * k

    def first(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix is then that shared with the winner."""
        if row[a] is None:
            return b, a
        if row[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = row[a][known[a] :], row[b][known[a] :]
        if x == y:
            known[b] = KEY
            return a, b
        size = len(x)
        shared = known[a] + size - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        if x < y:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = first(play(2 * node), play(2 * node + 1))
        return winner

    order, shared_out = [], []
    winner = play(1)
    while row[winner] is not None:
        order.append((winner, at[winner]))
        shared_out.append(known[winner])
        rows, shared = runs[winner]
        at[winner] += 1
        if at[winner] < len(rows):
            row[winner], known[winner] = rows[at[winner]], shared[at[winner]]
        else:
            row[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, loser[node] = first(winner, loser[node])
            node >>= 1
    return order, shared_out


def later_windows(keys: np.ndarray, shared: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of merged suffixes, the windows that also start earlier: id, first and last
    start of each row of consecutive ones.

    ``at`` is packed as by the anchors.  For a window at offset ``o`` before the
    anchor, suffixes between which the shared prefix never falls below 100 - o
    agree to its right, and classes refined byte by byte agree to its left.
    """
    place, back, ahead = at >> 14, at >> 7 & 127, at & 127  # windows start from place - back to place - ahead
    gram = np.cumsum(shared < GRAM)
    crowd = np.bincount(gram)[gram] > 1
    # The earliest first, so that a class's first row is the one that stays.
    order = np.lexsort((place, ids))
    order = order[crowd[order]]
    level = np.unique(gram[order], return_inverse=True)[1].astype(np.int64)
    left = keys[order][:, LENGTH : LENGTH + LEFT]
    back, ahead, place, ids = back[order], ahead[order], place[order], ids[order]
    gone = np.zeros((len(order), LEFT + 3), bool)
    for o in range(LEFT + 1):
        if o:
            level = np.unique(level << 8 | left[:, o - 1], return_inverse=True)[1]
        some = np.flatnonzero((ahead <= o) & (o <= back))
        if len(some):
            right = np.cumsum(shared < LENGTH - o)[order[some]].astype(np.int64)
            later = np.ones(len(some), bool)
            later[np.unique(right * (int(level.max()) + 1) + level[some], return_index=True)[1]] = False
            gone[some, o + 1] = later
    step = np.diff(gone.astype(np.int8), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return ids[row], place[row] - (high - 1), place[row] - low


def _spans(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Spans by id: ids, and a list of start and end places for each."""
    order = np.lexsort((low, ids))
    ids, low, high = ids[order], low[order], high[order] + LENGTH
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    flat = np.stack([low, high], 1).ravel()
    bounds = np.concatenate([first, [len(ids)]]) * 2
    return pa.array(ids[first]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def _make_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, ids, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            early = np.lexsort((at >> 14, ids))
            keys, ids, at = keys[early], ids[early], at[early]
            order = sorted_keys(keys)  # stable: the earliest of equal suffixes first
            keys, ids, at = keys[order], ids[order], at[order]
            again = shared_prefix(keys) == KEY
            place = at[again] >> 14
            who, spans = _spans(ids[again], place - (at[again] >> 7 & 127), place - (at[again] & 127))
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(who), dtype=np.int32) % buckets), who, spans, pa.nulls(len(who), pa.binary())], names=["bucket", "ord", "spans", "run"])
            keys, ids, at = keys[~again], ids[~again], at[~again]
            h = np.zeros(len(keys), np.uint64)
            for word in np.ascontiguousarray(keys[:, :GRAM]).view("<u8").T:
                h = mix64(h + word)
            to = (h % np.uint64(buckets)).astype(np.int32)
            for b in np.unique(to):
                mine = to == b
                blob = front_code(keys[mine], ids[mine], at[mine])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["bucket", "ord", "spans", "run"])

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in text_slices(batch.column(1), 1 << 21):
                data, offsets = raw_bytes(batch.column(1).slice(a, b - a))
                lists = batch.column(2).slice(a, b - a)
                at = lists.flatten().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                for c in range(0, len(at), 50_000):
                    here, of = at[c : c + 50_000], text[c : c + 50_000]
                    back, ahead = here >> 7 & 127, here & 127
                    place = (here >> 14) + offsets[of] + LEFT
                    keys = np.empty((len(here), KEY), np.uint8)
                    right = np.arange(LENGTH)
                    keys[:, :LENGTH] = np.where(right < (LENGTH - ahead)[:, None], padded[place[:, None] + right], 0)
                    left = np.arange(LEFT)
                    keys[:, LENGTH : LENGTH + LEFT] = np.where(left < back[:, None], padded[place[:, None] - 1 - left], 0)
                    keys[:, -2], keys[:, -1] = back, ahead
                    held.append((keys, ids[a + of], here))
                    size += len(here)
                    if size >= RUN_ROWS:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each bucket; spans already known pass through."""
    runs: dict[int, list[bytes]] = {}
    for batch in batches:
        known = batch.filter(batch.column(3).is_null())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2)], names=["ord", "spans"])
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if blob is not None:
                runs.setdefault(b, []).append(blob)
    while runs:
        _, blobs = runs.popitem()
        parts = [front_decode(x) for x in blobs]
        order, shared = merge_runs([(rows, s) for rows, s, _, _ in parts])
        if len(order) < 2:
            continue
        starts = np.cumsum([0] + [len(p[0]) for p in parts])
        take = np.array([starts[r] + i for r, i in order])
        keys = np.frombuffer(b"".join(x for p in parts for x in p[0]), np.uint8).reshape(-1, KEY)[take]
        ids, at = np.concatenate([p[2] for p in parts])[take], np.concatenate([p[3] for p in parts])[take]
        del parts
        who, spans = _spans(*later_windows(keys, np.array(shared), ids, at))
        if len(who):
            yield pa.RecordBatch.from_arrays([who, spans], names=["ord", "spans"])


def union_spans(flat: np.ndarray) -> np.ndarray:
    """Maximal runs of ``[start, end, start, end, ...]`` spans, in order."""
    both = flat.reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    reach = np.maximum.accumulate(both[:, 1])
    first = np.concatenate([[True], both[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(both) - 1)
    return np.stack([both[first, 0], reach[last]], 1).ravel()


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [union_spans(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["ord", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = raw_bytes(batch.column(1))
        removed, count, digest = [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            sha, at, spans = hashlib.sha256(), 0, spans or []
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                sha.update(text[at:a])
                at = b
            sha.update(text[at:])
            removed.append(sum(spans[1::2]) - sum(spans[::2]))
            count.append(len(spans) // 2)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_spans(docs: DataFrame, path: str) -> DataFrame:
    """``ord, spans`` of the documents (``ord`` unique and in order, ``text``) that
    lose bytes; no two texts may be equal."""
    spark = docs.sparkSession
    long_enough = docs.where(F.octet_length("text") >= LENGTH)
    found = long_enough.mapInArrow(_emit_anchors, "h bigint, ord bigint, at bigint")
    again = found.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_repeated, "ord bigint, at bigint")
    per_doc = written(again.groupBy("ord").agg(F.collect_list("at").alias("at")), f"{path}/anchors")
    suffixes = per_doc.agg(F.sum(F.size("at"))).first()[0] or 0
    sorted_in = docs.join(per_doc, "ord").select("ord", "text", "at")
    buckets = max(2 * shuffle_partitions(spark), -(-suffixes // BUCKET_ROWS))
    runs = sorted_in.mapInArrow(_make_runs(buckets), "bucket int, ord bigint, spans array<bigint>, run binary")
    merged = runs.repartition(buckets, "bucket").mapInArrow(_combine, "ord bigint, spans array<bigint>")
    return written(merged.groupBy("ord").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_unite, "ord bigint, spans array<bigint>"), f"{path}/spans")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs``.

    Documents come in order of id, null last; rows that share an id in order of
    their texts' digests, and rows equal in id and text are one document.  Null
    text is empty; texts under 100 bytes lose nothing.  An empty table gives no
    rows; other columns are not read.

    Texts equal to an earlier document's are known to go whole and take no part,
    so a group of copies of any size costs its digests.  Repeated anchors are found
    in a spillable sort; a task holds one run of suffixes, or one bucket's runs in
    which each task has at most one row per different suffix.  There are as many
    buckets as the suffixes need, but one 32-byte string is one bucket.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = work_dir(spark, "suffix")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    facts = written(rows.select("id", F.xxhash64("text").alias("x"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("bigint").alias("n")), f"{path}/facts")
    n, ids = facts.agg(F.count(F.lit(1)), F.countDistinct("id")).first()
    if n == ids:
        facts = facts.withColumn("ord", F.col("id"))
        rows = rows.withColumn("ord", F.col("id"))
    else:
        facts = written(_numbered(facts, f"{path}/numbered"), f"{path}/ordered")
        known = facts.select("id", "x", "ord").distinct()
        known = F.broadcast(known) if small_enough(known) else known
        keyed = rows.withColumn("x", F.xxhash64("text"))
        rows = keyed.join(known, keyed["id"].eqNullSafe(known["id"]) & (keyed["x"] == known["x"])).select(keyed["id"], keyed["text"], known["ord"])
    first = facts.groupBy("digest").agg(F.min("ord").alias("first"))
    copies = written(facts.join(first, "digest").where("ord <> first").select("ord", "n").distinct(), f"{path}/copies")
    alone = only_keys(rows, copies.select("ord"), ["ord"], "left_anti")
    if n != ids:
        alone = alone.dropDuplicates(["ord"])
    spans = removed_spans(alone.select("ord", "text"), path)
    whole = copies.where(F.col("n") >= LENGTH).select("ord", F.array(F.lit(0).cast("bigint"), "n").alias("spans"))
    spans = written(spans.unionByName(whole), f"{path}/all")
    total = spans.agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    if total[0] <= BROADCAST_SPANS // 4 and (total[1] or 0) <= 2 * BROADCAST_SPANS:
        spans = F.broadcast(spans)
    return rows.join(spans, "ord", "left").select("id", "text", "spans").mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", doc_id)


def _numbered(facts: DataFrame, path: str) -> DataFrame:
    """``ord``, the exact rank of (id, digest), null ids last: rows are dealt by
    range, numbered in each part, and parts offset by the sizes before them."""
    order = [F.col("id").asc_nulls_last(), F.col("digest")]
    parts = shuffle_partitions(facts.sparkSession)
    dealt = written(facts.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), path)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.rank().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", rank).join(F.broadcast(before.select("part", "base")), "part").select("id", "x", "digest", "n", (F.col("base") + F.col("rank") - 1).cast("bigint").alias("ord"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
