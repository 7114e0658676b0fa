"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its five-word shingles, the weight being how often
one occurs.  Each element's plane of weight by rank is cut into regions, doubling
along the weight and cells along the rank; hashes throw a Poisson number of darts
into each region.  A set keeps the darts under its weights and below a rank limit
that lets through about ``K ln K + 2K``, and per coordinate the one of least rank:
two sets agree in a coordinate with the probability of their weighted Jaccard
similarity.  Banded signatures give candidates, which are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, give_back, small_enough, table, work_dir, written
from .graph import connected_components
from .textvec import mix64, raw_bytes, shingles, text_slices, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 6 find a pair of similarity 0.8 with probability 0.9993.
BANDS, ROWS = 24, 6
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K
#: Rank cells below 1; from 1 on they are one wide.
_LOW = [(0.0, 1 / 16), (1 / 16, 1 / 8), (1 / 8, 1 / 4), (1 / 4, 1 / 2), (1 / 2, 1.0)]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Candidates that share fewer coordinates than this can't be similar: five
#: standard deviations below 0.8.
_LEAST_AGREEMENT = 0.8 - 5 * math.sqrt(0.8 * 0.2 / K)
#: Texts, and bytes of text, that one verification task takes together.
BLOCK_TEXTS, BLOCK_BYTES = 1500, 8 << 20
#: Cells that are searched for darts at once, some 100 bytes each.  A set has about
#: 1,000, however short, and six more for each of its elements.
CELLS = 1 << 17
#: Texts to verify whose keys (some 100 bytes each) are broadcast to the scan; with
#: more of them the texts are joined by shuffle.
BROADCAST_NODES = 500_000


def weighted_sets(h: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text in order, their counts, and the bounds."""
    of = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(h)]]))
    return h[at], count, np.searchsorted(of[at], np.arange(len(bound)))


def _poisson(width: np.ndarray, u: np.ndarray) -> np.ndarray:
    n, term, total = np.zeros(len(u), np.int64), np.exp(-width), np.exp(-width)
    for k in range(1, 10):
        n += u > total
        term = term * width / k
        total = total + term
    return n


def signatures(elements: np.ndarray, weights: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Signatures (sets x K) of weighted sets with integer weights; an empty set
    has the largest value everywhere."""
    n_sets = len(bound) - 1
    out = np.full(n_sets * K, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(n_sets), np.diff(bound))
    total = np.bincount(of, weights=weights, minlength=n_sets)
    limit = DARTS / np.maximum(total, 1e-9)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        wanted = np.zeros(n_sets, bool)
        wanted[todo] = True
        items = np.flatnonzero(wanted[of])
        region = 0
        while len(items):
            cells = np.cumsum(np.ceil(limit[of[items]] * (1 << region)) + len(_LOW)) // CELLS
            for part in np.split(items, np.flatnonzero(np.diff(cells)) + 1):
                _throw(out, elements[part], weights[part], of[part], limit[of[part]], region)
            region += 1
            items = items[weights[items] > (1 << region) - 1]
        missing = (out.reshape(n_sets, K) == np.iinfo(np.uint64).max).any(1)
        todo = np.flatnonzero(missing & (total > 0))
        limit[todo] *= 2
    return out.reshape(n_sets, K)


def _throw(out: np.ndarray, element: np.ndarray, weight: np.ndarray, of: np.ndarray, limit: np.ndarray, region: int) -> None:
    """Darts of one weight region, [2^r - 1, 2^(r+1) - 1), into ``out``."""
    scale = float(1 << region)
    most = limit * scale  # ranks are stretched so that a cell's area stays the same
    seed = mix64(element + np.uint64(int(_A) * (region + 1) & 0xFFFFFFFFFFFFFFFF))
    picks, cells = [], []
    for c, (low, _) in enumerate(_LOW):
        live = np.flatnonzero(most > low)
        picks.append(live)
        cells.append(np.full(len(live), c))
    units = np.maximum(0, np.ceil(most).astype(np.int64) - 1)
    picks.append(np.repeat(np.arange(len(element)), units))
    cells.append(np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units) + len(_LOW))
    pick, cell = np.concatenate(picks), np.concatenate(cells)
    h = mix64(seed[pick] + _B * (cell + 1).astype(np.uint64))
    u = (h >> np.uint64(11)).astype(np.float64) * 2.0**-53
    lows, widths = np.array([a for a, _ in _LOW]), np.array([b - a for a, b in _LOW])
    none = np.exp(-np.append(widths, 1.0))
    hit = np.flatnonzero(u > none[np.minimum(cell, len(_LOW))])
    pick, cell, h, u = pick[hit], cell[hit], h[hit], u[hit]
    is_low = cell < len(_LOW)
    low = np.where(is_low, lows[np.minimum(cell, len(_LOW) - 1)], cell - len(_LOW) + 1.0)
    width = np.where(is_low, widths[np.minimum(cell, len(_LOW) - 1)], 1.0)
    n = _poisson(width, u)
    pick, low, width = np.repeat(pick, n), np.repeat(low, n), np.repeat(width, n)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    dart = mix64(np.repeat(h, n) + _C * (nth + 1).astype(np.uint64))
    place = mix64(dart + _A)
    rank = (low + width * ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32)) / scale
    keep = rank < limit[pick]
    if region:
        across = (scale - 1) + scale * ((mix64(dart + _B) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        keep &= across < weight[pick]
    pick, dart, place, rank = pick[keep], dart[keep], place[keep], rank[keep]
    # Least rank first: 32 bits of rank, then 32 of the dart, an order all sets share.
    code = np.minimum(rank * 2.0**18, 2.0**32 - 1).astype(np.uint64) << np.uint64(32) | (dart & np.uint64(0xFFFFFFFF))
    slot = of[pick] * K + (place & np.uint64(0xFFFFFFFF)).astype(np.int64) % K
    np.minimum.at(out, slot, code)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each set and band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, (len(sig), BANDS))
    for r in range(ROWS):
        key = mix64(key + parts[:, :, r])
    return key.view(np.int64) if key.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            column = batch.column(0).slice(a, b - a)
            raw, offsets = raw_bytes(column)
            words = words_of(column)
            elements, weights, bound = weighted_sets(*shingles(words, SHINGLE))
            keys = band_keys(signatures(elements, weights, bound))
            full = []
            for i in range(b - a):
                f, g = int(words.first[i]), int(words.first[i + 1])
                data = words.hash[f:g].tobytes() if g > f else raw[offsets[i] : offsets[i + 1]].tobytes() + b"\0raw"
                full.append(xxhash.xxh3_128_digest(data))
            hashes = np.frombuffer(b"".join(full), np.int64).reshape(-1, 2)
            some = np.diff(bound) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(keys[some].ravel(), pa.int64()))
            others = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in others), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(np.diff(offsets), pa.int64()), bands],
                names=[*(batch.schema.names[i] for i in others), "k1", "k2", "n_bytes", "bands"],
            )
        give_back()


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of sorted distinct elements."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    same = a[at] == b if len(a) else np.zeros(len(b), bool)
    low = int(np.minimum(wa[at[same]], wb[same]).sum())
    high = int(wa.sum() + wb.sum()) - low
    return low / high if high else 0.0


def link(texts: list[str], least: float = SIMILARITY, known: np.ndarray | None = None) -> np.ndarray:
    """The class of each text, as the place of its first member: components of
    the pairs that share a band and are at least ``least`` similar.

    Pairs already in one class, to begin with those of equal ``known``, need no test.  The text that shares bands with
    most others, as an original does with its copies, goes first in each bucket.
    """
    n = len(texts)
    elements, weights, bound = weighted_sets(*shingles(words_of(pa.array(texts, pa.large_string())), SHINGLE))
    sig = signatures(elements, weights, bound)
    keys = band_keys(sig)
    keys[np.diff(bound) == 0] = np.arange(n)[np.diff(bound) == 0, None]
    root = np.arange(n) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]
    total = np.array([weights[bound[i] : bound[i + 1]].sum() for i in range(n)])
    orders = np.argsort(keys, axis=0, kind="stable")
    degree, buckets = np.zeros(n, np.int64), []
    for band in range(BANDS):
        order = orders[:, band]
        cut = np.flatnonzero(np.diff(keys[order, band])) + 1
        for members in np.split(order, cut):
            if len(members) > 1:
                degree[members] += len(members)
                buckets.append(members)
    tested: set[int] = set()
    for members in sorted(buckets, key=len, reverse=True):
        members = members[np.argsort(-degree[members], kind="stable")]
        for at, i in enumerate(members[:-1]):
            if (root[members] == root[i]).all():
                break
            rest = members[at + 1 :]
            rest = rest[(root[rest] != root[i]) & (np.minimum(total[rest], total[i]) >= least * np.maximum(total[rest], total[i]))]
            if len(rest):
                rest = rest[(sig[rest] == sig[i]).mean(1) >= _LEAST_AGREEMENT]
            for j in rest.tolist():
                code = min(i, j) * n + max(i, j)
                if root[j] == root[i] or code in tested:
                    continue
                tested.add(code)
                if similarity(elements[bound[i] : bound[i + 1]], weights[bound[i] : bound[i + 1]], elements[bound[j] : bound[j + 1]], weights[bound[j] : bound[j + 1]]) >= least:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
    return root


def _verify(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges from each text of a task to the first of its class."""
    frame = frame.sort_values("node", kind="stable")
    nodes = frame["node"].to_numpy()
    root = link(frame["text"].fillna("").tolist(), known=frame["cls"].to_numpy())
    return pd.DataFrame({"a": nodes, "b": nodes[root]})


def _star(frame: pd.DataFrame) -> pd.DataFrame:
    """Edges from the texts of a task to their lead, where they are similar."""
    frame = frame.sort_values("node", kind="stable")
    nodes, lead, texts = frame["node"].to_numpy(), int(frame["lead"].iloc[0]), frame["text"].fillna("").tolist()
    at = int(np.flatnonzero(nodes == lead)[0])
    sets = lambda part: weighted_sets(*shingles(words_of(pa.array(part, pa.large_string())), SHINGLE))
    own, heavy, _ = sets([texts[at]])
    near = np.zeros(len(nodes), bool)
    for first in range(0, len(texts), 128):
        elements, weights, bound = sets(texts[first : first + 128])
        for i in range(len(bound) - 1):
            mine = slice(bound[i], bound[i + 1])
            near[first + i] = first + i != at and similarity(own, heavy, elements[mine], weights[mine]) >= SIMILARITY
    give_back()
    return pd.DataFrame({"a": nodes[near], "b": np.full(int(near.sum()), lead)})


def _star_edges(placed: DataFrame) -> DataFrame:
    """Of ``node, key``, an edge from each node to the least of each of its keys."""
    leads = placed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("other")).where("lead <> other").select("key", "lead")
    return placed.join(leads, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def _in_blocks(df: DataFrame, by: str, sizes: DataFrame) -> DataFrame:
    """``blocks`` for each ``by`` of ``df`` (``node``): so many that each has about
    1,500 texts or 8 MB at most; ``sizes`` has ``node, n_bytes``."""
    return df.join(sizes, "node").groupBy(by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))


def _large_components(placed: DataFrame, sizes: DataFrame, texts, path: str) -> DataFrame:
    """Edges ``a, b`` that make the classes of components too large for one task.

    First each text is compared with one lead of each of its buckets, the member
    that shares most buckets, as an original does with its copies: a few tests a
    text.  Buckets whose texts are then in one class are done.  What is left of the
    components is compared pair by pair, in blocks; that is exact, and grows with
    the square of the texts whose buckets hold several classes.
    """
    spark = placed.sparkSession
    crowd = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = written(placed.join(crowd, "key"), f"{path}/placed")
    degree = placed.groupBy("node").agg(F.sum("n").alias("degree"))
    leads = placed.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", F.xxhash64("node"), "node"))["node"].alias("lead"))
    pairs = written(placed.join(leads, "key").where("node <> lead").select("node", "lead").distinct(), f"{path}/pairs")
    blocks = written(_in_blocks(pairs, "lead", sizes), f"{path}/stars")
    dealt = pairs.join(blocks, "lead").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("node", "lead", "block")
    own = blocks.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = dealt.unionByName(own)
    edges = written(texts(dealt).groupBy("lead", "block").applyInPandas(_star, "a bigint, b bigint"), f"{path}/near")

    cls = connected_components(edges, f"{path}/stars-joined").select("node", F.col("comp").alias("cls"))
    cls = written(placed.select("node").distinct().join(cls, "node", "left").select("node", F.coalesce("cls", "node").alias("cls")), f"{path}/classes")
    known = placed.join(cls, "node")
    mixed = known.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key")
    rest = written(known.join(mixed, "key", "left_semi").select("key", "node", "cls"), f"{path}/rest")
    if rest.isEmpty():
        return edges
    comps = written(connected_components(_star_edges(rest), f"{path}/rest-joined"), f"{path}/rest-comps")
    several = comps.join(_in_blocks(comps, "comp", sizes), "comp").join(cls, "node")
    several = several.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = written(several.select("node", "cls", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), f"{path}/rest-dealt")
    more = written(texts(dealt).groupBy("comp", "i", "j").applyInPandas(_verify, "a bigint, b bigint"), f"{path}/rest-near")
    drop_path(spark, f"{path}/rest-dealt")
    return edges.unionByName(more.where("a <> b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, the columns of ``keep``, ``class_id`` (the
    least id of its class) and ``kept`` (whether it is the row of its class that stays).

    Texts with the same words are copies and fold into one before any pairing, on
    the map side, so a group of copies of any size costs one row.  Rows are in one
    class when chains of pairs of similarity 0.8 or more join them.  A null text is
    empty; texts without a word are copies if their bytes are the same, and near to
    nothing.  A text under five words is one shingle; whole texts count, however
    long.  One row of each class stays: that of the least id, null last, and of rows
    that share it, or repeated ones, any one.  The class of null ids only is null.
    An empty table gives no rows; other columns may have any name.

    Candidates: per (band, key) bucket each text is joined to the bucket's least
    row only, so a bucket of any size gives as many edges as it has texts; the
    components of these edges hold every pair that shares a band.  A component is
    verified in one task up to 1500 texts and 8 MB; for a larger one see
    ``_large_components``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = work_dir(spark, "near")
    names = [f"__keep{i}" for i in range(len(keep))]
    body = F.col(text).cast("string")
    rows = docs.select(body.alias("text"), F.col(doc_id).alias("id"), F.xxhash64(body).alias("x"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    schema = rows.drop("text").select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("k1", "k2", "n_bytes")), F.array(F.lit(0).cast("bigint")).alias("bands")).schema
    signed = written(rows.mapInArrow(_sign, schema).withColumn("row", F.monotonically_increasing_id()), f"{path}/signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "x")).alias("first")
    reps = signed.groupBy("k1", "k2").agg(first, F.first("bands").alias("bands"), F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    reps = written(reps.withColumn("node", F.col("first.row")), f"{path}/reps")
    placed = reps.select("node", F.explode("bands").alias("key"))
    sizes = reps.select("node", "n_bytes")
    comps = written(connected_components(_star_edges(placed), f"{path}/coarse"), f"{path}/comps")
    comps = written(comps.join(_in_blocks(comps, "comp", sizes), "comp"), f"{path}/sized")

    need = written(comps.join(reps, "node").select("node", "n", F.col("first.id").alias("id0"), F.col("first.x").alias("x0")), f"{path}/need")
    sought = F.broadcast(need) if small_enough(need, BROADCAST_NODES) else need

    def texts(dealt: DataFrame) -> DataFrame:
        """``dealt`` (``node`` and more) with the texts of its nodes."""
        found = rows.join(sought, rows["id"].eqNullSafe(sought["id0"]) & (rows["x"] == sought["x0"])).select("node", "n", "text")
        found = found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["node"])).drop("n")
        return dealt.join(found, "node")

    small = comps.where("blocks = 1").select("node", "comp", F.col("node").alias("cls"))
    classes = written(texts(small).groupBy("comp").applyInPandas(_verify, "a bigint, b bigint"), f"{path}/found").select(F.col("a").alias("node"), F.col("b").alias("cls"))
    large = comps.where("blocks > 1").select("node")
    if not large.isEmpty():
        edges = _large_components(placed.join(large, "node", "left_semi"), sizes, texts, f"{path}/large")
        classes = classes.unionByName(connected_components(edges, f"{path}/fine").select("node", F.col("comp").alias("cls")))
    named = written(reps.select("k1", "k2", "node", "first").join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node")), f"{path}/named")
    leads = named.groupBy("cls").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("m"))
    shared = named.join(leads.where("m > 1").drop("m"), "cls", "left").select("k1", "k2", F.coalesce("lead", "first").alias("lead"))
    out = signed.select("id", "row", "k1", "k2", *names).join(shared, ["k1", "k2"])
    return out.select(F.col("id").alias(doc_id), *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("lead.id").alias("class_id"), (F.col("row") == F.col("lead.row")).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
