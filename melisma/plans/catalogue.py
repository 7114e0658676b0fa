"""Queries over the driver's tables, each with the SQL of the same result.

A signal is a user's events in order of time: ``fi`` the user, ``i`` the sample,
``t`` seconds, ``y`` the value; segments ``s`` are blocks of 16 samples, chunks
are runs of events without a gap of over twelve hours.  Both sides of a query are
given the same columns: doubles to six decimals, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as fn
from ..operators import classify, fill, fit, interval, spectral, stats, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Added before rounding, for means of decimals often lie on a rounding tie.
_OFF_TIE = 1.23e-9

_SIG = """sig AS (SELECT user_id AS fi, event_id, event_type AS label, epoch(ts) AS t, value AS y,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events),
seg AS (SELECT *, i // 16 AS s FROM sig)"""
_CHUNK = _SIG + """, gaps AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY fi ORDER BY i) > 43200 THEN 1 ELSE 0 END AS g FROM sig),
runs AS (SELECT *, CAST(sum(g) OVER (PARTITION BY fi ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM gaps),
chunk AS (SELECT fi, c, min(t) AS on_, max(t) AS off_, count(*) AS n FROM runs GROUP BY fi, c)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("fi").orderBy("ts", "event_id")).cast("bigint") - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("fi"), "event_id", F.col("event_type").alias("label"), "ts", F.col("value").alias("y"))
    rows = rows.withColumn("i", i).withColumn("t", _seconds("ts"))
    return rows.select("fi", "event_id", "label", "t", "y", "i").withColumn("s", F.floor(F.col("i") / 16))


def _seconds(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.unix_date(F.to_date(ts)) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def chunks(sig: DataFrame) -> DataFrame:
    w = Window.partitionBy("fi").orderBy("i")
    runs = interval.islands(sig, ["fi"], ["i"], F.col("t") - F.lag("t").over(w) > 43200, "c")
    return runs


def chunk_spans(sig: DataFrame) -> DataFrame:
    return chunks(sig).groupBy("fi", "c").agg(F.min("t").alias("on_"), F.max("t").alias("off_"), F.count(F.lit(1)).alias("n"))


def query(columns: str, sql: str):
    """Register a query; ``columns`` lists ``name:kind`` with i, d or s for kinds."""
    spec = [c.split(":") for c in columns.split()]

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kinds = {"i": lambda c: F.col(c).cast("bigint"), "d": lambda c: F.round(F.nanvl(F.col(c).cast("double"), F.lit(None)) + _OFF_TIE, 6) + 0.0, "s": lambda c: F.col(c).cast("string")}
            return f(spark, sf_dir).select(*(kinds[k](c).alias(c) for c, k in spec))

        text = {"i": 'CAST("{0}" AS BIGINT) AS "{0}"', "d": 'round(CAST("{0}" AS DOUBLE) + 1.23e-9, 6) + 0.0 AS "{0}"', "s": 'CAST("{0}" AS VARCHAR) AS "{0}"'}
        QUERIES[f.__name__] = run
        SQL[f.__name__] = f"WITH q__ AS ({sql}) SELECT {', '.join(text[k].format(c) for c, k in spec)} FROM q__"
        return f

    return register


# --- tiers -------------------------------------------------------------------
@query("fi:i event_id:i t:d label:s", f"WITH {_SIG} SELECT fi, event_id, round(t, 2) AS t, label FROM sig WHERE NOT (length(label) = 0 OR regexp_matches(label, '^(view|login)$'))")
def tier_filter_pause(spark, d):
    return signal(spark, d).where(~fn.is_pause("label", "^(view|login)$")).withColumn("t", F.round("t", 2))


@query("s_suppkey:i grp_kind:s grp_no:s", "SELECT s_suppkey, split_part(s_name, '#', 1) AS grp_kind, CASE WHEN s_name LIKE '%#%' THEN split_part(s_name, '#', 2) END AS grp_no FROM supplier")
def group_from_name(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", fn.name_part("s_name", "#", 0).alias("grp_kind"), fn.name_part("s_name", "#", 1).alias("grp_no"))


@query("fi:i event_id:i idx:i smp:i sec:d", f"WITH {_SIG} SELECT fi, event_id, round_even((t % 1000) * 10 - 1, 0) AS idx, round_even((t % 1000) * 10, 0) AS smp, (i + 1) / 10.0::DOUBLE AS sec FROM sig")
def time_to_index(spark, d):
    t = F.col("t") % 1000
    return signal(spark, d).select("fi", "event_id", fn.sec2idx(t, 10.0).alias("idx"), fn.sec2sample(t, 10.0).alias("smp"), fn.idx2sec("i", 10.0).alias("sec"))


@query("fi:i t:i event_id:i y:d", f"WITH {_SIG} SELECT fi, CAST(floor(t / 86400) AS BIGINT) AS t, arg_min(event_id, i) AS event_id, arg_min(y, i) AS y FROM sig GROUP BY 1, 2")
def time_dedup(spark, d):
    return fill.dedup_times(signal(spark, d).drop("s").withColumnRenamed("t", "sec"), ["fi"], F.floor(F.col("sec") / 86400), ["i"])


@query("fi:i day:i y:d", f"""WITH {_SIG}, byday AS (SELECT fi, CAST(floor(t / 86400) AS BIGINT) AS day, sum(y) AS y FROM sig GROUP BY 1, 2),
grid AS (SELECT fi, unnest(generate_series(min(day), max(day))) AS day FROM byday GROUP BY fi)
SELECT g.fi, g.day, coalesce(b.y, 0) AS y FROM grid g LEFT JOIN byday b USING (fi, day)""")
def grid_fill(spark, d):
    days = signal(spark, d).groupBy("fi", F.floor(F.col("t") / 86400).alias("day")).agg(F.sum("y").alias("y"))
    return fill.grid_fill(days, ["fi"], "day", "y")


_FILLED = _SIG + """, k AS (SELECT *, y <= 20 AS miss FROM sig),
ab AS (SELECT *, last_value(CASE WHEN NOT miss THEN i END IGNORE NULLS) OVER a AS i0, last_value(CASE WHEN NOT miss THEN y END IGNORE NULLS) OVER a AS y0,
  first_value(CASE WHEN NOT miss THEN i END IGNORE NULLS) OVER b AS i1, first_value(CASE WHEN NOT miss THEN y END IGNORE NULLS) OVER b AS y1 FROM k
  WINDOW a AS (PARTITION BY fi ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY fi ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT fi, i, CASE WHEN NOT miss THEN y WHEN i0 IS NULL THEN y1 WHEN i1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (i - i0) / (i1 - i0) END AS filled FROM ab)"""


@query("fi:i i:i filled:d", f"WITH {_FILLED} SELECT * FROM filled")
def linear_fill(spark, d):
    return fill.linear_fill(signal(spark, d), ["fi"], "i", "y", F.col("y") <= 20)


def _outlier_sql(lo: str, hi: str) -> str:
    return f"""WITH {_SIG}, lim AS (SELECT fi, {lo} AS lo, {hi} AS hi FROM sig WHERE y <> 0 GROUP BY fi)
SELECT fi, i, CASE WHEN y <> 0 AND (y < lo OR y > hi) THEN 0 ELSE y END AS y FROM sig JOIN lim USING (fi)"""


def _outliers(spark, d, how, factor):
    return fill.mark_outliers(signal(spark, d), ["fi"], "y", how, factor).withColumn("y", F.when(F.col("is_outlier"), 0.0).otherwise(F.col("y")))


_IQR = "(quantile_cont(y, 0.75) - quantile_cont(y, 0.25))"


@query("fi:i i:i y:d", _outlier_sql("avg(y) - 1.5 * stddev_pop(y)", "avg(y) + 1.5 * stddev_pop(y)"))
def outlier_mean(spark, d):
    return _outliers(spark, d, "mean", 1.5)


@query("fi:i i:i y:d", _outlier_sql(f"median(y) - {_IQR}", f"median(y) + {_IQR}"))
def outlier_median(spark, d):
    return _outliers(spark, d, "median", 1.0)


@query("fi:i i:i y:d", _outlier_sql(f"quantile_cont(y, 0.25) - 0.5 * {_IQR}", f"quantile_cont(y, 0.75) + 0.5 * {_IQR}"))
def outlier_fence(spark, d):
    return _outliers(spark, d, "fence", 0.5)


def _savgol_sql() -> str:
    def at(k: int) -> str:
        return "y" if k == 0 else (f"lead(y, {k}) OVER w" if k > 0 else f"lag(y, {-k}) OVER w")

    def dot(c: list[int], first: int, total: int) -> str:
        return "(" + " + ".join(f"({v}) * {at(first + j)}" for j, v in enumerate(c)) + f") / {total}.0::DOUBLE"

    cases = "".join(f" WHEN i = {r} THEN {dot(c, -r, 42)} WHEN i = n - 1 - {r} THEN {dot(c[::-1], r - 6, 42)}" for r, c in enumerate(windows.SAVGOL_EDGE))
    return f"WITH {_SIG}, c AS (SELECT *, count(*) OVER (PARTITION BY fi) AS n FROM sig) SELECT fi, i, CASE WHEN n <= 7 THEN y{cases} ELSE {dot(windows.SAVGOL_CENTER, -3, 21)} END AS smooth FROM c WINDOW w AS (PARTITION BY fi ORDER BY i)"


@query("fi:i i:i smooth:d", _savgol_sql())
def savgol7(spark, d):
    return windows.savgol7(signal(spark, d), ["fi"], "i", "y")


_BASE = _SIG + ", p AS (SELECT fi, round(quantile_cont(y, 0.05), 8) AS p FROM sig GROUP BY fi), base AS (SELECT fi, median(round(y, 8)) AS base FROM sig JOIN p USING (fi) WHERE round(y, 8) <= p.p GROUP BY fi)"


@query("fi:i base:d", f"WITH {_BASE} SELECT fi, base FROM base")
def base_value(spark, d):
    return fill.base_value(signal(spark, d), ["fi"], "y")


@query("fi:i i:i st:d", f"WITH {_BASE} SELECT fi, i, CASE WHEN y > 0 THEN 12 * log2(y / greatest(base, 1)) ELSE y - greatest(base, 1) END AS st FROM sig JOIN base USING (fi)")
def semitone(spark, d):
    sig = signal(spark, d)
    base = fill.base_value(sig, ["fi"], "y", least=1.0)
    return sig.join(base, "fi").withColumn("st", fn.semitone("y", "base"))


@query("label:s fi:i i:i st:d", f"""WITH {_SIG}, p AS (SELECT label, round(quantile_cont(y, 0.05), 8) AS p FROM sig GROUP BY label),
base AS (SELECT label, greatest(median(round(y, 8)), 1) AS base FROM sig JOIN p USING (label) WHERE round(y, 8) <= p.p GROUP BY label)
SELECT label, fi, i, CASE WHEN y > 0 THEN 12 * log2(y / base) ELSE y - base END AS st FROM sig JOIN base USING (label)""")
def group_semitone(spark, d):
    sig = signal(spark, d)
    return sig.join(F.broadcast(fill.base_value(sig, ["label"], "y", least=1.0)), "label").withColumn("st", fn.semitone("y", "base"))


# --- intervals ---------------------------------------------------------------
@query("fi:i c:i on_:d off_:d n:i", f"WITH {_CHUNK} SELECT * FROM chunk")
def islands_chunks(spark, d):
    return chunk_spans(signal(spark, d))


@query("fi:i on:d off:d", f"""WITH {_CHUNK}, nx AS (SELECT fi, off_ AS "on", coalesce(lead(on_) OVER (PARTITION BY fi ORDER BY on_), 1e10) AS "off" FROM chunk)
SELECT * FROM nx UNION ALL SELECT fi, 0.0, min(on_) FROM chunk GROUP BY fi""")
def chunk_complement(spark, d):
    spans = chunk_spans(signal(spark, d))
    return interval.complement(spans, ["fi"], "on_", "off_", F.lit(0.0), F.lit(1e10))


_LINK = _CHUNK + ", pts AS (SELECT fi, event_id, t FROM sig WHERE label = 'purchase'), lnk AS (SELECT p.fi, p.event_id, coalesce(min(c.c), -1) AS parent FROM pts p LEFT JOIN chunk c ON p.fi = c.fi AND p.t BETWEEN c.on_ AND c.off_ GROUP BY 1, 2)"


@query("fi:i event_id:i parent:i", f"WITH {_LINK} SELECT * FROM lnk")
def link_parent(spark, d):
    sig = signal(spark, d)
    return interval.link_parent(sig.where("label = 'purchase'"), chunk_spans(sig), ["fi"], "event_id", "t", "on_", "off_", "c", 86400.0)


@query("fi:i i:i is_init:s is_fin:s", f"""WITH {_CHUNK} SELECT fi, i, CASE WHEN lag(c) OVER w IS NULL OR lag(c) OVER w <> c THEN 'yes' ELSE 'no' END AS is_init,
CASE WHEN lead(c) OVER w IS NULL OR lead(c) OVER w <> c THEN 'yes' ELSE 'no' END AS is_fin FROM runs WINDOW w AS (PARTITION BY fi ORDER BY i)""")
def init_final(spark, d):
    return interval.initial_final(chunks(signal(spark, d)), ["fi"], "i", "c")


@query("fi:i i:i on:d off:d", f"""WITH {_CHUNK} SELECT r.fi, r.i, greatest(coalesce(lag(r.t) OVER (PARTITION BY r.fi ORDER BY r.t), c.on_), c.on_) AS "on", r.t AS "off" FROM runs r JOIN chunk c USING (fi, c)""")
def point_to_segment(spark, d):
    runs = chunks(signal(spark, d))
    spans = runs.groupBy("fi", "c").agg(F.min("t").alias("chunk_on"))
    return interval.point_to_segment(runs.join(spans, ["fi", "c"]), ["fi"], "t", "chunk_on")


@query("fi:i i:i on:d off:d center:d", f"""WITH {_SIG}, m AS (SELECT fi, i, t % 1000 AS t FROM sig) SELECT fi, i, round(greatest(t - 0.15, 0), 2) AS "on", round(t + 0.15, 2) AS "off", round(t, 2) AS center FROM m""")
def point_window(spark, d):
    return signal(spark, d).select("fi", "i", *interval.point_window(F.col("t") % 1000, 0.3))


@query("fi:i i:i nrm_on:d nrm_off:d", f"WITH {_CHUNK} SELECT r.fi, r.i, greatest(least(r.t - 3600, r.t - 60), c.on_) AS nrm_on, least(greatest(r.t + 3600, r.t + 60), c.off_) AS nrm_off FROM runs r JOIN chunk c USING (fi, c)")
def norm_window(spark, d):
    sig = signal(spark, d)
    t = F.col("t")
    return chunks(sig).join(chunk_spans(sig).drop("n"), ["fi", "c"]).select("fi", "i", *interval.norm_window(t, t - 60, t + 60, F.col("on_"), F.col("off_"), 7200.0))


def _merge_sql(f: str, having: str = "") -> str:
    return f"WITH {_CHUNK} SELECT fi, c, {f}(t, t) AS t, {f}(label, t) AS label, count(*) AS n FROM runs GROUP BY fi, c {having}"


@query("fi:i c:i t:d label:s n:i", _merge_sql("arg_min"))
def merge_left(spark, d):
    return interval.merge_points(chunks(signal(spark, d)), ["fi", "c"], "t", "label", "left")


@query("fi:i c:i t:d label:s n:i", _merge_sql("arg_max"))
def merge_right(spark, d):
    return interval.merge_points(chunks(signal(spark, d)), ["fi", "c"], "t", "label", "right")


@query("fi:i c:i t:d label:s n:i", _merge_sql("arg_min", "HAVING count(*) = 1"))
def merge_skip(spark, d):
    return interval.merge_points(chunks(signal(spark, d)), ["fi", "c"], "t", "label", "skip")


@query("fi:i c:i rate:d", f"WITH {_CHUNK} SELECT c.fi, c.c, CASE WHEN c.off_ > c.on_ THEN 3600 * count(p.t) / (c.off_ - c.on_) END AS rate FROM chunk c LEFT JOIN sig p ON p.fi = c.fi AND p.label = 'purchase' AND p.t BETWEEN c.on_ AND c.off_ GROUP BY c.fi, c.c, c.on_, c.off_")
def rate_events(spark, d):
    sig = signal(spark, d)
    spans = chunk_spans(sig)
    hits = interval.range_join(sig.where("label = 'purchase'").select("fi", "t"), spans, ["fi"], "t", "on_", "off_", 86400.0, "inner")
    n = hits.groupBy("fi", "c").agg(F.count(F.lit(1)).alias("k"))
    return spans.join(n, ["fi", "c"], "left").withColumn("rate", fn.safe_div(3600 * F.coalesce("k", F.lit(0)), F.col("off_") - F.col("on_")))


@query("fi:i day:i share:d", f"""WITH {_CHUNK}, days AS (SELECT fi, on_, off_, unnest(generate_series(CAST(floor(on_ / 86400) AS BIGINT), CAST(floor(off_ / 86400) AS BIGINT))) AS day FROM chunk)
SELECT fi, day, sum(greatest(0, least(off_, (day + 1) * 86400) - greatest(on_, day * 86400))) / 86400 AS share FROM days GROUP BY 1, 2""")
def rate_overlap(spark, d):
    days = chunk_spans(signal(spark, d)).withColumn("day", F.explode(F.sequence(F.floor(F.col("on_") / 86400), F.floor(F.col("off_") / 86400))))
    part = interval.overlap(F.col("on_"), F.col("off_"), F.col("day") * 86400.0, (F.col("day") + 1) * 86400.0)
    return days.groupBy("fi", "day").agg((F.sum(part) / 86400).alias("share"))


@query("fi:i event_id:i previous:d", f"WITH {_SIG} SELECT a.fi, a.event_id, (SELECT arg_max(b.y, b.t) FROM sig b WHERE b.fi = a.fi AND b.label = 'click' AND b.t < a.t) AS previous FROM sig a WHERE a.label = 'purchase'")
def asof_previous(spark, d):
    sig = signal(spark, d)
    return interval.asof_previous(sig.where("label = 'purchase'").select("fi", "event_id", "t"), sig.where("label = 'click'").select("fi", "t", "y"), ["fi"], "t", "y")


@query("c_custkey:i", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_tier(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("c_custkey:i", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_tier(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# --- statistics --------------------------------------------------------------
_FEAT = "avg(y) AS m, stddev_pop(y) AS sd, median(y) AS med, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr, max(y) AS max, min(y) AS min, (min(i) FILTER (y = mx) - min(i) + 1) / count(*) AS maxpos, count(*) / 100.0::DOUBLE AS dur"
_FEAT_COLS = "m:d sd:d med:d iqr:d max:d min:d maxpos:d dur:d"


@query(f"fi:i s:i {_FEAT_COLS}", f"WITH {_SIG}, z AS (SELECT *, max(y) OVER (PARTITION BY fi, s) AS mx FROM seg) SELECT fi, s, {_FEAT} FROM z GROUP BY fi, s")
def std_feat(spark, d):
    return signal(spark, d).groupBy("fi", "s").agg(*stats.std_feat("y", "i", 100.0))


@query("fi:i s:i m_nrm:d sd_nrm:d med_nrm:d max_nrm:d", f"""WITH {_SIG}, a AS (SELECT fi, s, avg(y) AS m, stddev_pop(y) AS sd, median(y) AS med, max(y) AS max FROM seg GROUP BY fi, s),
f AS (SELECT fi, avg(y) AS m, stddev_pop(y) AS sd, median(y) AS med, max(y) AS max FROM sig GROUP BY fi)
SELECT a.fi, s, a.m / (CASE WHEN f.m = 0 THEN 1 ELSE f.m END) AS m_nrm, a.sd / (CASE WHEN f.sd = 0 THEN 1 ELSE f.sd END) AS sd_nrm,
a.med / (CASE WHEN f.med = 0 THEN 1 ELSE f.med END) AS med_nrm, a.max / (CASE WHEN f.max = 0 THEN 1 ELSE f.max END) AS max_nrm FROM a JOIN f USING (fi)""")
def std_feat_nrm(spark, d):
    sig = signal(spark, d)
    names = ["m", "sd", "med", "max"]
    feats = stats.std_feat("y", "i", 100.0)
    whole = sig.groupBy("fi").agg(*feats).select("fi", *(F.col(c).alias(f"ref_{c}") for c in names))
    return stats.normalized(sig.groupBy("fi", "s").agg(*feats).join(whole, "fi"), names)


@query("fi:i qi:d qf:d qb:d qm:d", f"""WITH {_SIG}, z AS (SELECT *, count(*) OVER (PARTITION BY fi) AS n FROM sig), g AS (SELECT *, least(n, 10) AS wl FROM z),
a AS (SELECT fi, avg(y) FILTER (i < wl) AS mi, coalesce(avg(y) FILTER (i >= wl), avg(y) FILTER (i = n - 1)) AS mni, avg(y) FILTER (i >= n - wl) AS mf, coalesce(avg(y) FILTER (i < n - wl), avg(y) FILTER (i = 0)) AS mnf FROM g GROUP BY fi),
b AS (SELECT fi, CASE WHEN mni > 0 THEN mi / mni END AS qi, CASE WHEN mnf > 0 THEN mf / mnf END AS qf, CASE WHEN mf > 0 THEN mi / mf END AS qb FROM a)
SELECT *, greatest(qi, qf) AS qm FROM b""")
def quotients(spark, d):
    return stats.quotients(signal(spark, d), ["fi"], "i", "y", 10)


@query("fi:i jit_abs:d jit_m:d jit_sd:d jit:d n:i", f"""WITH {_SIG}, a AS (SELECT fi, i, lead(t) OVER w - t AS d FROM sig WINDOW w AS (PARTITION BY fi ORDER BY t)), b AS (SELECT *, lead(d) OVER (PARTITION BY fi ORDER BY i) AS e FROM a),
c AS (SELECT * FROM b WHERE d BETWEEN 60 AND 200000 AND e BETWEEN 60 AND 200000 AND greatest(d, e) <= 1.5 * least(d, e))
SELECT fi, avg(abs(d - e)) AS jit_abs, avg(d) AS jit_m, stddev_pop(d) AS jit_sd, avg(abs(d - e)) / avg(d) AS jit, count(*) AS n FROM c GROUP BY fi""")
def jitter(spark, d):
    return stats.jitter(signal(spark, d), ["fi"], "t", 60.0, 200000.0, 1.5)


@query("fi:i shim:d shim_m:d shim_sd:d", f"WITH {_SIG}, a AS (SELECT fi, abs(y) AS a, abs(abs(y) - abs(lag(y) OVER (PARTITION BY fi ORDER BY t))) AS d FROM sig) SELECT fi, CASE WHEN avg(a) <> 0 THEN avg(d) / avg(a) END AS shim, avg(a) AS shim_m, stddev_pop(a) AS shim_sd FROM a GROUP BY fi")
def shimmer(spark, d):
    return stats.shimmer(signal(spark, d), ["fi"], "t", "y")


@query("fi:i entropy:d", "WITH n AS (SELECT user_id AS fi, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY fi) AS p FROM n) SELECT fi, sum(-p * log2(p)) AS entropy FROM p GROUP BY fi")
def entropy_class(spark, d):
    return stats.entropy(signal(spark, d), ["fi"], "label")


@query("mi:d h_y_x:d h_x_y:d", """WITH n AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM n)
SELECT sum(n / t * log2(n * t / (nx * ny))) AS mi, sum(-n / t * log2(n / nx)) AS h_y_x, sum(-n / t * log2(n / ny)) AS h_x_y FROM m""")
def mutual_info(spark, d):
    return stats.information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("label:s feat:s m:d med:d sd:d iqr:d", f"""WITH {_SIG}, u AS (SELECT label, 'y' AS feat, y AS v FROM sig UNION ALL SELECT label, 'hour', floor(t / 3600) % 24 FROM sig)
SELECT label, feat, avg(v) AS m, median(v) AS med, stddev_pop(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM u GROUP BY 1, 2""")
def summary_long(spark, d):
    rows = signal(spark, d).withColumn("hour", (F.floor(F.col("t") / 3600) % 24).cast("double")).select("label", "y", "hour")
    return stats.summary_long(rows, ["label"], ["y", "hour"])


def _wide(label: str) -> str:
    f = f"FILTER (label = '{label}')"
    return f"avg(y) {f} AS {label}_y_m, median(y) {f} AS {label}_y_med, stddev_pop(y) {f} AS {label}_y_sd, quantile_cont(y, 0.75) {f} - quantile_cont(y, 0.25) {f} AS {label}_y_iqr"


@query("fi:i " + " ".join(f"{t}_y_{s}:d" for t in ("click", "purchase") for s in ("m", "med", "sd", "iqr")), f"WITH {_SIG} SELECT fi, {_wide('click')}, {_wide('purchase')} FROM sig GROUP BY fi")
def summary_wide(spark, d):
    return stats.summary_wide(signal(spark, d), "fi", "label", ["click", "purchase"], ["y"])


@query("l_returnflag:s l_linestatus:s n:i qty:d", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("r_name:s n_name:s n:i bal:d", "SELECT r_name, n_name, count(*) AS n, avg(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_levels(spark, d):
    places = F.broadcast(table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    return table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("bal"))


@query("fi:i f0_m:d en_m:d", f"WITH {_SIG} SELECT a.fi, a.m AS f0_m, b.m AS en_m FROM (SELECT fi, avg(y) AS m FROM sig WHERE label = 'click' GROUP BY fi) a JOIN (SELECT fi, avg(y) AS m FROM sig WHERE label = 'purchase' GROUP BY fi) b USING (fi)")
def merge_prefix(spark, d):
    sig = signal(spark, d)
    part = lambda label, name: sig.where(F.col("label") == label).groupBy("fi").agg(F.avg("y").alias(name))
    return part("click", "f0_m").join(part("purchase", "en_m"), "fi")


@query("fi:i i:i lo_hi:d z:d unit:d", f"""WITH {_SIG}, w AS (SELECT fi, i, y, min(y) OVER p AS lo, max(y) OVER p AS hi, avg(y) OVER p AS m, stddev_pop(y) OVER p AS sd FROM sig WINDOW p AS (PARTITION BY fi))
SELECT fi, i, CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE y END AS lo_hi, CASE WHEN sd <> 0 THEN (y - m) / sd END AS z, CASE WHEN sd <> 0 THEN y / sd END AS unit FROM w""")
def normalize_vector(spark, d):
    rows = signal(spark, d)
    for how, name in (("minmax", "lo_hi"), ("zscore", "z"), ("std", "unit")):
        rows = stats.normalize(rows, ["fi"], "y", how, name)
    return rows


@query("l_partkey:i r:d mae:d rmsd:d", """SELECT l_partkey, CASE WHEN count(*) <= 1 THEN 0 WHEN min(l_quantity) = max(l_quantity) AND min(l_extendedprice) = max(l_extendedprice) THEN 1
WHEN min(l_quantity) = max(l_quantity) OR min(l_extendedprice) = max(l_extendedprice) THEN 0 ELSE corr(l_quantity, l_extendedprice) END AS r,
avg(abs(l_quantity - l_extendedprice)) AS mae, sqrt(avg(pow(l_quantity - l_extendedprice, 2))) AS rmsd FROM lineitem GROUP BY l_partkey""")
def corr_two(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(fn.guarded_corr("l_quantity", "l_extendedprice").alias("r"), fn.mae("l_quantity", "l_extendedprice").alias("mae"), fn.rmsd("l_quantity", "l_extendedprice").alias("rmsd"))


# --- windows and fits --------------------------------------------------------
@query("fi:i i:i rms:d pre:d peak:i", f"""WITH {_SIG} SELECT fi, i, sqrt(avg(y * y) OVER (PARTITION BY fi ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS rms,
CASE WHEN lag(y) OVER w IS NULL THEN y ELSE y - 0.95 * lag(y) OVER w END AS pre, coalesce(y > lag(y) OVER w AND y > lead(y) OVER w, false)::BIGINT AS peak FROM sig WINDOW w AS (PARTITION BY fi ORDER BY i)""")
def moving_rms(spark, d):
    return signal(spark, d).select("fi", "i", windows.moving_rms("y", ["fi"], "i", 4, 4).alias("rms"), windows.pre_emphasis("y", ["fi"], "i").alias("pre"), windows.local_maxima("y", ["fi"], "i").cast("int").alias("peak"))


@query("fi:i frame:i energy:d", f"""WITH {_SIG}, f AS (SELECT fi, i, y, unnest(generate_series(greatest(0, CAST(ceil((i - 7) / 4.0) AS BIGINT)), i // 4)) AS frame FROM sig)
SELECT fi, frame, sqrt(avg(pow(y * (0.54 - 0.46 * cos(2 * pi() * (i - frame * 4) / 8)), 2))) AS energy FROM f GROUP BY 1, 2""")
def frame_energy(spark, d):
    return windows.frame_energy(signal(spark, d), ["fi"], "i", "y", 4, 8)


_MED = _SIG + """, n AS (SELECT *, count(*) OVER (PARTITION BY fi) AS n FROM sig), b AS (SELECT *, greatest(0, i - 5) AS a0, least(i + 5, n) AS a1 FROM n),
e AS (SELECT *, 9 - (a1 - a0) AS dd FROM b), wnd AS (SELECT fi, i, y, CASE WHEN dd > 0 AND a0 > 0 THEN greatest(0, a0 - dd) ELSE a0 END AS a, CASE WHEN dd > 0 AND a0 <= 0 AND a1 < n THEN least(n, a1 + dd) ELSE a1 END AS z FROM e),
l AS (SELECT w.fi, w.i, list(round(v.y, 8) ORDER BY v.y) AS v FROM wnd w JOIN sig v ON v.fi = w.fi AND v.i >= w.a AND v.i < w.z GROUP BY 1, 2),
p AS (SELECT fi, i, v, round(list_aggregate(v, 'quantile_cont', 0.1), 8) AS lo, round(list_aggregate(v, 'quantile_cont', 0.9), 8) AS hi FROM l),
med AS (SELECT fi, i, CASE WHEN len(v) <= 2 THEN list_aggregate(v, 'median') ELSE list_aggregate(list_filter(v, lambda x: x <= lo), 'median') END AS bl, list_aggregate(v, 'median') AS ml,
CASE WHEN len(v) <= 2 THEN list_aggregate(v, 'median') ELSE list_aggregate(list_filter(v, lambda x: x >= hi), 'median') END AS tl FROM p)"""


@query("fi:i i:i bl:d ml:d tl:d", f"WITH {_MED} SELECT * FROM med")
def reg_median(spark, d):
    return windows.register_medians(signal(spark, d), ["fi"], "i", "y", 5)


_UNIT = _SIG + ", u AS (SELECT *, CASE WHEN max(i) OVER p > min(i) OVER p THEN (i - min(i) OVER p) / (max(i) OVER p - min(i) OVER p) ELSE 0 END AS x FROM seg WINDOW p AS (PARTITION BY fi, s))"
_LINE = "CASE WHEN min(x) = max(x) THEN 0 ELSE regr_slope(y, x) END AS slope, CASE WHEN min(x) = max(x) THEN avg(y) ELSE regr_intercept(y, x) END AS icpt"


def _unit(spark, d):
    return signal(spark, d).withColumn("x", fit.unit_time(["fi", "s"], "i"))


@query("fi:i s:i slope:d icpt:d drop:d m:d", f"WITH {_UNIT}, f AS (SELECT fi, s, {_LINE}, count(*) AS n FROM u GROUP BY fi, s) SELECT *, slope * n / 100 AS drop, icpt + slope / 2 AS m FROM f")
def line_fit(spark, d):
    f = _unit(spark, d).groupBy("fi", "s").agg(*fit.line_fit("y", "x"), F.count(F.lit(1)).alias("n"))
    return f.withColumn("drop", F.col("slope") * F.col("n") / 100).withColumn("m", F.col("icpt") + F.col("slope") / 2)


@query("fi:i s:i cross_t:d cross_y:d reset:d", f"""WITH {_UNIT}, f AS (SELECT fi, s, {_LINE} FROM u GROUP BY fi, s), g AS (SELECT *, lag(icpt) OVER w AS pi, lag(slope) OVER w AS ps FROM f WINDOW w AS (PARTITION BY fi ORDER BY s))
SELECT fi, s, CASE WHEN slope <> ps THEN (pi - icpt) / (slope - ps) END AS cross_t, icpt + slope * (CASE WHEN slope <> ps THEN (pi - icpt) / (slope - ps) END) AS cross_y, icpt - coalesce(pi + ps, 0) AS reset FROM g""")
def line_cross(spark, d):
    f = _unit(spark, d).groupBy("fi", "s").agg(*fit.line_fit("y", "x"))
    w = Window.partitionBy("fi").orderBy("s")
    f = f.withColumn("pi", F.lag("icpt").over(w)).withColumn("ps", F.lag("slope").over(w))
    t, y = fn.line_cross(F.col("icpt"), F.col("slope"), F.col("pi"), F.col("ps"))
    return f.select("fi", "s", t.alias("cross_t"), y.alias("cross_y"), (F.col("icpt") - F.coalesce(F.col("pi") + F.col("ps"), F.lit(0.0))).alias("reset"))


@query("fi:i i:i resid:d", f"WITH {_UNIT}, f AS (SELECT fi, s, {_LINE} FROM u GROUP BY fi, s) SELECT fi, i, y - (slope * x + icpt) AS resid FROM u JOIN f USING (fi, s)")
def residual(spark, d):
    u = _unit(spark, d)
    f = u.groupBy("fi", "s").agg(*fit.line_fit("y", "x"))
    return u.join(f, ["fi", "s"]).withColumn("resid", fit.residual(F.col("y"), F.col("slope"), F.col("icpt"), F.col("x")))


def _poly_sql(order: int) -> str:
    k = order + 1
    sums = ", ".join([f"sum(pow(x, {j})) AS s{j}" for j in range(2 * order + 1)] + [f"sum(pow(x, {j}) * y) AS m{j}" for j in range(k)])

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + "".join(("" if j == 0 else (" - " if j % 2 else " + ")) + f"{a} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j, a in enumerate(m[0])) + ")"

    a = [[f"s{i + j}" for j in range(k)] for i in range(k)]
    cs = [f"CASE WHEN s0 <= {order} THEN {'m0 / s0' if c == 0 else '0'} ELSE {det([[f'm{i}' if j == c else a[i][j] for j in range(k)] for i in range(k)])} / {det(a)} END AS c{c}" for c in range(k)]
    return f"WITH {_UNIT}, p AS (SELECT fi, s, {sums} FROM (SELECT fi, s, y, 2 * x - 1 AS x FROM u) GROUP BY fi, s) SELECT fi, s, {', '.join(cs)} FROM p"


def _poly(spark, d, order):
    u = _unit(spark, d).withColumn("x", 2 * F.col("x") - 1)
    return fit.polynomial_fit(u, ["fi", "s"], "x", "y", order)


@query("fi:i s:i c0:d c1:d c2:d", _poly_sql(2))
def quad_fit(spark, d):
    return _poly(spark, d, 2)


@query("fi:i s:i c0:d c1:d c2:d c3:d", _poly_sql(3))
def cubic_fit(spark, d):
    return _poly(spark, d, 3)


_PAIR = _SIG + """, pr AS (SELECT fi, i // 32 AS pair, (i // 16) % 2 AS side, i - 32 * (i // 32) AS x, y FROM sig), ok AS (SELECT fi, pair FROM pr GROUP BY 1, 2 HAVING count(*) = 32), q AS (SELECT pr.* FROM pr JOIN ok USING (fi, pair)),
sl AS (SELECT fi, pair, side, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt FROM q GROUP BY 1, 2, 3), ab AS (SELECT fi, pair, regr_slope(y, x) AS s2, regr_intercept(y, x) AS i2 FROM q GROUP BY 1, 2),
v AS (SELECT q.*, slope, s2, slope * x + icpt AS own, s2 * x + i2 AS ab FROM q JOIN sl USING (fi, pair, side) JOIN ab USING (fi, pair))"""


def _bnd_part(name: str, cond: str, k: int) -> str:
    f = f" FILTER ({cond})" if cond else ""
    return f"""sqrt(avg(pow(own - ab, 2)){f}) AS rms{name}, sqrt(avg(pow(ab - y, 2)){f}) / sqrt(avg(pow(own - y, 2)){f}) AS "rmsR{name}", (1 - corr(own, ab){f}) / 2 AS "corrD{name}",
(6 + count(y){f} * ln(sum(pow(ab - y, 2)){f})) - ({2 * k} + count(y){f} * ln(sum(pow(own - y, 2)){f})) AS "aicI{name}\""""


@query("fi:i pair:i " + " ".join(f"{c}{n}:d" for n in ("", "_pre", "_post") for c in ("rms", "rmsR", "aicI")) + " corrD:d p:d r:d d_o:d d_m:d sd_prepost:d sd_pre:d sd_post:d",
       f"""WITH {_PAIR} SELECT fi, pair, {_bnd_part('', '', 6)}, {_bnd_part('_pre', 'side = 0', 3)}, {_bnd_part('_post', 'side = 1', 3)}, min(x) FILTER (side = 1) - max(x) FILTER (side = 0) AS p,
arg_min(own, x) FILTER (side = 1) - arg_max(own, x) FILTER (side = 0) AS r, arg_min(own, x) FILTER (side = 0) - arg_min(own, x) FILTER (side = 1) AS d_o, avg(own) FILTER (side = 0) - avg(own) FILTER (side = 1) AS d_m,
max(slope) FILTER (side = 0) - max(slope) FILTER (side = 1) AS sd_prepost, max(s2) - max(slope) FILTER (side = 0) AS sd_pre, max(s2) - max(slope) FILTER (side = 1) AS sd_post FROM v GROUP BY fi, pair""")
def discont(spark, d):
    sig = signal(spark, d).withColumn("pair", F.floor(F.col("i") / 32)).withColumn("side", (F.floor(F.col("i") / 16) % 2).cast("int")).withColumn("x", (F.col("i") % 32).cast("double"))
    full = sig.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("fi", "pair"))).where("n = 32")
    return fit.boundary_features(full, ["fi", "pair"], "x", "y", "side")


@query("fi:i s:i rms:d d:d sd:d d_init:d d_fin:d", f"""WITH {_UNIT}, l AS (SELECT fi, s, {_LINE} FROM u GROUP BY fi, s), g AS (SELECT fi, regr_slope(y, i) AS gs, regr_intercept(y, i) AS gi FROM sig GROUP BY fi),
v AS (SELECT u.fi, u.s, u.i, slope * x + icpt - (gs * u.i + gi) AS d FROM u JOIN l USING (fi, s) JOIN g USING (fi))
SELECT fi, s, sqrt(avg(d * d)) AS rms, avg(d) AS d, (arg_max(d, i) - arg_min(d, i)) / count(*) AS sd, arg_min(d, i) AS d_init, arg_max(d, i) AS d_fin FROM v GROUP BY fi, s""")
def gestalt(spark, d):
    u = _unit(spark, d)
    local = u.groupBy("fi", "s").agg(*fit.line_fit("y", "x"))
    whole = u.groupBy("fi").agg(F.regr_slope("y", "i").alias("gs"), F.regr_intercept("y", "i").alias("gi"))
    rows = u.join(local, ["fi", "s"]).join(whole, "fi")
    rows = rows.withColumn("yl", F.col("slope") * F.col("x") + F.col("icpt")).withColumn("yg", F.col("gs") * F.col("i") + F.col("gi"))
    return fit.gestalt(rows, ["fi", "s"], "i", "yl", "yg")


_DCT = _SIG + """, z AS (SELECT fi, i, y - avg(y) OVER (PARTITION BY fi) AS y, count(*) OVER (PARTITION BY fi) AS n FROM sig), c0 AS (SELECT fi, k, n, sum(y * cos(pi() * k * (2 * i + 1) / (2 * n))) AS c FROM z, (SELECT unnest(generate_series(0, 10)) AS k) WHERE k < n GROUP BY 1, 2, 3),
spec AS (SELECT fi, k, k + 100.0 / (2 * n) AS f, c * sqrt((CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END) / n) AS c FROM c0 WHERE k + 100.0 / (2 * n) <= 10)"""


@query("fi:i k:i f:d c:d", f"WITH {_DCT} SELECT * FROM spec WHERE k > 0")
def dct_band(spark, d):
    return spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0, drop_mean=True)


@query("fi:i sm1:d sm2:d sm3:d f_max:d", f"""WITH {_DCT}, w AS (SELECT fi, f, abs(c) AS a, sum(abs(c)) OVER (PARTITION BY fi) AS t FROM spec WHERE k > 0), m1 AS (SELECT *, sum(a * f) OVER (PARTITION BY fi) / t AS m1 FROM w),
m2 AS (SELECT *, sum(a * pow(f - m1, 2)) OVER (PARTITION BY fi) / t AS m2 FROM m1) SELECT fi, max(m1) AS sm1, max(m2) AS sm2, sum(a * pow(f - m2, 3)) / max(t) AS sm3, arg_max(f, a) AS f_max FROM m2 GROUP BY fi""")
def spec_moments(spark, d):
    return spectral.spectral_moments(spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0, drop_mean=True), ["fi"])


@query("fi:i prop:d dgm:d", f"WITH {_DCT} SELECT fi, coalesce(sum(abs(c)) FILTER (abs(f - 5) <= 1), 0) / sum(abs(c)) AS prop, 5 - arg_max(f, abs(c)) AS dgm FROM spec WHERE k > 0 GROUP BY fi")
def rate_prop(spark, d):
    return spectral.rate_share(spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0, drop_mean=True), ["fi"], F.lit(5.0))


# --- classes -----------------------------------------------------------------
_VEC = "x AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CENT = _VEC + ", cent AS (SELECT label, j, median(x) AS c FROM x GROUP BY 1, 2)"


def _vectors(spark, d):
    return classify.long_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", ["label"])


@query("vec_id:i j:i z:d", f"WITH {_VEC}, s AS (SELECT j, median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM x GROUP BY j) SELECT vec_id, j, (x - m) / (CASE WHEN q = 0 THEN 1 ELSE q END) AS z FROM x JOIN s USING (j)")
def robust_scale(spark, d):
    return classify.robust_scale(_vectors(spark, d))


@query("vec_id:i class:i dist:d", f"WITH {_CENT}, dd AS (SELECT vec_id, c.label AS class, sqrt(sum(pow(x.x - c.c, 2))) AS dist FROM x JOIN cent c USING (j) GROUP BY 1, 2) SELECT vec_id, arg_min(class, dist) AS class, min(dist) AS dist FROM dd GROUP BY 1")
def nearest_centroid(spark, d):
    cents = classify.as_vectors(classify.centroids(_vectors(spark, d), "label"), "label", "c", "c")
    return classify.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "embedding", cents, "label", "c")


@query("j:i low:d high:d", f"WITH {_VEC}, p AS (SELECT j, quantile_cont(x, 0.8) AS p FROM x GROUP BY j) SELECT j, median(x) FILTER (x <= p) AS low, median(x) FILTER (x > p) AS high FROM x JOIN p USING (j) GROUP BY j")
def centroid_split(spark, d):
    return classify.split_centroids(_vectors(spark, d), 80.0)


@query("j:i w:d", f"WITH {_VEC}, m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM x), c AS (SELECT j, greatest(0, coalesce(corr(x, m), 0)) AS c FROM m GROUP BY j) SELECT j, CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 0 END AS w FROM c")
def corr_weights(spark, d):
    return classify.corr_weights(_vectors(spark, d), "vec_id")


@query("vec_id:i j:i d:d", f"WITH {_VEC} SELECT vec_id, j, coalesce(x - lag(x) OVER w, x - lead(x) OVER w) AS d FROM x WINDOW w AS (PARTITION BY j ORDER BY vec_id)")
def delta_feats(spark, d):
    return classify.delta(_vectors(spark, d), "vec_id")


@query("vec_id:i silhouette:d", f"""WITH {_VEC}, dd AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS o, sum(pow(a.x - b.x, 2)) AS d2 FROM x a JOIN x b ON a.j = b.j AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
m AS (SELECT vec_id, own, other, avg(d2) AS d FROM dd GROUP BY 1, 2, 3), ab AS (SELECT vec_id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY 1) SELECT vec_id, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab""")
def silhouette(spark, d):
    return classify.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("fi:i event_id:i y:d", f"WITH {_SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY fi ORDER BY y DESC, event_id) AS r FROM sig) SELECT fi, event_id, y FROM r WHERE r <= 3")
def topk_ratio(spark, d):
    r = F.row_number().over(Window.partitionBy("fi").orderBy(F.desc("y"), "event_id"))
    return signal(spark, d).withColumn("r", r).where("r <= 3")


@query("fi:i hi:i lo:i", f"WITH {_SIG} SELECT fi, arg_max(event_id, y * 1e6 - i) AS hi, arg_min(event_id, y * 1e6 + i) AS lo FROM sig GROUP BY fi")
def minmax_pick(spark, d):
    return signal(spark, d).groupBy("fi").agg(F.max_by("event_id", F.col("y") * 1e6 - F.col("i")).alias("hi"), F.min_by("event_id", F.col("y") * 1e6 + F.col("i")).alias("lo"))


@query("k:i v:d", "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return interval.upsert(old, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), ["k"])


@query("k:i", "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_band(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("k:i", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def except_frames(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")))


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    start = [r[0] for r in vectors.orderBy("vec_id").limit(5).select("embedding").collect()]
    return classify.kmeans(vectors, "vec_id", "embedding", start)


def mean_shift(spark: SparkSession, d: str) -> DataFrame:
    return classify.mean_shift(table(spark, d, "embeddings"), "vec_id", "embedding")


def enforce_distance(spark: SparkSession, d: str) -> DataFrame:
    return classify.enforce_distance(signal(spark, d), ["fi"], "t", "y", 43200.0)


QUERIES |= {"kmeans": kmeans, "mean_shift": mean_shift, "enforce_distance": enforce_distance}

from . import catalogue_more as _more  # noqa: E402, F401
