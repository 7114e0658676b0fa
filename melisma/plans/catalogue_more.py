"""More queries: candidates and their classes, windows, errors, strings and arrays.

A candidate is an event of :func:`catalogue.signal` at a time of its own, with three
features; a purchase is a certain 1, a login a certain 0.  Groups are blocks of 16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import augment, interval, spectral, stats, windows
from .catalogue import _DCT, _SIG, _VEC, QUERIES, SQL, enforce_distance, query, signal, table
from .prosody import spectral_balance

_CAND = _SIG + """, cand AS (SELECT fi, event_id, label, i, s, i * 0.25::DOUBLE + (event_id % 3) * 0.05::DOUBLE AS t, y AS a, (event_id % 17)::DOUBLE AS b, (i % 5)::DOUBLE AS c,
  CASE WHEN label = 'purchase' THEN 1 WHEN label = 'login' THEN 0 END AS seed FROM seg),
grp AS (SELECT fi, s, min(t) AS on_, max(t) AS off_ FROM cand GROUP BY fi, s),
long AS (SELECT fi, event_id, seed, 0 AS j, a AS x FROM cand UNION ALL SELECT fi, event_id, seed, 1, b FROM cand UNION ALL SELECT fi, event_id, seed, 2, c FROM cand)"""


def candidates(spark, d: str) -> DataFrame:
    seed = F.when(F.col("label") == "purchase", 1).when(F.col("label") == "login", 0)
    t = F.col("i") * 0.25 + (F.col("event_id") % 3) * 0.05
    v = F.array(F.col("y"), (F.col("event_id") % 17).cast("double"), (F.col("i") % 5).cast("double"))
    return signal(spark, d).select("fi", "event_id", "label", "i", "s", t.alias("t"), F.col("y").alias("a"), v.alias("v"), seed.alias("seed"))


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fi", "s").agg(F.min("t").alias("on"), F.max("t").alias("off"))


# --- scaling and weights -------------------------------------------------------
@query("fi:i event_id:i j:i z:d", f"""WITH {_CAND}, st AS (SELECT fi, j, count(*) AS n, max(abs(x)) AS mx, median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM long GROUP BY fi, j)
SELECT fi, event_id, j, CASE WHEN n <= 10 THEN x / (CASE WHEN mx = 0 THEN 1 ELSE mx END) ELSE (x - m) / (CASE WHEN q = 0 THEN 1 ELSE q END) END AS z FROM long JOIN st USING (fi, j)""")
def unit_scaled(spark, d):
    return augment.scaled(candidates(spark, d), ["fi"]).select("fi", "event_id", F.posexplode("v").alias("j", "z"))


@query("j:i w:d", f"""WITH {_VEC}, k AS (SELECT vec_id, j, x, label % 2 AS l FROM x), dd AS (SELECT a.j, a.vec_id, a.l, b.l AS o, sum(abs(a.x - b.x)) AS s, count(*) AS n FROM k a JOIN k b USING (j) GROUP BY 1, 2, 3, 4),
m AS (SELECT j, vec_id, max(CASE WHEN l = o THEN n END) AS n, max(CASE WHEN l = o AND n > 1 THEN s / (n - 1) END) AS a, max(CASE WHEN l <> o THEN s / n END) AS b FROM dd GROUP BY 1, 2),
s AS (SELECT j, avg(CASE WHEN n <= 1 THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) + 1 AS w FROM m GROUP BY 1) SELECT j, w / sum(w) OVER () AS w FROM s""")
def silhouette_weights(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("class"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return augment.silhouette_weights(rows, []).select(F.posexplode("w").alias("j", "w"))


@query("fi:i j:i w:d", f"""WITH {_CAND}, m AS (SELECT *, avg(x) OVER (PARTITION BY fi, event_id) AS m FROM long), c AS (SELECT fi, j, CASE WHEN min(x) = max(x) OR min(m) = max(m) THEN 0 ELSE greatest(0, coalesce(corr(x, m), 0)) END AS c FROM m GROUP BY fi, j)
SELECT fi, j, CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 1 END AS w FROM c WINDOW w AS (PARTITION BY fi)""")
def correlation_weights(spark, d):
    return augment.correlation_weights(candidates(spark, d), ["fi"]).select("fi", F.posexplode("w").alias("j", "w"))


_SPLIT = """lim AS (SELECT fi, j, CASE WHEN max(x) > quantile_cont(x, 0.8) THEN quantile_cont(x, 0.8) ELSE avg(x) END AS p FROM long GROUP BY fi, j),
split AS (SELECT fi, j, coalesce(median(x) FILTER (x <= p), median(x)) AS c0, coalesce(median(x) FILTER (x > p), median(x)) AS c1 FROM long JOIN lim USING (fi, j) GROUP BY fi, j)"""


@query("fi:i j:i c0:d c1:d", f"WITH {_CAND}, {_SPLIT} SELECT * FROM split")
def split_medians(spark, d):
    return augment.split_medians(candidates(spark, d), ["fi"], 80.0).select("fi", F.posexplode(F.arrays_zip("c0", "c1")).alias("j", "c")).select("fi", "j", "c.c0", "c.c1")


_SEEDED = f"""{_SPLIT}, st AS (SELECT fi, j, median(x) FILTER (seed = 0) AS s0, median(x) FILTER (seed = 1) AS s1 FROM long GROUP BY fi, j),
dd AS (SELECT fi, event_id, sqrt(sum(w * pow(x - s0, 2))) AS d0, sqrt(sum(w * pow(x - s1, 2))) AS d1 FROM long JOIN st USING (fi, j) JOIN (SELECT unnest([0, 1, 2]) AS j, unnest([1.0, 0.5, 2.0])::DOUBLE AS w) USING (j) GROUP BY fi, event_id),
r AS (SELECT fi, event_id, CASE WHEN d0 IS NOT NULL THEN d0 / (CASE WHEN d1 = 0 THEN 1e-8 ELSE d1 END) ELSE -d1 END AS d FROM dd WHERE d1 IS NOT NULL),
rl AS (SELECT fi, CASE WHEN max(d) > quantile_cont(d, 0.8) THEN quantile_cont(d, 0.8) ELSE avg(d) END AS p FROM r GROUP BY fi),
h AS (SELECT fi, j, coalesce(median(x) FILTER (d <= p), median(x)) AS h0, coalesce(median(x) FILTER (d > p), median(x)) AS h1 FROM long JOIN r USING (fi, event_id) JOIN rl USING (fi) GROUP BY fi, j)"""


@query("fi:i j:i c0:d c1:d", f"WITH {_CAND}, {_SEEDED} SELECT fi, j, coalesce(h0, c0) AS c0, coalesce(h1, c1) AS c1 FROM split LEFT JOIN h USING (fi, j)")
def seed_centroids(spark, d):
    rows = augment.centroids(candidates(spark, d), ["fi"], "seed_prct", 80.0, "user", [1.0, 0.5, 2.0])
    return rows.select("fi", F.posexplode(F.arrays_zip("c0", "c1")).alias("j", "c")).select("fi", "j", "c.c0", "c.c1")


@query("fi:i event_id:i class:i weight:d", f"""WITH {_CAND}, k AS (SELECT *, sqrt(pow(a - 10, 2) + 0.5 * pow(b - 2, 2) + 2 * pow(c - 1, 2)) * 0.2 AS d0, sqrt(pow(a - 60, 2) + 0.5 * pow(b - 9, 2) + 2 * pow(c - 3, 2)) * 0.8 AS d1 FROM cand)
SELECT fi, event_id, CASE WHEN d1 < d0 OR seed = 1 THEN 1 ELSE 0 END AS class, (a + 0.5 * b + 2 * c) / 3.5 AS weight FROM k""")
def classify_attract(spark, d):
    centers = spark.createDataFrame([([10.0, 2.0, 1.0], [60.0, 9.0, 3.0], [1.0, 0.5, 2.0])], "c0 array<double>, c1 array<double>, w array<double>")
    return augment.classify(candidates(spark, d), [], centers, (80.0, 20.0))


# --- seeds -----------------------------------------------------------------------
@query("fi:i s:i t:d seed:i", f"WITH {_CAND}, g AS (SELECT *, lead(on_) OVER (PARTITION BY fi ORDER BY on_) AS nx FROM grp) SELECT fi, s, off_ AS t, CASE WHEN off_ < nx - 0.22 THEN 1 WHEN off_ - on_ < 3.8 THEN 0 END AS seed FROM g WHERE nx IS NOT NULL")
def gap_seeds(spark, d):
    return augment.gap_seeds(groups(candidates(spark, d)), ["fi"], 3.8, 0.22)


@query("fi:i event_id:i seed:i", f"WITH {_CAND} SELECT fi, event_id, CASE WHEN seed = 1 THEN 1 WHEN EXISTS (SELECT 1 FROM cand b WHERE b.fi = a.fi AND b.seed = 1 AND b.t > a.t AND b.t - a.t < 0.63) THEN 0 ELSE seed END AS seed FROM cand a")
def near_seeds(spark, d):
    return augment.near_seeds(candidates(spark, d), ["fi"], 0.63)


@query("fi:i event_id:i seed:i", f"""WITH {_CAND}, st AS (SELECT fi, j, median(abs(x)) AS m, quantile_cont(abs(x), 0.75) - quantile_cont(abs(x), 0.25) AS q FROM long GROUP BY fi, j),
z AS (SELECT fi, event_id, sum((abs(x) - m) / (CASE WHEN q = 0 THEN 1 ELSE q END) ORDER BY j) AS s FROM long JOIN st USING (fi, j) GROUP BY 1, 2), p AS (SELECT fi, quantile_cont(s, 0.1) AS lo, quantile_cont(s, 0.9) AS hi FROM z GROUP BY fi)
SELECT fi, event_id, CASE WHEN s >= hi - 1e-12 THEN 1 WHEN s <= lo + 1e-12 THEN 0 END AS seed FROM z JOIN p USING (fi)""")
def minmax_seeds(spark, d):
    return augment.minmax_seeds(candidates(spark, d), ["fi"])


@query("fi:i event_id:i seed:i", f"""WITH {_CAND}, g AS (SELECT *, CASE WHEN round(off_ - on_, 9) <= 2 THEN 0 WHEN round(off_ - on_, 9) >= 3.8 THEN 1 END AS k FROM grp),
held AS (SELECT c.fi, c.event_id, c.t, g.on_, g.k, (a + 0.5 * b + 2 * c.c) / 3.5 AS w FROM cand c JOIN g ON g.fi = c.fi AND c.t BETWEEN g.on_ AND g.off_ WHERE g.k IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY fi, on_ ORDER BY w DESC, t) AS r FROM held), f AS (SELECT fi, event_id, max(k) AS k FROM r WHERE k = 0 OR r = 1 GROUP BY 1, 2) SELECT c.fi, c.event_id, f.k AS seed FROM cand c LEFT JOIN f USING (fi, event_id)""")
def word_seeds(spark, d):
    rows = candidates(spark, d)
    return augment.word_seeds(rows, groups(rows), ["fi"], [1.0, 0.5, 2.0], 2.0, 3.8)


# --- features --------------------------------------------------------------------
@query("fi:i event_id:i n:i d0:d d2:d", f"WITH {_CAND} SELECT fi, event_id, 6 AS n, coalesce(a - lag(a) OVER w, a - lead(a) OVER w, 0) AS d0, coalesce(c - lag(c) OVER w, c - lead(c) OVER w, 0) AS d2 FROM cand WINDOW w AS (PARTITION BY fi ORDER BY t)")
def abs_and_delta(spark, d):
    rows, _ = augment.with_delta(candidates(spark, d), ["fi"], "abs+delta", [1.0, 1.0, 1.0])
    return rows.select("fi", "event_id", F.size("v").alias("n"), F.col("v")[3].alias("d0"), F.col("v")[5].alias("d2"))


@query("fi:i event_id:i v0:d v1:d bad:i", f"WITH {_SIG} SELECT fi, event_id, CASE WHEN y > 20 THEN abs(y - 60) ELSE 0 END AS v0, (i % 5)::DOUBLE AS v1, CASE WHEN y > 20 THEN 0 ELSE 1 END AS bad FROM sig")
def feature_vector(spark, d):
    rows = signal(spark, d).withColumn("p", F.when(F.col("y") > 20, F.col("y") - 60)).withColumn("q", F.col("i") % 5).withColumn("r", F.lit(1.0))
    rows, _ = augment.feature_vector(rows, {"p": 1.0, "q": 2.0, "r": 0.0}, {"p"})
    return rows.select("fi", "event_id", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), F.col("bad").cast("int").alias("bad"))


@query("fi:i event_id:i vowel:s dur:d", f"""WITH {_CAND}, ph AS (SELECT fi, t, 'V' || event_id % 3 AS l, (event_id % 4 + 1)::DOUBLE AS dur FROM cand WHERE label = 'click' AND event_id % 3 < 2),
p AS (SELECT c.fi, c.event_id, (SELECT arg_max(l, ph.t) FROM ph WHERE ph.fi = c.fi AND ph.t < c.t) AS l, (SELECT arg_max(dur, ph.t) FROM ph WHERE ph.fi = c.fi AND ph.t < c.t) AS d FROM cand c WHERE label = 'purchase'),
k AS (SELECT fi, event_id, coalesce(l, 'x') AS vowel, coalesce(d, 1) AS d FROM p), st AS (SELECT vowel, median(d) AS m, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS q FROM k GROUP BY vowel)
SELECT fi, event_id, vowel, (d - m) / (CASE WHEN q = 0 THEN 1 ELSE q END) AS dur FROM k JOIN st USING (vowel)""")
def vowel_length(spark, d):
    rows = candidates(spark, d)
    phones = rows.where("label = 'click'").select("fi", F.col("t").alias("on"), (F.col("t") + F.col("event_id") % 4 + 1).alias("off"), F.concat(F.lit("V"), F.col("event_id") % 3).alias("label"))
    found = augment.previous_vowel(rows.where("label = 'purchase'").select("fi", "event_id", "t"), phones, ["fi"], "V[01]")
    return augment.vowel_scaled(found.withColumn("vowel_dur", F.round("vowel_dur", 6)), []).withColumnRenamed("vowel_dur", "dur")


# --- selection and tiers -----------------------------------------------------------
@query("fi:i event_id:i", f"WITH {_CAND}, m AS (SELECT g.fi, max(c.t) AS t FROM grp g JOIN cand c ON c.fi = g.fi AND c.t BETWEEN g.on_ AND g.off_ GROUP BY g.fi, g.on_) SELECT c.fi, c.event_id FROM cand c WHERE EXISTS (SELECT 1 FROM m WHERE m.fi = c.fi AND m.t = c.t)")
def preselect_right(spark, d):
    rows = candidates(spark, d)
    return augment.preselect(rows, groups(rows), ["fi"], "right")


@query("fi:i event_id:i", f"WITH {_CAND}, r AS (SELECT c.fi, c.event_id, row_number() OVER (PARTITION BY c.fi, g.on_ ORDER BY c.a DESC, c.t) AS r FROM cand c JOIN grp g ON g.fi = c.fi AND c.t BETWEEN g.on_ AND g.off_) SELECT DISTINCT fi, event_id FROM r WHERE r = 1")
def postselect_max(spark, d):
    rows = candidates(spark, d)
    return augment.postselect(rows, groups(rows), ["fi"], "a")


@query("fi:i on:d off:d", f"""WITH {_CAND}, parent AS (SELECT fi, s // 3 AS p, min(on_) AS on_, max(off_) AS off_ FROM grp GROUP BY fi, s // 3), mk AS (SELECT fi, max(t) AS t, arg_max(label, t) AS l FROM cand GROUP BY fi, s),
cut0 AS (SELECT g.*, lead(on_) OVER (PARTITION BY fi ORDER BY on_, off_) IS NOT NULL AND (EXISTS (SELECT 1 FROM mk WHERE mk.fi = g.fi AND mk.t = g.off_ AND l = 'purchase') OR EXISTS (SELECT 1 FROM parent p WHERE p.fi = g.fi AND p.off_ = g.off_)) AS k FROM grp g),
run AS (SELECT *, sum(k::INT) OVER (PARTITION BY fi ORDER BY on_, off_ ROWS UNBOUNDED PRECEDING) - k::INT AS run FROM cut0), part AS (SELECT fi, run, min(on_) AS on_, max(off_) AS off_ FROM run GROUP BY fi, run HAVING bool_or(k)),
e AS (SELECT fi, min(on_) AS f, max(off_) AS e FROM parent GROUP BY fi), l AS (SELECT fi, max(off_) AS l FROM part GROUP BY fi), tail AS (SELECT e.*, l.l, e.e - l.l < 3.0 AS short FROM e LEFT JOIN l USING (fi))
SELECT fi, on_ AS "on", CASE WHEN off_ = l AND e > l AND short THEN e ELSE off_ END AS "off" FROM part JOIN tail USING (fi) UNION ALL SELECT fi, coalesce(l, f), e FROM tail WHERE l IS NULL OR (e > l AND NOT short)""")
def cut_segments(spark, d):
    rows = candidates(spark, d)
    seg = groups(rows)
    parents = seg.groupBy("fi", F.floor(F.col("s") / 3)).agg(F.min("on").alias("on"), F.max("off").alias("off"))
    marked = rows.groupBy("fi", "s").agg(F.max("t").alias("t"), (F.max_by("label", "t") == "purchase").cast("int").alias("class"))
    return augment.cut_segments(seg, marked, parents, ["fi"], 3.0)


@query("fi:i t:d", f"WITH {_CAND}, p AS (SELECT fi, t FROM cand WHERE label = 'purchase' AND a > 60) SELECT * FROM p UNION ALL SELECT fi, first(t ORDER BY a DESC, t) FROM cand WHERE fi NOT IN (SELECT fi FROM p) GROUP BY fi")
def forced_accent(spark, d):
    rows = candidates(spark, d)
    return augment.forced(rows.where("label = 'purchase' AND a > 60"), rows.select("fi", "t", F.col("a").alias("y")), ["fi"])


@query("fi:i tier:s n:i first:d", f"WITH {_CAND}, old AS (SELECT fi, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END AS tier, t FROM cand), new AS (SELECT fi, 'B' AS tier, t FROM cand WHERE label = 'purchase') SELECT fi, tier, count(*) AS n, min(t) AS first FROM (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.fi = o.fi AND new.tier = o.tier) UNION ALL SELECT * FROM new) GROUP BY 1, 2")
def tiers_replaced(spark, d):
    rows = candidates(spark, d)
    ends = rows.groupBy("fi").agg(F.max("t").alias("file_end"))
    old = rows.select("fi", F.when(F.col("i") % 2 == 0, "A").otherwise("B").alias("tier"), F.col("t").alias("xmin"))
    new = augment.as_tier(rows.where("label = 'purchase'").select("fi", "t"), ["fi"], "B", "x", ends)
    return augment.add_tiers(old, new, ["fi"]).groupBy("fi", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("xmin").alias("first"))


# --- windows, spectra, errors --------------------------------------------------------
@query("fi:i event_id:i left:d right:d", f"WITH {_SIG} SELECT fi, event_id, avg(y) OVER (PARTITION BY fi ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS left, avg(y) OVER (PARTITION BY fi ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS right FROM sig")
def side_windows(spark, d):
    rows = windows.side_windows(signal(spark, d), ["fi"], "i", "y", 5, "left", F.avg).withColumnRenamed("windowed", "left")
    return windows.side_windows(rows, ["fi"], "i", "y", 5, "right", F.avg).withColumnRenamed("windowed", "right")


@query("fi:i event_id:i med:d mean:d", f"WITH {_SIG} SELECT fi, event_id, median(y) OVER w AS med, avg(y) OVER w AS mean FROM sig WINDOW w AS (PARTITION BY fi ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def smoothers(spark, d):
    rows = windows.smoothed(signal(spark, d), ["fi"], "i", "y", "median", 5, "med")
    return windows.smoothed(rows, ["fi"], "i", "y", "mean", 5, "mean")


@query("fi:i event_id:i e:d peak:i", f"WITH {_SIG} SELECT fi, event_id, y - 0.95 * coalesce(lag(y) OVER w, 0) AS e, coalesce(y > lag(y) OVER w AND y > lead(y) OVER w, FALSE)::INT AS peak FROM sig WINDOW w AS (PARTITION BY fi ORDER BY i)")
def pre_emphasis(spark, d):
    rows = signal(spark, d).withColumn("e", windows.pre_emphasis("y", ["fi"], "i"))
    return rows.withColumn("peak", windows.local_maxima("y", ["fi"], "i").cast("int"))


@query("fi:i sb:d rms:d", f"WITH {_SIG}, e AS (SELECT fi, y, y - 0.95 * coalesce(lag(y) OVER (PARTITION BY fi ORDER BY i), 0) AS e FROM sig) SELECT fi, 20 * log10(sqrt(avg(e * e)) / sqrt(avg(y * y))) AS sb, sqrt(avg(y * y)) AS rms FROM e GROUP BY fi")
def balance(spark, d):
    return spectral_balance(signal(spark, d).withColumnRenamed("y", "x"), ["fi"])


@query("k:i hamming:d hann:d triang:d db:d", "SELECT k, 0.54 - 0.46 * cos(2 * pi() * k / 16) AS hamming, 0.5 - 0.5 * cos(2 * pi() * k / 16) AS hann, 1 - abs((2 * k - 16) / 16.0) AS triang, 20 * log10((k + 1) / 2e-5) AS db FROM (SELECT unnest(generate_series(0, 15)) AS k)")
def window_weights(spark, d):
    k, n = F.col("k"), F.lit(16)
    return spark.range(16).select(F.col("id").alias("k")).select("k", *(windows.window_weight(w, k, n).alias(w) for w in ("hamming", "hann", "triang")), windows.level_db(k + 1.0, windows.PRESSURE).alias("db"))


@query("fi:i f_low:d c_sum:d", f"WITH {_DCT}, u AS (SELECT DISTINCT fi FROM spec), b AS (SELECT fi, unnest(generate_series(0, 9)) AS b FROM u), s AS (SELECT fi, floor(f)::BIGINT AS b, sum(abs(c)) AS c FROM spec WHERE f < 10 GROUP BY 1, 2) SELECT b.fi, b.b::DOUBLE AS f_low, coalesce(s.c, 0) AS c_sum FROM b LEFT JOIN s USING (fi, b)")
def frequency_bins(spark, d):
    return spectral.frequency_bins(spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0), ["fi"], 0.0, 10.0)


@query("fi:i i:i y:d", f"WITH {_DCT}, sp AS (SELECT s.*, z.n FROM spec s JOIN (SELECT DISTINCT fi, n FROM z) z USING (fi)) SELECT fi, i, sum(c * sqrt((CASE WHEN k = 0 THEN 1.0 ELSE 2.0 END) / n) * cos(pi() * k * (2 * i + 1) / (2 * n))) AS y FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM sp) GROUP BY 1, 2")
def inverse_dct(spark, d):
    return spectral.inverse_dct(spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0), ["fi"], "n")


@query("fi:i mae:d", f"WITH {_DCT}, sp AS (SELECT s.*, z.n FROM spec s JOIN (SELECT DISTINCT fi, n FROM z) z USING (fi) WHERE k > 0), e AS (SELECT fi, i, sum((CASE WHEN abs(f - 5) <= 1 THEN 0 ELSE c END) * 2 * cos(pi() * k * (2 * i + 1) / (2 * n))) AS e FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM sp) GROUP BY 1, 2) SELECT fi, avg(abs(e)) AS mae FROM e GROUP BY fi")
def rate_error(spark, d):
    spec = spectral.band_dct(signal(spark, d), ["fi"], "i", "y", 100.0, 10.0, drop_mean=True)
    return spectral.rate_error(spec, ["fi"], F.lit(5.0), "n", 0)


@query("fi:i mae:d rss:d mse:d rmsd:d aic:d", f"WITH {_CAND} SELECT fi, avg(abs(a - b)) AS mae, sum(pow(a - b, 2)) AS rss, avg(pow(a - b, 2)) AS mse, sqrt(avg(pow(a - b, 2))) AS rmsd, 6 + count(*) * ln(sum(pow(a - b, 2))) AS aic FROM cand GROUP BY fi")
def errors_two(spark, d):
    rows = candidates(spark, d).withColumn("b", F.col("v")[1])
    return rows.groupBy("fi").agg(fn.mae("a", "b").alias("mae"), fn.rss("a", "b").alias("rss"), fn.mse("a", "b").alias("mse"), fn.rmsd("a", "b").alias("rmsd"), fn.aic(F.count(F.lit(1)), fn.rss("a", "b"), 3).alias("aic"))


# --- scalars, strings, arrays ----------------------------------------------------------
@query("fi:i event_id:i st:d hz:d safe:d nz:d", f"WITH {_SIG} SELECT fi, event_id, 12 * log2((y + 1) / 50) AS st, y + 1 AS hz, CASE WHEN i % 3 <> 0 THEN y / (i % 3) END AS safe, CASE WHEN i % 3 = 0 THEN 1e-8 ELSE i % 3 END AS nz FROM sig")
def guarded_math(spark, d):
    rows = signal(spark, d).withColumn("st", fn.semitone(F.col("y") + 1, F.lit(50.0)))
    k = (F.col("i") % 3).cast("double")
    return rows.select("fi", "event_id", "st", fn.hertz("st", F.lit(50.0)).alias("hz"), fn.safe_div(F.col("y"), k).alias("safe"), fn.nonzero(k).alias("nz"))


@query("page_id:i dir:s stm:s ext:s clean:s", r"SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*?)(?:\.[^./]*)?$', 1) AS stm, regexp_extract(url, '\.([^./]*)$', 1) AS ext, regexp_replace(trim('  a  ' || page_id || '   b '), '\s+', ' ', 'g') AS clean FROM pages")
def path_parts(spark, d):
    spaced = F.concat(F.lit("  a  "), F.col("page_id").cast("string"), F.lit("   b "))
    return table(spark, d, "pages").select("page_id", fn.folder("url").alias("dir"), fn.stem("url").alias("stm"), fn.extension("url").alias("ext"), fn.clean_spaces(spaced).alias("clean"))


@query("vec_id:i cut:d grown:d both:d n:i", "SELECT vec_id, list_sum(embedding[1:5]::DOUBLE[]) AS cut, list_sum(embedding[1:3]::DOUBLE[]) + 4 * embedding[3]::DOUBLE AS grown, list_sum(embedding[1:3]::DOUBLE[]) + list_sum(embedding[2:4]::DOUBLE[]) AS both, vec_id % 4 AS n FROM embeddings")
def array_lengths(spark, d):
    e, total = F.transform("embedding", lambda x: x.cast("double")), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e"))
    a, b = fn.same_length(F.slice("e", 1, 3), F.slice("e", 2, 9))
    return rows.select("vec_id", total(fn.fit_length(F.col("e"), F.lit(5))).alias("cut"), total(fn.fit_length(F.slice("e", 1, 3), F.lit(7))).alias("grown"), (total(a) + total(b)).alias("both"), F.size(fn.places(F.col("vec_id") % 4)).alias("n"))


# --- tables ------------------------------------------------------------------------------
@query("fi:i event_id:i y:d", f"WITH {_SIG}, m AS (SELECT fi, avg(y) FILTER (y > 20) AS m FROM sig GROUP BY fi) SELECT fi, event_id, CASE WHEN y > 20 THEN y ELSE m END AS y FROM sig JOIN m USING (fi)")
def imputed_mean(spark, d):
    return stats.imputed(signal(spark, d).withColumn("y", F.when(F.col("y") > 20, F.col("y"))), ["fi"], ["y"])


@query("label:s n:i x:d y:d", f"WITH {_CAND}, m AS (SELECT label, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM cand GROUP BY label), g AS (SELECT *, -1 + unnest(generate_series(0, 99)) * (2.0::DOUBLE / 99) AS x FROM m) SELECT label, n, x, a + x * (b + x * c) AS y FROM g")
def mean_curves(spark, d):
    rows = candidates(spark, d).select("label", *(F.col("v")[k].alias(c) for k, c in enumerate("abc")))
    return stats.mean_curves(rows, ["label"], ["a", "b", "c"])


@query("fi:i event_id:i key:s A_rate:d stm:s", f"WITH {_CAND} SELECT fi, event_id, fi || '_' || label || '_#_' || coalesce(seed::VARCHAR, '#') AS key, CASE WHEN i % 2 = 0 THEN a ELSE b END AS \"A_rate\", label AS stm FROM cand")
def channel_columns(spark, d):
    rows = candidates(spark, d).withColumn("ci", F.col("i") % 2).withColumn("A_1_rate", F.col("a")).withColumn("A_2_rate", F.col("v")[1])
    rows = rows.withColumn("glob_stm", F.col("label")).withColumn("loc_stm", F.col("label")).withColumn("key", stats.group_key(rows, ["fi", "label", "none", "seed"]))
    return stats.one_of_redundant(stats.by_channel(rows), "_stm$", "stm")


@query("k:i v:s", "SELECT c_custkey AS k, 'a' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 'b' FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def first_source(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("a").alias("v"))
    return interval.first_source(a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("b").alias("v"))), ["k"], "v")


@query("fi:i on:d off:d label:s", f"""WITH {_CAND}, g AS (SELECT fi, on_, off_ - 0.02 AS off_ FROM grp), o AS (SELECT *, lag(off_) OVER (PARTITION BY fi ORDER BY on_) AS p, max(off_) OVER (PARTITION BY fi) AS m FROM g)
SELECT fi, on_ AS "on", off_ AS "off", 'x' AS label FROM g UNION ALL SELECT fi, coalesce(p, 0), on_, '' FROM o WHERE on_ > coalesce(p, 0) UNION ALL SELECT DISTINCT fi, m, 100000.0, '' FROM o""")
def fill_gaps(spark, d):
    seg = groups(candidates(spark, d)).select("fi", "on", (F.col("off") - 0.02).alias("off"), F.lit("x").alias("label"))
    return interval.fill_gaps(seg, ["fi"], "on", "off", "label", F.lit(100000.0))


_KEPT = _SIG + """, r AS (SELECT fi, t, y, row_number() OVER (PARTITION BY fi ORDER BY t, y) AS r FROM sig),
kept AS (SELECT fi, r, t, y, NULL::DOUBLE AS ft, NULL::DOUBLE AS fy FROM r WHERE r = 1 UNION ALL
  SELECT k.fi, r.r, CASE WHEN r.t - k.t >= 43200 OR r.y > k.y THEN r.t ELSE k.t END, CASE WHEN r.t - k.t >= 43200 OR r.y > k.y THEN r.y ELSE k.y END, CASE WHEN r.t - k.t >= 43200 THEN k.t END, CASE WHEN r.t - k.t >= 43200 THEN k.y END FROM kept k JOIN r ON r.fi = k.fi AND r.r = k.r + 1)"""


@query("fi:i t:d y:d", f"WITH RECURSIVE {_KEPT} SELECT fi, ft AS t, fy AS y FROM kept WHERE ft IS NOT NULL UNION ALL SELECT fi, t, y FROM kept WHERE (fi, r) IN (SELECT fi, max(r) FROM r GROUP BY fi)")
def points_apart(spark, d):
    return enforce_distance(spark, d)


SQL["enforce_distance"], QUERIES["enforce_distance"] = SQL["points_apart"], QUERIES["points_apart"]
del SQL["points_apart"], QUERIES["points_apart"]
