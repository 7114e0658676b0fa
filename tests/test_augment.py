"""Candidates' classes against plain loops."""

import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.functions import scalar
from melisma.operators import augment
from melisma.plans import catalogue

DATA = os.environ.get("MELISMA_TEST_DATA", "/root/testdata/sf0.001")
SCHEMA = "f int, t double, v array<double>, bad boolean, seed int"


def apart(t, c, weight, sure, least):
    """The ordered rule, one pair at a time."""
    c = list(c)
    for i in range(len(c)):
        if not c[i]:
            continue
        for j in range(i - 1, -1, -1):
            if t[i] - t[j] >= least:
                break
            if c[j]:
                if sure[i] and sure[j]:
                    continue
                if sure[i]:
                    c[j] = 0
                    break
                if sure[j]:
                    c[i] = 0
                    break
                if weight[j] < weight[i]:
                    c[j] = 0
                else:
                    c[i] = 0
                    break
    return c


def test_keep_apart(spark):
    rng, rows, want = random.Random(1), [], {}
    for f in range(20):
        t = sorted(rng.uniform(0, 10) for _ in range(40))
        c, w, s = [int(rng.random() < 0.6) for _ in t], [rng.choice([0.1, 0.2, 0.3]) for _ in t], [rng.random() < 0.1 for _ in t]
        c = [max(a, int(b)) for a, b in zip(c, s)]
        rows += [(f, a, b, d, 1 if e else None) for a, b, d, e in zip(t, c, w, s)]
        want |= {(f, a): k for a, k in zip(t, apart(t, c, w, s, 0.7))}
    df = spark.createDataFrame(rows, "f int, t double, class int, weight double, seed int")
    assert {(r["f"], r["t"]): r["class"] for r in augment.keep_apart(df, ["f"], 0.7).collect()} == want


def clusters(spark, n=60, unit=0):
    rng = np.random.default_rng(unit)
    rows = []
    for i in range(n):
        one = i % 5 == 0
        v = rng.normal(3.0 if one else 0.0, 0.3, 3)
        rows.append((unit, float(i), v.tolist(), False, 1 if i in (0, 5) else 0 if i in (1, 2) else None))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method, weighting", [("split", "corr"), ("seed_prct", "silhouette"), ("seed_wgt", "user"), ("seed_kmeans", "silhouette")])
@pytest.mark.parametrize("unit", [["f"], []])
def test_classes_are_found(spark, method, weighting, unit):
    df = clusters(spark).unionByName(clusters(spark, 60, 1))
    conf = {"measure": "abs", "cntr_mtd": method, "prct": 50 if method == "seed_wgt" else 80, "wgt_mtd": weighting, "min_l": 0.5}
    got = augment.classified(df, ["f"], unit, [1.0, 1.0, 1.0], conf).collect()
    assert len(got) == 120 and all(r["class"] == (r["t"] % 5 == 0) for r in got)


def test_one_seed_class(spark):
    """Without seeds of class 0 the rows near the seeds of class 1 are class 1, unless flipped."""
    df = clusters(spark).withColumn("seed", F.when(F.col("seed") == 1, 1))
    for flipped in (False, True):
        c = augment.centroids(df, ["f"], "seed_prct", 80.0, "user", [1.0] * 3, flipped).first()
        assert (np.mean(c["c1"]) > np.mean(c["c0"])) != flipped


def test_scaling_of_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 0.0, [2.0, 0.0], False, None), (0, 1.0, [-4.0, 0.0], False, None)], SCHEMA)
    assert [r["v"] for r in augment.scaled(df, ["f"]).orderBy("t").collect()] == [[0.5, 0.0], [-1.0, 0.0]]
    conf = {"measure": "abs+delta", "cntr_mtd": "seed_prct", "prct": 80, "wgt_mtd": "silhouette", "min_l": 0.5}
    assert augment.classified(df.limit(0), ["f"], ["f"], [1.0, 1.0], conf).count() == 0
    assert augment.classified(df, ["f"], ["f"], [1.0, 1.0], conf).count() == 2


def test_bad_seeds(spark):
    df = spark.createDataFrame([(0, 0.0, [1.0], True, 1), (0, 1.0, [1.0], False, 1), (0, 2.0, [1.0], False, 1)], SCHEMA)
    seeds = lambda m: [r["seed"] for r in augment.drop_bad_seeds(df, ["f"], m).orderBy("t").collect()]
    assert seeds("abs") == [None, 1, 1] and seeds("delta") == [None, None, 1]


def test_gap_seeds_on_their_limits(spark):
    """Lengths and gaps are those of the segments themselves: 11.85 - 8.05 is just below 3.8, 20.0 - 16.2 just above."""
    df = spark.createDataFrame([(0, 8.05, 11.85), (0, 12.0, 16.0), (0, 16.2, 20.0), (0, 20.1, 25.0), (0, 25.3, 30.0), (0, 30.1, 35.0)], "f int, on double, off double")
    got = sorted((r["t"], r["seed"]) for r in augment.gap_seeds(df, ["f"], 3.8, 0.22).collect())
    assert got == [(11.85, 0), (16.0, None), (20.0, None), (25.0, 1), (30.0, None)]
    got = sorted((r["t"], r["seed"]) for r in augment.gap_seeds(df, ["f"]).collect())
    assert got == [(11.85, 1), (16.0, 1), (20.0, 1), (25.0, 1), (30.0, 1)]


def test_seed_limit_between_near_equal_distances(spark):
    """Distances from the seed 1 that differ in the last digit, 0.6 of the way from the 50th to the 51st of 63."""
    far = [11.99584198795566, 11.995841987955657]
    x = [20.0 + k for k in range(49)] + far + [1.0 + 0.1 * k for k in range(11)] + [0.0]
    df = spark.createDataFrame([(0, float(i), [v], False, 1 if v == 0 else None) for i, v in enumerate(x)], SCHEMA)
    c = augment.centroids(df, ["f"], "seed_prct", 80.0, "user", [1.0]).first()
    assert c["c0"] == [float(np.median(x[:50]))] and c["c1"] == [float(np.median(x[50:]))]


def test_fused_percentile(spark):
    """Against one rounding less by fractions; of one, no and equal elements."""
    rng = np.random.default_rng(7)
    arrays = [sorted(rng.normal(0, 9, n).tolist()) for n in rng.integers(1, 40, 200)] + [[0.1] * 9, [2.5], []]
    df = spark.createDataFrame(list(enumerate(arrays)), "k int, a array<double>")
    got = {r["k"]: r["p"] for r in df.select("k", scalar.fused_percentile(F.col("a"), 80.0).alias("p")).collect()}
    for k, a in enumerate(arrays):
        at = (len(a) - 1) * 0.8
        low, step = int(at // 1), at % 1
        assert got[k] == (float(Fraction(a[low]) * Fraction(1 - step) + Fraction(a[low + 1] * step)) if a and step else a[low] if a else None)


def test_minmax_seeds_of_equal_sums(spark):
    """Tenths in units of 21 rows, where many sums are equal, against fractions."""
    def between(x, percent):
        x, at = sorted(x), Fraction((len(x) - 1) * percent, 100)
        low = int(at)
        return x[low] + (at - low) * (x[min(low + 1, len(x) - 1)] - x[low])

    rng, rows, want = random.Random(3), [], {}
    for f in range(100):
        x = [[rng.randint(-9, 9) for _ in range(3)] for _ in range(21)]
        cols = [[Fraction(abs(v), 10) for v in c] for c in zip(*x)]
        sums = [sum(r) for r in zip(*([(v - between(c, 50)) / (between(c, 75) - between(c, 25) or 1) for v in c] for c in cols))]
        low, high = between(sums, 10), between(sums, 90)
        rows += [(f, float(t), [a / 10 for a in v], False, None) for t, v in enumerate(x)]
        want |= {(f, float(t)): 1 if s >= high else 0 if s <= low else None for t, s in enumerate(sums)}
    got = {(r["f"], r["t"]): r["seed"] for r in augment.minmax_seeds(spark.createDataFrame(rows, SCHEMA), ["f"]).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["gap_seeds"])
def test_nulls_where_the_sql_has_them(spark, name):
    """Row by row; pandas' nullable integers let a null pass for any number."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    rows = catalogue.QUERIES[name](spark, DATA)
    want = c.execute(f"SELECT {', '.join(rows.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))
