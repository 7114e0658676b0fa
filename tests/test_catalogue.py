"""Every query against its SQL, and the operators that SQL doesn't cover."""

import os

import duckdb
import numpy as np
import pytest

from melisma.operators import classify, interval
from melisma.plans import catalogue

DATA = os.environ.get("MELISMA_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(4, 0.1, (20, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    got = {r["k"]: r["class"] for r in classify.kmeans(df, "k", "v", [x[0].tolist(), x[1].tolist()]).collect()}
    assert len({got[i] for i in range(20)}) == 1 and len({got[i] for i in range(20, 40)}) == 1 and got[0] != got[30]


def test_kmeans_runs_until_centres_rest(spark):
    """Rows on a line from poor first centres: more than 20 rounds, against numpy."""
    x = np.random.default_rng(5).random((400, 1))
    x = x[np.argsort(x[:, 0])]
    now, turns = x[:5], 0
    while True:
        own = np.abs(x - now[:, 0]).argmin(1)
        new = np.array([x[own == c].mean(0) for c in range(5)])
        turns += 1
        if np.abs(new - now).max() < 1e-9:
            break
        now = new
    assert turns > 22
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    got = sorted(classify.kmeans(df, "k", "v", x[:5].tolist()).collect())
    assert [r["class"] for r in got] == own.tolist()
    with pytest.warns(UserWarning, match="still move"):
        classify.kmeans(df, "k", "v", x[:5].tolist(), rounds=2)


def test_mean_shift_moves_modes_against_all_rows(spark):
    """Beyond 1,000 rows, with a cluster of three rows, against one seed at a time."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (1500, 2)), rng.normal([6, 0], 1, (700, 2)), rng.normal([0, 40], 0.1, (3, 2)), rng.normal([40, 0], 0.1, (2, 2))])
    ends = []
    for m in x:
        for _ in range(300):
            inside = x[np.linalg.norm(x - m, axis=1) <= 2.0]
            old, m = m, inside.mean(0)
            if np.linalg.norm(m - old) <= 2e-3:
                break
        ends.append((len(inside), tuple(m)))
    modes = []
    for _, m in sorted(set(ends), reverse=True):
        if all(np.linalg.norm(np.subtract(m, k)) > 2.0 for k in modes):
            modes.append(m)
    far = np.linalg.norm(x[:, None] - np.array(modes), axis=2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>").repartition(5)
    got = sorted(classify.mean_shift(df, "k", "v", 2.0).collect())
    assert [r["class"] for r in got] == far.argmin(1).tolist()
    assert np.allclose([r["dist"] for r in got], far.min(1))


def test_enforce_distance(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 0.5, 3.0), (0, 1.2, 2.0), (0, 3.0, 1.0), (1, 0.0, 1.0)], "f int, t double, s double")
    got = sorted((r["f"], r["t"]) for r in classify.enforce_distance(df, ["f"], "t", "s", 1.0).collect())
    assert got == [(0, 0.5), (0, 3.0), (1, 0.0)]


def test_sync_and_gaps(spark):
    spans = spark.createDataFrame([(0, 0.0, 1.0), (0, 0.2, 0.9), (0, 0.5, 2.0), (0, 5.0, 6.0)], "f int, a double, b double")
    centers = spark.createDataFrame([(0, 0.6), (0, 0.8)], "f int, t double")
    got = sorted((r["a"], r["b"]) for r in interval.sync_centers(spans, centers, ["f"], "a", "b", "t").collect())
    assert got == [(0.0, 1.0), (0.2, 0.9)]
    items = spark.createDataFrame([(0, 1.0, 2.0, "x"), (0, 3.0, 4.0, "y")], "f int, a double, b double, l string")
    from pyspark.sql import functions as F

    filled = sorted((r["a"], r["b"], r["l"]) for r in interval.fill_gaps(items, ["f"], "a", "b", "l", F.lit(5.0), "_").collect())
    assert filled == [(0.0, 1.0, "_"), (1.0, 2.0, "x"), (2.0, 3.0, "_"), (3.0, 4.0, "y"), (4.0, 5.0, "_")]
