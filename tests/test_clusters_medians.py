"""Joint k-means runs and exact medians."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyalign.operators import medians as M
from surveyalign.operators import prototypes as P


def _frame(spark, points, parts=3):
    return spark.createDataFrame([([float(x) for x in p],) for p in points], "features array<double>").repartition(parts)


def _inertia(points, centers):
    return ((points[:, None, :] - np.array(centers)[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_runs_end_at_means_and_beat_the_library(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(900, 3)) + rng.integers(0, 6, size=(900, 1)) * 2, 1)
    df = _frame(spark, points)
    found = P.kmeans(df, 7, restarts=6)
    assert found.inertia == pytest.approx(_inertia(points, found.centers))
    near = ((points[:, None, :] - np.array(found.centers)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert all(np.linalg.norm(points[near == c].mean(axis=0) - found.centers[c]) <= 0.003 + 1e-9 for c in range(7))
    rows = df.select(array_to_vector("features").alias("features"))
    theirs = min(KMeans(k=7, seed=s, tol=0.003).fit(rows).summary.trainingCost for s in range(6))
    assert found.inertia <= theirs * 1.02


def test_layout_and_repeats_do_not_matter(spark, monkeypatch):
    points = np.random.default_rng(3).integers(0, 5, size=(400, 2)).astype(float)
    first = P.kmeans(_frame(spark, points, 1), 4, restarts=3)
    monkeypatch.setattr(P, "TASK_ROWS", 1)
    second = P.kmeans(_frame(spark, np.vstack([points]), 5), 4, restarts=3)
    assert np.allclose(first.centers, second.centers, atol=1e-6) and first.inertia == pytest.approx(second.inertia)


def test_fewer_points_than_centres_and_no_points(spark):
    found = P.kmeans(_frame(spark, [[0.0], [1.0]]), 4, restarts=2)
    assert found.inertia == 0 and len(found.centers) == 4
    with pytest.raises(ValueError):
        P.kmeans(_frame(spark, [[0.0]]).where("false"), 2)


def test_medians_equal_numpy_and_take_two_scans(spark, monkeypatch):
    rng = np.random.default_rng(4)
    columns = {"code": rng.integers(0, 5, 4001), "even": np.arange(4001.0), "wide": rng.normal(size=4001) * 10.0 ** rng.integers(-200, 200, 4001),
               "half": np.where(np.arange(4001) < 2000, -1.0, 1.0), "ends": np.where(rng.random(4001) < 0.5, -np.inf, np.inf)}
    rows = [[float(c[i]) if i % 7 or name != "code" else None for name, c in columns.items()] for i in range(4001)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6).cache()
    jobs = []
    plain = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: jobs.append(1) or plain(self))
    found = M.exact_medians(df, {c: F.col(c) for c in columns})
    assert len(jobs) <= 2
    for c in columns:
        values = np.sort([r[list(columns).index(c)] for r in rows if r[list(columns).index(c)] is not None])
        assert found[c] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


@pytest.mark.parametrize("bracket", [0.0, 0.4])
def test_a_bracket_that_misses_or_is_wide_does_not_matter(spark, monkeypatch, bracket):
    monkeypatch.setattr(M, "BRACKET", bracket)
    monkeypatch.setattr(M, "ACCURACY", 2)
    monkeypatch.setattr(M, "LIST_ROWS", 20)
    monkeypatch.setattr(M, "BINS", 16)
    values = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(float(v), None) for v in values], "a double, b double").repartition(5)
    assert M.exact_medians(df, {"a": F.col("a"), "b": F.col("b")}) == {"a": np.median(values), "b": None}
