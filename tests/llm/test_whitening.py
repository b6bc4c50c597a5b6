import math

import numpy as np
import pytest

from surveyalign.llm import whitening as W


def brute(rows, components=32, once=False):
    """By plain numpy over exact whole numbers; rows are (id, vector)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0) if once else x
    n, total = len(fit), fit.sum(axis=0)
    away = (fit * n - total) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-values)[:components]
    out = ((x * n - total) / n) @ vectors[:, order] / np.sqrt(values[order])
    return [i for i, _ in good], n, ((x * n - total) ** 2).sum(axis=1), out, values[order] / values.sum()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1.5) for i, v in rows], "vec_id long, embedding array<float>, x string, size double").repartition(5)


def sample(seed=1, n=300, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=dim) * [3, 2, 1, 1, 0.5, 0.2][:dim]]) for i in range(n)]
    return rows + [(n + k, rows[0][1]) for k in range(150)]


def compare(found, rows, components=32, once=False):
    ids, n, deviation, values, explained = brute(rows, components, once)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(got) == len(found) == len(ids) * len(explained)
    for k in range(len(explained)):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ values[:, k])
        assert np.allclose(mine * sign, values[:, k], atol=1e-8)
        assert all(math.isclose(got[i, k + 1].explained, explained[k], rel_tol=1e-9) for i in ids)
    assert all(got[i, 1].deviation == d and got[i, 1].n == n for i, d in zip(ids, deviation.tolist()))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


@pytest.mark.parametrize("hot", [1000, 2])
def test_equals_numpy(spark, monkeypatch, hot):
    monkeypatch.setattr(W, "HOT_CLASSES", hot)
    rows = sample()
    odd = [(9001, None), (9002, [None] * 6), (9003, [math.nan] + [0.0] * 5), (9004, [math.inf] + [0.0] * 5), (9005, [])]
    compare(W.whiten(table(spark, rows + odd)).collect(), rows)
    compare(W.whiten(table(spark, rows), components=2, weights="one").collect(), rows, 2, True)


def test_given_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    compare(W.whiten(vectors).collect(), rows)


def test_far_off_data_keep_their_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=3) + 1e11]) for i in range(100)]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    compare(W.whiten(source).collect(), rows)


def test_sums_and_deviation_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])]
    found = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 6 and all((r.deviation is None) == (r.vec_id < 3) and r.n == 3 for r in found)
    x = np.array([[2 ** 61, 0], [-2 ** 61, 0]])
    assert W._deviation(x, 3, (0, 0)) == [(3 * 2 ** 61) ** 2] * 2


def test_components_without_variance(spark):
    found = W.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0]), (None, [3.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.component: r.whitened is None for r in found} == {1: False, 2: True} and len(found) == 6
    assert found[0].identity_error < 1e-12
    one = W.whiten(spark.createDataFrame([(1, [1.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 2


def test_lengths_apart_and_empty_table(spark):
    rows = sample(7, 40)
    short = [(5000 + i, [float(i % 7), float(i * i % 11)]) for i in range(40)]
    found = W.whiten(table(spark, rows + short)).collect()
    compare([r for r in found if r.vec_id < 5000], rows)
    compare([r for r in found if r.vec_id >= 5000], short)
    assert W.whiten(table(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        W.whiten(table(spark, rows), weights="two")
