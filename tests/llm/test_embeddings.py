import math

import numpy as np
import pytest

from surveyalign.llm import embeddings as E
from test_minhash import components


def corpus(seed, dim=16, n=160):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] * rng.uniform(0.2, 5) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], 9), (n + 3, rows[1][1], None), (n + 4, None, 1), (n + 5, [0.0] * dim, 1),
             (n + 6, [math.nan] + [1.0] * (dim - 1), 1), (n + 7, [None] + [1.0] * (dim - 1), 1), (n + 8, [math.inf] + [1.0] * (dim - 1), 1), (n + 9, [], 1), (n + 10, [1.0], 1)]
    return rows


def good(v, label):
    return label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold):
    links, count = [], {r[0]: 0 for r in rows}
    for k, (a, x, p) in enumerate(rows):
        for b, y, q in rows[k + 1:]:
            if good(x, p) and good(y, q) and p == q and len(x) == len(y) and np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= threshold:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    return count, components([r[0] for r in rows], links)


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rows = corpus(tile)
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string").repartition(4)
    found = E.near_duplicate_vectors(vectors, 0.93).collect()
    count, component = brute(rows, 0.93)
    assert {r.vec_id: r.n_links for r in found} == count
    assert {r.vec_id: r.component_id for r in found} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert E.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_no_pair_above_the_threshold_is_ruled_out():
    rng = np.random.default_rng(3)
    for dim in (2, 64, 1500):
        base = rng.normal(size=dim)
        v = np.stack([base + rng.normal(size=dim) * s for s in np.linspace(0.001, 1.2, 120)])
        v[5] = v[5] * 0 + np.eye(dim)[0]
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        rows = np.arange(len(unit))
        a, b = E.possible_pairs(unit, rows, rows, 0.93)
        possible = set(zip(a.tolist(), b.tolist()))
        cosine = unit @ unit.T
        assert {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.93))} <= possible
        assert all(cosine[i, j] > 0.85 for i, j in possible)


def test_repeated_rows_count_each(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (4, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    rows = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in E.near_duplicate_vectors(vectors).collect())
    assert rows == [("1", 2, "1", True), ("1", 2, "1", True), ("4", 0, "4", True), ("None", 2, "1", False)]


def test_extreme_magnitudes_link_like_others(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.1e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 0.0], 1), (5, [1.0, 1.0], 1), (6, [-1e308, 1e308], 1)]
    found = E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6)}
