import numpy as np
import pytest

from surveyalign.operators import boosting as B


def plain(x, y, weight, classes, rounds, depth, rate):
    """Softmax boosting on row sets, node by node, every value a cut point."""
    margins = np.zeros((len(x), classes))

    def grow(rows, g, h, left):
        best = (B.MIN_GAIN, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]) if left else ():
            for cut in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(h[low].sum(), h[high].sum()) >= 1:
                    gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[high].sum() ** 2 / (h[high].sum() + 1) - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, (low, high))
        if best[1] is None:
            step[rows] = -rate * g[rows].sum() / (h[rows].sum() + 1)
        else:
            for part in best[1]:
                grow(part, g, h, left - 1)

    for _ in range(rounds):
        p = B.softmax(margins)
        new = margins.copy()
        for c in range(classes):
            step = np.zeros(len(x))
            grow(np.arange(len(x)), weight * (p[:, c] - (y == c)), weight * np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16), depth)
            new[:, c] += step
        margins = new
    return B.softmax(margins)


def table(spark, x, y, weight, parts):
    rows = [([float(v) for v in r], float(c), float(w)) for r, c, w in zip(x, y, weight)]
    return spark.createDataFrame(rows, "vector array<double>, label double, weight double").repartition(parts)


def sample(seed, n=250, features=3, classes=3):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 12, (n, features)) * 1.7 - 3, axis=0)
    y = (x[:, 0] + rng.normal(size=len(x)) * 4 > x[:, 1]).astype(int) + (x[:, 2] > 9)
    return x, y % classes, rng.integers(1, 5, len(x)).astype(float)


@pytest.mark.parametrize("task_rows", [50_000, 40])
def test_equals_plain_boosting_in_any_layout(spark, monkeypatch, task_rows):
    monkeypatch.setattr(B, "TASK_ROWS", task_rows)
    monkeypatch.setattr(B, "CUT_LINEAGE", 3)
    x, y, weight = sample(1)
    trees = B.fit_softmax_trees(table(spark, x, y, weight, 3), 3, 3, rounds=7, depth=4, learning_rate=0.3)
    wanted = plain(x, y, weight, 3, 7, 4, 0.3)
    assert np.allclose(B.softmax(trees.margins(x)), wanted, atol=1e-5)
    if task_rows == 40:
        monkeypatch.setattr(B, "TASK_ROWS", 50_000)
        other = B.fit_softmax_trees(table(spark, x, y, weight, 1), 3, 3, rounds=7, depth=4, learning_rate=0.3)
        assert all(np.array_equal(getattr(trees, f), getattr(other, f)) for f in ("feature", "threshold", "value"))


def test_probabilities_round_trip_and_empty_input(spark, tmp_path):
    x, y, weight = sample(2)
    trees = B.fit_softmax_trees(table(spark, x, y, weight, 2), 3, 3, rounds=3, depth=2)
    again = B.SoftmaxTrees.from_frame(trees.to_frame(spark))
    rows = table(spark, x, y, weight, 3)
    found = rows.select("vector", again.probabilities(rows["vector"]).alias("p")).collect()
    assert all(np.allclose(r.p, B.softmax(trees.margins(np.array([r.vector])))[0]) for r in found) and len(found) == len(x)
    none = rows.limit(0)
    assert none.select(trees.probabilities(none["vector"])).collect() == []
    flat = B.fit_softmax_trees(none, 3, 3, rounds=2, depth=2)
    assert np.allclose(B.softmax(flat.margins(x)), 1 / 3)


def test_many_values_become_quantiles(spark):
    x = np.arange(4000.0)[:, None]
    rows = table(spark, x, x[:, 0] > 2500, np.ones(4000), 4)
    cuts = B.cut_points(rows, 1)[0]
    assert len(cuts) <= B.BINS and cuts[-1] == 3999 and np.diff(np.concatenate([[0], cuts])).max() <= 32
    trees = B.fit_softmax_trees(rows, 1, 2, rounds=20, depth=2, learning_rate=0.5)
    right = trees.margins(x).argmax(axis=1) == (x[:, 0] > 2500)
    assert right.mean() > 0.99


def test_rows_of_equal_bins_enter_a_tally_once(spark):
    x, y, weight = sample(3)
    x, y, weight = np.concatenate([x, x]), np.concatenate([y, (y + 1) % 3]), np.concatenate([weight, weight + 1])
    rows = table(spark, x, y, weight, 3)
    cuts = B.cut_points(rows, 3)
    sizes = [len(c) for c in cuts]
    stored = B._blocks(rows, cuts).collect()
    assert sum(len(r.bins) for r in stored) == 3 * len(np.unique(x, axis=0)) and sum(len(r.label) for r in stored) == len(x)
    bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])
    margins = np.sin(bins.T.astype(float))
    distinct, first, place = np.unique(bins.T, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(place.ravel(), kind="stable")
    block = np.ascontiguousarray(distinct.T.astype(np.uint8)), place.ravel()[order], y[order], weight[order], margins[first]
    feature, cut = np.zeros((3, 1), np.int64), np.full((3, 1), 5)
    found = dict(B._tally(sizes, feature, cut, 1)([B._gradients(sizes)(block)]))
    p, node = B.softmax(margins), (bins[0] > 5).astype(int)
    for c in range(3):
        units = [np.rint(v * weight * B.UNIT) for v in (p[:, c] - (y == c), np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16))]
        wanted = np.zeros((2, sum(sizes), 2), np.int64)
        for f in range(3):
            for i, v in enumerate(units):
                np.add.at(wanted[:, :, i], (node, sum(sizes[:f]) + bins[f]), v.astype(np.int64))
        assert np.array_equal(found[c], wanted)
    assert B._joint([3, 5, 6, 3, 5, 6, 40, 3, 5]) == [[6, 2], [5, 1, 4], [8, 0, 3, 7]]
