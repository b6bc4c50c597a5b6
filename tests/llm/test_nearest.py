import math

import numpy as np
import pytest

from surveyalign.llm import nearest as N


def usable(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows, queries, k):
    """All pairs in double precision; a query's own row goes once."""
    good = [(i, np.array(v, float)) for i, v in rows if usable(v)]
    out = []
    for q, v in queries:
        if not usable(v):
            continue
        v = np.array(v, float)
        found = [(-float((x * v).sum()), i is None, i if i is not None else 0) for i, x in good if len(x) == len(v)]
        mine = next((n for n, (i, x) in enumerate((i, x) for i, x in good if len(x) == len(v)) if i == q and np.array_equal(x, v)), None)
        if mine is not None:
            del found[mine]
        found.sort()
        out += [(q, r + 1, None if no else i, -s) for r, (s, no, i) in enumerate(found[:k])]
    return out


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 3, "n") for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, node string").repartition(4)


def answer(spark, rows, queries, k=5):
    found = N.search(N.build_index(table(spark, rows), k), table(spark, queries)).collect()
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found), key=str)


def clustered(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(i, (centres[rng.integers(20)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)]


def recall(found, wanted):
    mine = {(q, i) for q, _, i, _ in found}
    return len(mine & {(q, i) for q, _, i, _ in wanted}) / len(wanted)


@pytest.mark.parametrize("shard, block", [(8192, 2048), (64, 8)])
def test_recall_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(N, "SHARD", shard)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = clustered(shard)
    queries = rows[::20]
    found, wanted = answer(spark, rows, queries), brute(rows, queries, 5)
    assert recall(found, wanted) >= 0.97
    place = {(q, r): s for q, r, _, s in wanted}
    assert len(found) == len(wanted)
    exact = {(q, i): s for q, _, i, s in brute(rows, queries, len(rows))}
    assert all(s == exact[q, i] and s <= place[q, r] for q, r, i, s in found)


def test_given_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in N.search(N.build_index(source), source.where("vec_id % 20 = 0")).collect()]
    wanted = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert len(found) == len(wanted) and recall(found, wanted) >= 0.97


def test_few_candidates_ties_repeats_and_odd_rows(spark):
    odd = [(90, None), (91, [None, 1.0]), (92, [math.nan, 1.0]), (93, [math.inf, 1.0]), (94, []), (95, [0.0, -0.0]), (96, [5.0])]
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 5.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [0.0, 1.0]), (9, [-0.0, 1.0])] + odd
    queries = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (8, [0.0, 1.0]), (96, [5.0]), (97, [1.0, 2.0, 3.0])] + odd[:6]
    for k in (2, 20):
        assert answer(spark, rows, queries, k) == sorted(brute(rows, queries, k), key=str)
    assert answer(spark, rows, [], 5) == [] and answer(spark, [], queries, 5) == []


def test_copies_are_one_class(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, [2.0, float(i)]) for i in range(3)]
    queries = rows[::20] + rows[-3:]
    index = N.build_index(table(spark, rows), 5)
    assert index.classes.count() == 4 and all(len(r.ids) <= 6 for r in index.classes.collect())
    assert answer(spark, rows, queries) == sorted(brute(rows, queries, 5), key=str)


def test_extreme_magnitudes_keep_their_order(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 1e200]), (3, [-1e200, 1e200]), (4, [1.0, 1e-3])]
    found = answer(spark, rows, [(9, [1e200, 1e200]), (10, [1e-200, 2e-200])])
    assert [i for q, _, i, _ in found if q == 9] == [2, 1, 4, 3]
    assert [s for q, _, i, s in found if q == 9][:2] == [math.inf, math.inf]
    assert [i for q, _, i, _ in found if q == 10] == [2, 1, 3, 4]


def test_threshold_and_windows():
    needed = N.collisions_needed()
    rng = np.random.default_rng(0)
    for dim in (2, 64):
        vectors = rng.normal(size=(300, dim))
        shard = N.Shard(vectors, np.linalg.norm(vectors, axis=1).max() * (1 + 1e-9))
        low, high = shard._windows(np.zeros((1, N.LINES)), np.array([[0.5, np.inf]]))
        assert ((high - low)[0, 1] == 300).all()
        near = np.abs(np.hstack([vectors, np.sqrt(shard.longest ** 2 - (vectors ** 2).sum(axis=1))[:, None]]) @ shard.lines) <= 0.5
        assert (shard._inside(low[0, 0], high[0, 0]) == near.sum(axis=1)).all()
        for t in range(N.LINES):
            assert set(shard.order[t, low[0, 0, t]:high[0, 0, t]]) == set(np.flatnonzero(near[:, t]))
    lines = rng.normal(size=(20_000, N.LINES))
    assert ((np.abs(lines) <= N.WIDTH).sum(axis=1) >= needed).mean() >= 1 - 1.5 * N.MISS
