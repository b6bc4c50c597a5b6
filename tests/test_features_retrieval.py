"""Encoders, exact retrieval against brute force, prototypes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.vectors import cosine
from surveyalign.operators import prototypes as P
from surveyalign.operators import retrieval as R
from surveyalign.operators.features import OrdinalEncoder, TabularEncoder
from surveyalign.session import shared_dir
from surveyalign.sources import artifacts
from surveyalign.streaming.memory_feed import feed_memory
from verification import survey_tables as st


def test_encoder_matches_numpy(spark):
    rows = [(1, 10.0, "3"), (None, None, "x"), (-1, 40.0, "5"), (2, float("nan"), None)]
    df = spark.createDataFrame(rows, "age_group int, journey_time double, origin_zone string")
    features = ["age_group", "journey_time", "origin_zone_int", "hh_size"]
    encoder = TabularEncoder.fit(df, features)
    raw = np.array([[1, 10, 3, 0], [0, 25, 0, 0], [0, 40, 5, 0], [2, 25, 0, 0]], dtype=float)
    std = raw.std(axis=0)
    expected = (raw - raw.mean(axis=0)) / np.where(std == 0, 1, std)
    got = np.array([r[0] for r in encoder.transform(df).select("features").collect()])
    assert got == pytest.approx(expected)
    again = TabularEncoder.from_frame(encoder.to_frame(spark))
    assert again == encoder


def test_encoder_uses_the_fitted_medians(spark):
    fit = spark.createDataFrame([(1.0,), (3.0,), (8.0,)], "journey_time double")
    encoder = TabularEncoder.fit(fit, ["journey_time"])
    value = encoder.transform(spark.createDataFrame([(None,)], "journey_time double")).first()["features"][0]
    assert value == pytest.approx((3 - 4) / np.std([1, 3, 8]))


def test_ordinal_codes_sort_as_text(spark):
    fit = spark.createDataFrame([(10,), (2,), (None,)], "age_group int")
    encoder = OrdinalEncoder(["age_group", "absent"]).fit(fit)
    df = spark.createDataFrame([(0, None), (1, 10), (2, 2), (3, 99)], "i int, age_group int")
    assert [r[0] for r in encoder.transform(df).orderBy("i").select("age_group").collect()] == [0, 1, 2, 0]


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def _frame(spark, vectors, prefix, years=None):
    rows = [(f"{prefix}{i:05d}", [float(x) for x in v], int(years[i]) if years is not None else 2011) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "case_id string, features array<double>, survey_year int")


def _brute_force(queries, stored, ids, years, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    similarity = np.round(unit(queries) @ unit(stored).T, 10)
    score = np.round(0.5 * similarity + np.where(years >= 2022, 0.5, 0.35), 12)
    return [[ids[j] for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j]))[:k]] for row in score]


TINY = {"CELL_CHUNK": 7, "QUERY_BLOCK": 11, "SAMPLE": 16, "SLAB": 50, "PER_PIVOT": 4}


@pytest.mark.parametrize("limits", [{}, TINY, {**TINY, "MAX_PIVOTS": 3, "CELL_ROWS": 12}])
def test_retrieval_equals_brute_force(spark, monkeypatch, limits):
    """With ties, repeated vectors, zero vectors and both years; then with tiny blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(3)
    stored = rng.integers(-1, 2, size=(400, 3)).astype(float)
    stored[:150] = stored[0]
    stored = np.vstack([stored, rng.normal(size=(200, 3)), np.zeros((2, 3))])
    queries = np.vstack([rng.integers(-1, 2, size=(30, 3)), rng.normal(size=(40, 3)), np.zeros((1, 3))]).astype(float)
    years = rng.choice([2011, 2022], size=len(stored))
    memory = _frame(spark, stored, "c", years)
    found = R.retrieve_topk(_frame(spark, queries, "q"), R.build_index(memory, 5), 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.case_id)
    expected = _brute_force(queries, stored, [f"c{i:05d}" for i in range(len(stored))], years, 5)
    assert [got[f"q{i:05d}"] for i in range(len(queries))] == expected


@pytest.mark.parametrize("limits", [{}, {**TINY, "MAX_PIVOTS": 4, "CELL_ROWS": 20, "REGROWN": 1.5}])
def test_appended_index_equals_a_rebuilt_one(spark, monkeypatch, limits):
    """Three generations with repeated vectors, a row that comes twice, zero vectors, and cells that outgrow their division."""
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(11)
    stored = np.vstack([rng.integers(-1, 2, size=(120, 3)).astype(float), rng.normal(size=(400, 3)), np.zeros((20, 3))])[rng.permutation(540)]
    years = rng.choice([2011, 2022], size=len(stored))
    memory, queries = _frame(spark, stored, "c", years), _frame(spark, rng.normal(size=(40, 3)), "q")
    cuts = ["c00000", "c00150", "c00200", "c00539"]
    index = R.build_index(memory.where(f"case_id <= '{cuts[1]}'"), 5)
    placed = index.cells.count()
    for low, high in zip(cuts[1:], cuts[2:]):
        index = R.append_index(index, memory.where(f"case_id > '{low}' AND case_id <= '{high}'"))
        assert index.cells.count() > placed
        placed = index.cells.count()
    path = shared_dir(spark, "appended")
    artifacts.save_index(index, path)
    index = artifacts.load_index(spark, path)
    assert index.generation == 2 and (index.subcells is not None) == bool(limits)
    answer = lambda i: sorted((r.query_id, r["rank"], r.case_id, r.score) for r in R.retrieve_topk(queries, i, 5).collect())
    assert answer(index) == answer(R.build_index(memory, 5))
    twice = R.append_index(index, memory.where("case_id = 'c00001'"))
    again = R.retrieve_topk(memory.where("case_id = 'c00001'").withColumn("case_id", F.lit("q")), twice, 2).collect()
    assert [r.score for r in again][0] == max(r.score for r in again) and len(again) == 2
    started = R.append_index(R.build_index(memory.where("false"), 5), memory)
    assert answer(started) == answer(index)


def test_vectors_compared_per_query_grow_slower_than_the_memory(spark, monkeypatch):
    for name, value in {"MAX_PIVOTS": 8, "CELL_ROWS": 50, "SAMPLE": 256}.items():
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(5)
    stored = rng.normal(size=(8000, 3))
    queries = _frame(spark, rng.normal(size=(30, 3)), "q").withColumnRenamed("case_id", "query_id")
    compared = []
    for n in (1000, 8000):
        index = R.build_index(_frame(spark, stored[:n], "c"), 3)
        sizes = index.cells.groupBy("cell", "chunk").agg(F.count("*").alias("n"))
        looks = R.visits(queries, index, 3).join(sizes, ["cell", "chunk"])
        compared.append(looks.agg(F.sum("n")).first()[0] + index.subcells.count())
    assert compared[1] < 0.6 * 8 * compared[0]


def test_retrieval_from_a_memory_smaller_than_k(spark):
    memory = _frame(spark, [[1, 0], [0, 1]], "c")
    found = R.retrieve_topk(_frame(spark, [[1, 1]], "q"), R.build_index(memory, 8), 8)
    assert [(r.rank, r.case_id) for r in found.orderBy("rank").collect()] == [(1, "c00000"), (2, "c00001")]


def test_empty_memory_finds_nothing(spark):
    memory = _frame(spark, [[1, 0]], "c").where("false")
    found = R.retrieve(_frame(spark, [[1, 1]], "q"), R.build_index(memory, 8), 8).collect()
    assert [r.neighbours for r in found] == [[]]


def test_repeated_vectors_are_limited_before_the_shuffle(spark, sf_dir):
    scored = st.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey query_id", "l_orderkey case_id", "l_extendedprice score")
    plan = R.topk_per_query(scored, 8)._jdf.queryExecution().executedPlan().toString()
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert len(limits) == 2 and plan.index("Partial") > plan.index("Exchange")


def test_search_sends_queries_to_few_cells(spark, sf_dir):
    memory, encoder = R.build_memory(st.clean_2011(spark, sf_dir))
    index = R.build_index(memory, 4)
    queries = encoder.transform(st.clean_2022(spark, sf_dir)).select(F.col("case_id").alias("query_id"), "features")
    visits = queries.mapInArrow(R._probe(index, 4), "cell int, chunk int, query_id string, features array<double>")
    assert visits.count() < 0.25 * queries.count() * index.n_pivots


def test_best_k_ties_go_to_the_first_column():
    scores = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    rows, cols = R.best_k(scores, 2)
    assert rows.tolist() == [0, 0, 1, 1] and cols.tolist() == [1, 2, 0, 1]


def test_shift_of_a_missing_year(spark):
    df = spark.createDataFrame([(2022,), (2023,), (2011,), (None,)], "y int")
    assert [r[0] for r in df.select(R.shift_score(F.col("y"))).collect()] == [1.0, 1.0, 0.5, 0.5]


def test_latest_error_wins(spark):
    old = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "g string, error double")
    new = spark.createDataFrame([("b", 0.9), ("c", 0.3)], "g string, error double")
    assert {r.g: r.error for r in R.upsert_subgroup_errors(old, new, ["g"]).collect()} == {"a": 0.1, "b": 0.9, "c": 0.3}


def test_appending_needs_the_encoder(spark):
    memory = _frame(spark, [[1, 0]], "c")
    with pytest.raises(ValueError):
        R.update_memory(memory, memory)


def test_kmeans_finds_separate_groups_and_is_repeatable(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(c, 0.05, size=(60, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = _frame(spark, points, "p")
    first, second = P.kmeans(df, 3, restarts=3), P.kmeans(df, 3, restarts=3)
    assert np.allclose(sorted(first.centers), sorted(second.centers))
    sizes = P.assign_prototype(df, first).groupBy("prototype_id").count().collect()
    assert sorted(r[1] for r in sizes) == [60, 60, 60]


def test_prototypes_survive_storage(spark, sf_dir):
    past = st.clean_2011(spark, sf_dir)
    memory = P.build_prototypes(past, k=4, restarts=2)
    path = shared_dir(spark, "prototypes")
    artifacts.save_prototypes(memory, path)
    loaded = artifacts.load_prototypes(spark, path)
    encoded = memory.encoder.transform(past)
    ids = lambda m: {r.case_id: r.prototype_id for r in P.attach_prototype(encoded, m).collect()}
    assert ids(memory) == ids(loaded)
    total = memory.prototypes.agg(F.sum("n_samples")).first()[0]
    assert total == past.count()
    for row in memory.prototypes.collect():
        assert sum(row.mode_share.values()) == pytest.approx(1.0)
        assert row.summary.startswith(f"Behavioral Group {row.prototype_id}: {row.semantic_label}\n  Size: ")


def test_label_rounds_half_to_even(spark):
    from surveyalign.functions.text import prototype_label

    df = spark.createDataFrame([(2.5, 3.5, 0.5)], "a double, e double, c double")
    assert df.select(prototype_label(F.col("a"), F.col("e"), F.col("c"))).first()[0] == "15-24 Student (No car)"


def test_stream_feeds_the_memory_once(spark, sf_dir):
    past = st.clean_2011(spark, sf_dir)
    memory, encoder = R.build_memory(past)
    path, source = shared_dir(spark, "fed"), shared_dir(spark, "incoming")
    st.clean_2022(spark, sf_dir).write.parquet(source)
    for _ in range(2):
        trips = spark.readStream.schema(past.schema).parquet(source)
        feed_memory(trips, encoder, f"{path}/memory", f"{path}/progress").awaitTermination(120)
    assert spark.read.parquet(f"{path}/memory").count() == st.clean_2022(spark, sf_dir).count()
