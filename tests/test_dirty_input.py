"""Repeated ids, text columns, odd responses, conflicting files, failing batches."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surveyalign.functions.responses import parse_responses
from surveyalign.operators import retrieval as R
from surveyalign.operators import sampling as S
from surveyalign.operators.aggregates import column_values, feature_stats
from surveyalign.operators.filters import filter_main_modes
from surveyalign.operators.features import OrdinalEncoder
from surveyalign.operators.inference import isolated
from surveyalign.operators.joins import attach_predictions
from surveyalign.operators.medians import exact_medians
from surveyalign.operators.models import fit_mnl
from surveyalign.operators.report import comparison_table, results_frame
from surveyalign.session import materialize, release, shared_dir
from surveyalign.sources import artifacts
from verification import survey_tables as st


@pytest.mark.parametrize("rank_rows", [1_000_000, 3])
def test_quotas_hold_when_ids_repeat(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(S, "RANK_ROWS", rank_rows)
    rows = [("x", 1, i) for i in range(10)] + [(f"u{i}", 1, i) for i in range(13)] + [("-1", 2, 0)] * 40 + [(None, 3, i) for i in range(6)]
    df = materialize(spark.createDataFrame(rows, "case_id string, main_mode int, v int").repartition(3))
    sizes = {r[0]: r[1] for r in S.stratified_sample(df, 0.2).groupBy("main_mode").count().collect()}
    assert sizes == {1: 4, 2: 8, 3: 1}
    only = materialize(df.where("case_id = 'x'"))
    assert S.stratified_sample(only, 0.2).count() == 2
    split = S.split_test_pool_fewshot(df, 0.2, 0.25)
    assert split.count() == len(rows)
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("main_mode", "split").count().collect()}
    assert counts[2, "test"] == 8 and counts[2, "few_shot"] == 8 and counts[2, "pool"] == 24
    grid = S.fewshot_variants(df, ratios=[0.1, 0.25], seeds=[42, 7]).groupBy("fewshot_ratio", "seed", "main_mode", "split").count().collect()
    found = {(r[0], r[1], r[2], r[3]): r[4] for r in grid}
    for seed in (42, 7):
        assert found[0.1, seed, 2, "test"] == found[0.25, seed, 2, "test"] == 8
        assert found[0.1, seed, 2, "few_shot"] == 3 and found[0.25, seed, 2, "few_shot"] == 8


def test_variants_equal_single_splits(spark, sf_dir):
    df = st.clean_2022(spark, sf_dir)
    grid = S.fewshot_variants(df, ratios=[0.05], seeds=[42])
    single = S.split_test_pool_fewshot(df, fewshot_ratio=0.05, seed=42).select("case_id", "split")
    assert grid.select("case_id", "split").exceptAll(single).count() == 0


def test_neighbours_of_repeated_ids_are_those_of_the_rows(spark):
    memory = spark.createDataFrame([("a", [1.0, 0.0], 2011), ("a", [0.0, 1.0], 2011), ("-1", [1.0, 1.0], 2011), ("-1", [-1.0, 0.0], 2011)],
                                   "case_id string, features array<double>, survey_year int")
    queries = spark.createDataFrame([("q", [1.0, 0.1]), ("q", [-1.0, -0.1])], "case_id string, features array<double>")
    rows = R.retrieve(queries, R.build_index(memory, 4), 4).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    stored = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.0]]
    for row in rows:
        want = sorted((round(float(unit(row.features) @ unit(v)), 6) for v in stored), reverse=True)
        assert [round(n.similarity, 6) for n in row.neighbours] == want
    assert len(rows) == 2


def test_cells_without_queries_are_not_copied(spark):
    probes = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 0, "b"), (3, 0, "a")], "cell int, chunk int, query_id string")
    assert R.blocks_per_cell(probes, 5) == [0, 1, 0, 1, 0]


def test_main_modes_as_text(spark):
    df = spark.createDataFrame([("6.0",), ("n/a",), ("10",), (None,), (" 3 ",)], "Main_mode string")
    assert sorted(r[0] for r in filter_main_modes(df).collect()) == [" 3 ", "6.0"]


@pytest.mark.parametrize("text,mode,confidence,reason", [
    ("\n", -1, 0.0, "empty_response"), (" \t \n", -1, 0.0, "empty_response"), (None, -1, 0.0, "empty_response"),
    ('{"predicted_mode": 3, "predicted_mode": 5}', 5, 0.5, ""),
    ('{"predicted_mode": 3, "reason": "a, \\"b\\"", "confidence": 0.1, "predicted_mode": 5, "confidence": 0.7}', 5, 0.7, 'a, "b"'),
    ('{"predicted_mode": 3, "confidence": NaN}', 3, 1.0, ""), ('{"predicted_mode": NaN, "mode_code": 4}', 4, 0.5, ""),
    ('{"predicted_mode": 2, "confidence": -Infinity}', 2, 0.0, ""), ('{"predicted_mode": 2, "confidence": Infinity, "reason": NaN}', 2, 1.0, "nan"),
    ('so: {"mode": 1, "mode": 7} ok', 7, 0.5, ""), ('{"predicted_mode": 3 "x"', -1, 0.0, "json_decode_error"),
])
def test_odd_responses(spark, text, mode, confidence, reason):
    row = parse_responses(spark.createDataFrame([(text,)], "raw_response string")).first()
    assert (row.predicted_mode, row.confidence, row.reasoning_brief) == (mode, confidence, reason)


def test_files_that_differ_are_an_error(spark):
    files = lambda *rows: spark.createDataFrame([(f, "mnl_accuracy", v) for f, v in rows], "source_file string, metric string, value double")
    run = "mnl_ratio0.05_seed42"
    same = results_frame(files((run, 0.6), (f"{run}_copy", 0.6)), ["accuracy"]).collect()
    assert [r.accuracy for r in same] == [0.6]
    chosen = results_frame(files((run, 0.6), (f"{run}_metrics", 0.55)), ["accuracy"]).collect()
    assert [r.accuracy for r in chosen] == [0.55]
    with pytest.raises(PySparkException, match="different values"):
        results_frame(files((run, 0.6), (f"{run}_copy", 0.55)), ["accuracy"]).collect()
    twice = spark.createDataFrame([("mnl", 0.05, 42, "accuracy", 0.6), ("mnl", 0.05, 42, "accuracy", 0.5)],
                                  "model string, fewshot_ratio double, seed int, metric string, value double")
    with pytest.raises(PySparkException, match="different values"):
        comparison_table(twice).collect()


def test_two_predictions_for_one_key_are_an_error(spark):
    test = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "case_id string, x int")
    one = spark.createDataFrame([("a", 5)], "case_id string, predicted_mode int")
    assert sorted((r.case_id, r.x, r.predicted_mode) for r in attach_predictions(test, one).collect()) == [("a", 1, 5), ("a", 2, 5), ("b", 3, None)]
    with pytest.raises(PySparkException, match="several predictions"):
        attach_predictions(test, one.union(one)).collect()


def test_one_bad_row_costs_few_calls():
    calls = []

    def predictor(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("rejected")
        return ["ok"] * len(prompts)

    n = 1024
    prompts = ["good"] * n
    prompts[700] = "bad"
    responses, errors = isolated(predictor, max_retries=3, retry_delay=0.0)(prompts)
    assert [i for i, e in enumerate(errors) if e] == [700] and errors[700] == "rejected"
    assert responses.count("ok") == n - 1
    assert len(calls) <= 2 * math.log2(n) + 1 + 3
    assert isolated(predictor)([]) == ([], [])


@pytest.mark.parametrize("list_rows", [10_000, 2])
def test_medians_equal_the_built_in_one(spark, monkeypatch, list_rows):
    from surveyalign.operators import medians

    monkeypatch.setattr(medians, "LIST_ROWS", list_rows)
    monkeypatch.setattr(medians, "BINS", 7 if list_rows == 2 else 4096)
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 300):
        rows = [(float(rng.normal()) * 10.0 ** int(rng.integers(-3, 9)) if rng.random() < 0.9 else None, int(rng.integers(0, 4)), 7.0 if rng.random() < 0.5 else -7.5, None)
                for _ in range(n)]
        df = spark.createDataFrame(rows, "a double, b int, c double, d double")
        want = df.agg(*[F.median(c).alias(c) for c in "abcd"]).first().asDict()
        got = exact_medians(df, {c: F.col(c) for c in "abcd"})
        assert got.keys() == want.keys() and all(got[c] == want[c] or abs(got[c] - want[c]) <= 1e-12 * abs(want[c]) for c in "abcd" if want[c] is not None)
        assert got["d"] is None
    assert exact_medians(spark.createDataFrame([(float("nan"),), (None,)], "a double"), {"a": F.col("a")}) == {"a": None}
    huge = spark.createDataFrame([(-1.7e308,), (1.7e308,), (1.0,), (2.0,), (3.0,)], "a double")
    assert exact_medians(huge, {"a": F.col("a")}) == {"a": 2.0}


def test_statistics_need_no_percentile(spark, sf_dir):
    plan = feature_stats(st.clean(spark, sf_dir), ["journey_time", "trip_weight"])._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median(" not in plan


def test_distinct_values_are_rows(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (None,)], "m int")
    assert [(r.value, r.n) for r in column_values(df, "m").collect()] == [(None, 1), (1, 1), (2, 2)]


def test_models_encoders_and_indexes_survive_storage(spark, sf_dir):
    df = st.clean_2022(spark, sf_dir)
    model, path = fit_mnl(df.limit(400)), shared_dir(spark, "model")
    artifacts.save_model(model, spark, path)
    again = artifacts.load_model(spark, path)
    assert again.predict(df).select("case_id", "predicted_mode").exceptAll(model.predict(df).select("case_id", "predicted_mode")).count() == 0

    encoder, path = OrdinalEncoder().fit(df), shared_dir(spark, "ordinal")
    artifacts.save_ordinal_encoder(encoder, spark, path)
    assert artifacts.load_ordinal_encoder(spark, path).transform(df).exceptAll(encoder.transform(df)).count() == 0

    memory, scaler = R.build_memory(df.limit(300))
    index, path = R.build_index(memory, 3), shared_dir(spark, "index")
    artifacts.save_index(index, path)
    queries = scaler.transform(df.limit(50))
    found = [R.retrieve_topk(queries, i, 3).select("query_id", "rank", "case_id", "score") for i in (index, artifacts.load_index(spark, path))]
    assert found[0].exceptAll(found[1]).count() == 0 and found[0].count() == 150
    empty = shared_dir(spark, "index")
    artifacts.save_index(R.build_index(memory.limit(0), 3), empty)
    assert [len(r.neighbours) for r in R.retrieve(queries.limit(1), artifacts.load_index(spark, empty), 3).collect()] == [0]


def test_stored_tables_can_be_released(spark):
    df = materialize(spark.range(10), "short")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    release(df)
    assert not os.path.exists(folder)


def test_temporary_folder_is_for_one_process_only(monkeypatch):
    class Context:
        applicationId, master = "app", "local-cluster[2,1,1024]"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")


def test_tasks_import_the_package_from_anywhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from surveyalign.session import build_session\n"
            "spark = build_session(master='local[1]', **{'spark.ui.enabled': 'false'})\n"
            "def task(batches):\n    import surveyalign.operators.retrieval as r\n    yield from batches\n"
            "print('rows', spark.range(3).mapInArrow(task, 'id long').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
