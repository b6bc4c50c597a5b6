"""Scores on hand-made cases, response parsing, batch inference, models."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.responses import parse_responses
from surveyalign.functions.text import examples_text
from surveyalign.functions.vectors import align_proba, argmax_class
from surveyalign.operators import aggregates, inference, metrics, models, sampling
from surveyalign.plans.evidence import run_evidence
from verification import survey_tables as st


def predictions(spark, rows):
    return spark.createDataFrame(rows, "main_mode int, predicted_mode int, trip_weight double")


def test_weighted_shares(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0)], "main_mode int, trip_weight double")
    shares = {r.mode: r.share for r in aggregates.mode_shares(df, weight="trip_weight").collect()}
    assert shares[1] == 0.75 and shares[2] == 0.25 and shares[9] == 0.0


def test_disjoint_shares_have_the_largest_distance(spark):
    cube = metrics.confusion_cube(predictions(spark, [(1, 2, 1.0)] * 4))
    row = metrics.macro_metrics(cube).first()
    assert row.mode_share_js == pytest.approx(math.sqrt(math.log(2)), abs=1e-4)
    assert row.mode_share_mae == pytest.approx(2 / 9)


def test_equal_shares_have_no_distance(spark):
    row = metrics.macro_metrics(metrics.confusion_cube(predictions(spark, [(1, 2, 1.0), (2, 1, 1.0)]))).first()
    assert row.mode_share_js == pytest.approx(0, abs=1e-7) and row.mode_share_mae == 0


def test_distance_is_symmetric(spark):
    rows = [(1, 2, 1.0), (1, 1, 1.0), (3, 2, 1.0), (4, 4, 1.0)]
    forward = metrics.macro_metrics(metrics.confusion_cube(predictions(spark, rows))).first()
    swapped = metrics.macro_metrics(metrics.confusion_cube(predictions(spark, [(p, t, w) for t, p, w in rows]))).first()
    assert forward.mode_share_js == pytest.approx(swapped.mode_share_js)


def test_macro_f1_counts_labels_that_are_only_predicted(spark):
    cube = metrics.confusion_counts(predictions(spark, [(1, 1, 1.0), (1, 2, 1.0)]))
    row = metrics.micro_metrics(cube).first()
    assert row.accuracy == 0.5 and row.macro_f1 == pytest.approx((2 / 3 + 0) / 2) and row.weighted_f1 == pytest.approx(2 / 3)
    names = {r.metric for r in metrics.evaluate_micro(cube).collect()}
    assert "f1_Rail" in names and "f1_LRT" not in names


def test_evaluation_does_not_depend_on_partitioning(spark, sf_dir):
    df = st.predictions(spark, sf_dir).withColumns({"model": F.lit("m"), "fewshot_ratio": F.lit(0.1), "seed": F.lit(1)})
    values = lambda d: {r.metric: r.value for r in metrics.evaluate_all(d)[0].collect()}
    one, two = values(df), values(df.repartition(13))
    assert one.keys() == two.keys() and all(one[m] == pytest.approx(two[m], abs=1e-12) for m in one)


def test_probabilities_follow_the_models_classes(spark):
    df = spark.createDataFrame([([7, 2], [0.3, 0.1], 7), ([1], [0.0], 1)], "classes array<int>, proba array<double>, main_mode int")
    rows = align_proba(df).select("aligned", argmax_class(F.col("classes"), F.col("proba"))).collect()
    assert rows[0][0] == pytest.approx([0, 0.25, 0, 0, 0, 0, 0.75, 0, 0]) and rows[0][1] == 7
    assert rows[1][0] == [0.0] * 9
    scored = metrics.probability_metrics(df.where("main_mode = 7")).first()
    assert scored.nll == pytest.approx(-math.log(0.75)) and scored.brier_score == pytest.approx(2 * 0.25 ** 2)


def test_impossible_truth_is_clipped(spark):
    df = spark.createDataFrame([([1], [1.0], 2)], "classes array<int>, proba array<double>, main_mode int")
    assert metrics.probability_metrics(df).first().nll == pytest.approx(-math.log(2.220446049250313e-16))


# ---- Responses ------------------------------------------------------------------------

RESPONSES = [
    ('{"predicted_mode": 3.7, "confidence": true}', (3, 1.0, "")),
    ('{"predicted_mode": "3"}', (3, 0.5, "")),
    ('{"predicted_mode": "3.7"}', (3, 0.5, "")),
    ('{"predicted_mode": "mode 12"}', (1, 0.5, "")),
    ('{"predicted_mode": [8]}', (8, 0.5, "")),
    ('{"predicted_mode": null, "mode": 4}', (1, 0.5, "")),
    ('{"predicted_mode": 0, "mode_code": "x", "transport_mode": 77}', (77, 0.5, "")),
    ('{"confidence": "0.25", "reasoning": null}', (1, 0.25, "None")),
    ('{"predicted_mode": 5, "confidence": -2, "reason": "r", "reasoning_brief": "b"}', (5, 0.0, "b")),
    ('{"predicted_mode": 5} trailing', (5, 0.5, "")),
    ('text {"mode": 2, "confidence": 0.7} and {"mode": 3}', (2, 0.7, "")),
    ('broken {"mode": 2, } end', (-1, 0.0, "json_decode_error")),
    ('{"a": {"predicted_mode": 6}} tail', (6, 0.5, "")),
    ("[1, 2]", (-1, 0.0, "error: 'list' object has no attribute 'get'")),
    ("3", (-1, 0.0, "error: 'int' object has no attribute 'get'")),
    ("null", (-1, 0.0, "error: 'NoneType' object has no attribute 'get'")),
    ("", (-1, 0.0, "empty_response")),
    (None, (-1, 0.0, "empty_response")),
    ('{"predicted_mode": 9, "reasoning_brief": "' + "x" * 600 + '"}', (9, 0.5, "x" * 500)),
]


def test_response_branches(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(RESPONSES)], "i int, raw_response string")
    rows = parse_responses(df).orderBy("i").collect()
    got = [(r.predicted_mode, r.confidence, r.reasoning_brief) for r in rows]
    for (raw, expected), actual in zip(RESPONSES, got):
        assert actual == expected, raw


# ---- Inference ------------------------------------------------------------------------

def test_prompt_text(spark, sf_dir):
    df = st.clean_2022(spark, sf_dir).limit(1)
    row = inference.build_zero_shot_prompts(df).select("messages").first()[0]
    assert row[0]["role"] == "system" and "9=SPB" in row[0]["content"] and "{" + "age_group" not in row[1]["content"]


def test_no_examples_text(spark):
    ex = "struct<person:struct<age_group:string,sex:string,employment_status:string>,household:struct<car_availability:string>,trip:struct<trip_purpose:string,departure_period:string,journey_time:string>,label:struct<main_mode_label:string>>"
    df = spark.range(1).select(F.array().cast(f"array<{ex}>").alias("e"))
    assert df.select(examples_text(F.col("e"))).first()[0] == "  (none)"


def test_retries_then_error():
    calls = []

    def flaky(prompts):
        calls.append(list(prompts))
        if "bad" in prompts or len(calls) < 3:
            raise RuntimeError("x" * 200)
        return [p.upper() for p in prompts]

    responses, errors = inference.isolated(flaky, max_retries=3, retry_delay=0.0)(["ok", "bad"])
    assert responses == ["OK", None] and errors == [None, "x" * 100]


def test_majority_predictor():
    prompt = "→ Mode: Bus\nx\n  → Mode: Taxi\n  → Mode: Bus"
    first, second = inference.majority_predictor([prompt, "none"])
    assert json.loads(first)["predicted_mode"] == 6 and json.loads(second)["predicted_mode"] == 1


def test_evidence_run(spark, sf_dir):
    from surveyalign.operators.prototypes import build_prototypes

    past, current = st.clean_2011(spark, sf_dir), st.clean_2022(spark, sf_dir)
    run = run_evidence(past, current, 0.05, prototypes=build_prototypes(past, k=3, restarts=1), n_samples=40)
    rows = run.predictions.collect()
    assert len(rows) == 40 and all(1 <= r.predicted_mode <= 9 and r.prototype_id in (0, 1, 2) for r in rows)
    assert all(r.n_hist_examples == 4 and r.n_update_examples == 8 for r in rows)
    values = {r.metric: r.value for r in run.metrics.collect()}
    hits = sum(r.predicted_mode == r.main_mode for r in rows)
    assert values["accuracy"] == pytest.approx(hits / 40)


def test_evidence_from_one_memory_only(spark, sf_dir):
    from surveyalign.operators.retrieval import build_index, build_memory

    memory, encoder = build_memory(st.clean_2011(spark, sf_dir))
    queries = encoder.transform(st.clean_2022(spark, sf_dir).limit(5))
    row = inference.retrieve_evidence(queries, fewshot=build_index(memory, 8)).first()
    assert (row.historical, len(row.update), row.prototype_id, row.prototype_summary) == ([], 8, -1, "")
    text = inference.build_prompts(inference.retrieve_evidence(queries, fewshot=build_index(memory, 8))).first().messages[1].content
    assert "(not available)" in text and "  (none)" in text and "Example 4:" in text and "Example 5:" not in text
    with pytest.raises(ValueError):
        inference.retrieve_evidence(queries)


# ---- Models ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        car, purpose = int(rng.integers(0, 3)), int(rng.choice([1, 2, 7]))
        mode = 7 if car == 2 else 9 if purpose == 2 else 6
        if rng.random() < 0.1:
            mode = 6
        rows.append((f"c{i}", car, 3, 1, 1, purpose, 1, str(i % 4), "2", None if i % 9 == 0 else float(i % 60), mode))
    return spark.createDataFrame(rows, """case_id string, car_availability int, age_group int, sex int, employment_status int,
        trip_purpose int, departure_period int, origin_zone string, destination_zone string, journey_time double, main_mode int""")


@pytest.mark.parametrize("fit", [models.fit_mnl, lambda df: models.fit_boosted_trees(df, n_estimators=5)])
def test_models_beat_the_majority_class(labelled, fit):
    predicted = fit(labelled).predict(labelled)
    rows = predicted.select("main_mode", "predicted_mode", "classes", "proba").collect()
    majority = max(np.bincount([r.main_mode for r in rows])) / len(rows)
    assert np.mean([r.main_mode == r.predicted_mode for r in rows]) > majority + 0.1
    assert rows[0].classes == [6, 7, 9] and all(sum(r.proba) == pytest.approx(1) for r in rows)


def test_logit_solves_the_likelihood_equations(labelled):
    """At the unpenalised optimum the expected class counts equal the observed ones."""
    rows = models.fit_mnl(labelled).predict(labelled).select("main_mode", "proba", "car_availability").collect()
    proba = np.array([r.proba for r in rows])
    truth = np.array([[r.main_mode == c for c in (6, 7, 9)] for r in rows], dtype=float)
    cars = np.array([r.car_availability for r in rows])
    assert proba.sum(axis=0) == pytest.approx(truth.sum(axis=0), abs=0.5)
    assert cars @ proba == pytest.approx(cars @ truth, abs=0.5)


def test_failing_model_is_left_out(spark, labelled):
    def broken(df):
        raise RuntimeError("no fit")

    df = labelled.withColumn("trip_weight", F.lit(1.0))
    predicted, scores = models.baseline_grid(df, [0.1], [1], {"mnl": models.fit_mnl, "broken": broken})
    assert [r[0] for r in predicted.select("model").distinct().collect()] == ["mnl"]
    assert {"accuracy", "nll", "brier_score", "mode_share_js"} <= {r[0] for r in scores.select("metric").collect()}


def test_a_grid_draws_test_rows_once_per_seed(spark, labelled, monkeypatch):
    drawn = []
    monkeypatch.setattr(models, "split_test", lambda df, seed: (drawn.append(seed), sampling.split_test(df, seed=seed))[1])
    df = labelled.withColumn("trip_weight", F.lit(1.0))
    _predicted, scores = models.baseline_grid(df, [0.1, 0.2], [1], {"mnl": models.fit_mnl})
    assert drawn == [1] and scores.where("metric = 'n_test'").count() == 2
    test, rest = sampling.split_test(df, seed=1)
    for ratio in (0.1, 0.2):
        split = sampling.split_test_pool_fewshot(df, fewshot_ratio=ratio, seed=1)
        for part, found in (("test", test), ("few_shot", sampling.sample_fewshot(rest, ratio, 1))):
            wanted = split.where(F.col("split") == part).drop("split")
            assert found.columns == wanted.columns and found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
