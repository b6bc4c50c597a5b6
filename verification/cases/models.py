import re

from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.responses import parse_responses
from surveyalign.functions.vectors import argmax_class
from surveyalign.operators import inference as I
from surveyalign.operators import models as ML
from surveyalign.session import shared_dir
from verification import survey_tables as st
from verification.cases import case
from verification.cases.retrieval import evidence, split
from verification.cases.scalars import _AGE, _CAR, _EMP, _EXAMPLE, _INC, _JRN, _PER, _PUR, _SEX
from verification.oracle_views import VIEWS


def _train_test(spark, sf):
    rows = split(spark, sf)
    return rows.where("split = 'few_shot'").drop("split"), rows.where("split = 'test'").drop("split")


_MNL = list(zip(fv.MODEL_FEATURES, ["x1", "x2", "x3", "x4", "x5", "x6", "jt", "x7", "x8"]))
_FEW = """few AS (SELECT r.*, greatest(COALESCE(r.journey_time, (SELECT median(q.journey_time) FROM fx_split q WHERE q.split = 'few_shot')), 0) AS jt
FROM fx_raw_features r JOIN fx_split s USING (case_id) WHERE s.split = 'few_shot')"""


@case("mnl_fit_predict", f"""SELECT main_mode, feature, round(observed, 6)::DOUBLE AS observed, true AS expected_equals_observed FROM (
WITH {_FEW} UNPIVOT (SELECT main_mode, {", ".join(f"sum({x})::DOUBLE AS {name}" for name, x in _MNL)}, count(*)::DOUBLE AS constant FROM few GROUP BY main_mode)
ON {", ".join(name for name, _ in _MNL)}, constant INTO NAME feature VALUE observed)""")
def _(spark, sf):
    """First-order conditions of the likelihood: per class, the sums of every feature over the
    training rows, weighted by the fitted probabilities, are those over the rows of the class."""
    train, test = _train_test(spark, sf)
    model = ML.fit_mnl(train)
    assert model.predict(test).where("NOT coalesce(predicted_mode BETWEEN 1 AND 9, false)").isEmpty()
    inputs = [F.greatest(c, F.lit(0.0)).alias(f) for f, c in zip(model.encoder.features, model.encoder.imputed(train))]
    scored = model.predict_proba(train.select("*", *[c.alias(f"_x_{f}") for f, c in zip(model.encoder.features, inputs)], F.lit(1.0).alias("_x_constant")))
    names = [*model.encoder.features, "constant"]
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("feature"), (F.col(f"_x_{f}") * F.get("proba", F.lit(i))).alias("expected"),
                              F.when(F.col("main_mode") == c, F.col(f"_x_{f}")).otherwise(0.0).alias("seen"), F.abs(f"_x_{f}").alias("size"))
                     for i, c in enumerate(model.classes) for f in names])
    sums = scored.select(F.inline(rows)).groupBy("c", "feature").agg(
        F.sum("expected").alias("expected"), F.sum("seen").alias("observed"), F.sum("size").alias("size"))
    close = F.abs(F.col("expected") - F.col("observed")) <= 1e-3 * (1 + F.col("size"))
    return sums.select(F.col("c").alias("main_mode"), "feature", F.round("observed", 6).alias("observed"), close.alias("expected_equals_observed"))


@case("boosted_trees_fit_predict", """
SELECT count(*) AS n_test, (SELECT count(*) FROM fx_split WHERE split = 'few_shot') AS n_train,
  round((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM fx_split WHERE split = 'few_shot' GROUP BY main_mode)), 6) AS majority_share,
  true AS classes_known, true AS probabilities_sum_to_one, true AS better_than_majority FROM fx_split WHERE split = 'test'""")
def _(spark, sf):
    """200 rounds of depth 6; better than the majority class on the rows it was fitted on."""
    train, test = _train_test(spark, sf)
    model = ML.fit_boosted_trees(train)
    total = F.aggregate("proba", F.lit(0.0), lambda acc, x: acc + x)
    facts = model.predict(test).agg(
        F.count(F.lit(1)).alias("n_test"), F.min(F.array_contains("classes", F.col("predicted_mode"))).alias("classes_known"),
        F.min(F.abs(total - 1) < 1e-9).alias("probabilities_sum_to_one"))
    hits = model.predict(train).groupBy("main_mode").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_mode") == F.col("main_mode")).alias("hits"))
    share = F.max("n") / F.sum("n")
    fit = hits.agg(F.sum("n").alias("n_train"), F.round(share, 6).alias("majority_share"), (F.sum("hits") / F.sum("n") > share).alias("better_than_majority"))
    return facts.crossJoin(fit)


@case("argmax_class", """
SELECT case_id, CAST(CASE WHEN predicted_mode IN (9,8,7,6,5,3,2,1) THEN predicted_mode ELSE 9 END AS INT) AS best FROM fx_pred""")
def _(spark, sf):
    df = st.with_probabilities(st.predictions(spark, sf))
    return df.select("case_id", argmax_class(F.col("classes"), F.col("proba")).alias("best"))


@case("model_score", "SELECT round(avg(CASE WHEN main_mode = predicted_mode THEN 1.0 ELSE 0.0 END), 6) AS score FROM fx_pred")
def _(spark, sf):
    return ML.model_score(st.predictions(spark, sf)).select(F.round("score", 6).alias("score"))


@case("baseline_grid", """
SELECT m.model, r.fewshot_ratio, 42 AS seed, CAST(sum(greatest(1, floor(n_rest * r.fewshot_ratio))) AS BIGINT) AS n_train, CAST(sum(n_test) AS BIGINT) AS n_test,
  true AS metrics_complete, true AS metrics_in_range
FROM (SELECT main_mode, count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split <> 'test') AS n_rest FROM fx_split GROUP BY main_mode),
  (VALUES ('mnl'), ('boosted_trees')) m(model), (SELECT CAST(x AS DOUBLE) AS fewshot_ratio FROM (VALUES (0.01), (0.05), (0.10)) v(x)) r
GROUP BY m.model, r.fewshot_ratio""")
def _(spark, sf):
    """Every model and ratio of the grid at one seed, with the sizes of its run and all its metrics."""
    _predictions, metrics = ML.baseline_grid(st.clean_2022(spark, sf))
    value = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    single = ["accuracy", "macro_f1", "weighted_f1", "mode_share_mae", "mode_share_js", "nll", "brier_score"]
    per_mode = F.col("metric").rlike("^(share_gap|true_share|pred_share)_")
    shares = F.count_if(per_mode) == 3 * len(fv.MODES)
    complete = shares & (F.count_if(F.col("metric").isin(single)) == len(single)) & (F.count_if(F.col("metric").startswith("f1_")) > 0)
    upper = F.when(F.col("metric") == "brier_score", 2.0).when(F.col("metric").isin("nll", "n_train", "n_test"), float("inf")).otherwise(1.0)
    lower = F.when(F.col("metric").startswith("share_gap_"), -1.0).otherwise(0.0)
    in_range = F.min(F.coalesce(F.col("value").between(lower - 1e-9, upper + 1e-9), F.lit(False)))
    return metrics.groupBy("model", "fewshot_ratio", "seed").agg(
        value("n_train").cast("long").alias("n_train"), value("n_test").cast("long").alias("n_test"), complete.alias("metrics_complete"),
        in_range.alias("metrics_in_range"))


VIEWS["fx_example"] = f"SELECT case_id, main_mode, {_EXAMPLE} AS txt FROM fx_clean"


def _examples(view, n):
    return f"""(SELECT query_id, string_agg('Example ' || CAST(rank AS STRING) || ':' || chr(10) || txt, chr(10) ORDER BY rank) AS txt
FROM {view} JOIN fx_example USING (case_id) WHERE rank <= {n} GROUP BY query_id)"""


def _template(text, values):
    """The prompt text as an SQL concatenation."""
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


_PROMPT = _template(fv.EVIDENCE_USER_PROMPT, {
    "age_group": _AGE, "sex": _SEX, "employment_status": _EMP, "income_group": _INC, "car_availability": _CAR,
    "trip_purpose": _PUR, "departure_period": _PER, "journey_time": _JRN,
    "prototype_summary": "s.summary", "historical_examples": "h.txt", "update_examples": "f.txt"})


@case("build_prompts", f"""
SELECT q.case_id, {_PROMPT} AS prompt, 'system' AS first_role
FROM fx_split q JOIN fx_nearest USING (case_id) JOIN fx_summary s USING (prototype_id)
JOIN {_examples('fx_hist_neighbours', 3)} h ON h.query_id = q.case_id JOIN {_examples('fx_few_neighbours', 4)} f ON f.query_id = q.case_id
WHERE q.split = 'test'""")
def _(spark, sf):
    prompts = I.build_prompts(evidence(spark, sf))
    return prompts.select("case_id", F.col("messages")[1]["content"].alias("prompt"), F.col("messages")[0]["role"].alias("first_role"))


@case("batch_inference", """
SELECT case_id, CAST(mode AS INT) AS predicted_mode, CAST(printf('%.3f', votes / 7) AS DOUBLE) AS confidence,
       CAST(votes AS STRING) || ' of 7 examples' AS reasoning_brief, prototype_id, 4 AS n_hist_examples, 8 AS n_update_examples
FROM (SELECT query_id AS case_id, main_mode AS mode, count(*) AS votes,
             ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY count(*) DESC, main_mode) AS rn
      FROM (SELECT * FROM fx_hist_neighbours WHERE rank <= 3 UNION ALL SELECT * FROM fx_few_neighbours WHERE rank <= 4) n
      JOIN fx_example e ON e.case_id = n.case_id GROUP BY query_id, main_mode)
JOIN fx_nearest USING (case_id) WHERE rn = 1""")
def _(spark, sf):
    """The stand-in predictor: majority of the seven examples in the prompt."""
    return I.batch_inference(I.build_prompts(evidence(spark, sf)))


def _failing(prompts):
    """A predictor that rejects every batch with a trip to education in it."""
    if any("Purpose: Education" in p for p in prompts):
        raise RuntimeError("rejected")
    return ['{"predicted_mode": 6, "confidence": 0.9, "reasoning_brief": "bus"}'] * len(prompts)


def _bus(prompts):
    return ['{"predicted_mode": 6, "confidence": 0.9, "reasoning_brief": "bus"}'] * len(prompts)


@case("error_isolation", """
SELECT case_id, CAST(CASE WHEN trip_purpose = 2 THEN -1 ELSE 6 END AS INT) AS predicted_mode,
       CAST(CASE WHEN trip_purpose = 2 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS confidence,
       CASE WHEN trip_purpose = 2 THEN 'error: rejected' ELSE 'bus' END AS reasoning_brief, -1 AS prototype_id,
       0 AS n_hist_examples, 0 AS n_update_examples
FROM fx_clean WHERE survey_year = 2022""")
def _(spark, sf):
    prompts = I.build_zero_shot_prompts(st.clean_2022(spark, sf))
    return I.batch_inference(prompts, _failing, retry_delay=0.0)


@case("resume_inference", """
SELECT case_id, CAST(CASE WHEN trip_purpose = 2 AND age_group > 3 THEN -1 ELSE 6 END AS INT) AS predicted_mode,
       CASE WHEN trip_purpose = 2 AND age_group > 3 THEN 'error: rejected' ELSE 'bus' END AS reasoning_brief
FROM fx_clean WHERE survey_year = 2022""")
def _(spark, sf):
    """A run over the younger travellers fills a ledger; the run over all goes on from it, with a predictor that now fails for trips to education."""
    prompts = I.build_zero_shot_prompts(st.clean_2022(spark, sf))
    ledger = shared_dir(spark, "ledger")
    I.batch_inference(prompts.where("age_group <= 3"), _bus, retry_delay=0.0, ledger=ledger, predictor_name="bus").count()
    found = I.batch_inference(prompts, _failing, retry_delay=0.0, ledger=ledger, predictor_name="bus")
    return found.select("case_id", "predicted_mode", "reasoning_brief")


@case("parse_responses", """
SELECT case_id,
  CAST(CASE substr(raw_response, 1, 20) WHEN '{"predicted_mode": 4' THEN CASE WHEN raw_response LIKE '%mode_code%' THEN 8 WHEN raw_response LIKE '%42%' THEN 1 ELSE main_mode END
    WHEN 'Sure: {"predicted_mo' THEN 6 WHEN '{"predicted_mode": "' THEN 3 WHEN '   ' THEN -1 WHEN 'no json here' THEN -1
    WHEN '{"mode": 2, "probabi' THEN 2 WHEN '{"main_mode": 1, "co' THEN 1 WHEN '{"predicted_mode": n' THEN 1 ELSE main_mode END AS INT) AS predicted_mode,
  CAST(CASE WHEN raw_response LIKE '%"confidence": 0.8%' THEN 0.8 WHEN raw_response LIKE 'Sure%' THEN 0.4
    WHEN raw_response LIKE '%probability%' THEN 0.3 WHEN raw_response LIKE '%1.7%' THEN 1.0
    WHEN trim(raw_response) = '' OR raw_response LIKE 'no json%' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE WHEN raw_response LIKE '%"ok"%' THEN 'ok' WHEN raw_response LIKE '%alias%' THEN 'alias' WHEN trim(raw_response) = '' THEN 'empty_response'
    WHEN raw_response LIKE 'no json%' THEN 'json_decode_error' ELSE '' END AS reasoning_brief
FROM fx_responses""")
def _(spark, sf):
    return parse_responses(st.responses(spark, sf)).select("case_id", "predicted_mode", "confidence", "reasoning_brief")


@case("usage_summary", """
SELECT CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(conv_id % 97) AS BIGINT) AS completion_tokens,
       CAST(sum(length(text)) + sum(conv_id % 97) AS BIGINT) AS total_tokens, count(*) AS call_count FROM conversations""")
def _(spark, sf):
    """A log with one call per conversation turn."""
    log = st.table(spark, sf, "conversations").select(
        F.length("text").alias("prompt_tokens"), (F.col("conv_id") % 97).alias("completion_tokens"))
    return I.usage_summary(log)
