from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.vectors import align_proba
from surveyalign.operators import metrics as M
from surveyalign.operators.filters import filter_valid_predictions
from verification import survey_tables as st
from verification.cases import case

RUN = ["model", "fewshot_ratio", "seed"]
_RUN = "model, fewshot_ratio, seed"


def valid_runs(spark, sf):
    return filter_valid_predictions(st.run_predictions(spark, sf))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@case("confusion_counts", f"SELECT {_RUN}, main_mode AS y_true, predicted_mode AS y_pred, count(*) AS n FROM fx_runs GROUP BY ALL")
def _(spark, sf):
    return M.confusion_counts(st.run_predictions(spark, sf), RUN)


@case("accuracy", f"SELECT {_RUN}, round(accuracy, 6) AS accuracy FROM run_micro")
def _(spark, sf):
    return valid_runs(spark, sf).groupBy(*RUN).agg(F.round(M.accuracy(), 6).alias("accuracy"))


@case("macro_f1", f"SELECT {_RUN}, round(macro_f1, 6) AS macro_f1 FROM run_micro")
def _(spark, sf):
    return _round(M.micro_metrics(M.confusion_counts(valid_runs(spark, sf), RUN), RUN), "macro_f1").select(*RUN, "macro_f1")


@case("weighted_f1", f"SELECT {_RUN}, round(weighted_f1, 6) AS weighted_f1 FROM run_micro")
def _(spark, sf):
    return _round(M.micro_metrics(M.confusion_counts(valid_runs(spark, sf), RUN), RUN), "weighted_f1").select(*RUN, "weighted_f1")


@case("per_class_prf", f"""
SELECT {_RUN}, label, support, predicted, hits, round(CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END, 6) AS precision,
       round(CASE WHEN support = 0 THEN 0 ELSE hits / support END, 6) AS recall, round(2.0 * hits / (support + predicted), 6)::DOUBLE AS f1 FROM run_classes""")
def _(spark, sf):
    classes = M.per_class_prf(M.confusion_counts(valid_runs(spark, sf), RUN), RUN)
    return _round(classes, "precision", "recall", "f1")


_KNOWN = [1, 2, 3, 5, 6, 7, 8, 9]
_P = {m: (f"(CASE WHEN predicted_mode = {m} THEN 0.6 ELSE 0.05 END)::DOUBLE" if m in _KNOWN else "0.0::DOUBLE") for m in fv.MODES}
_TOTAL = "(" + " + ".join(_P[m] for m in _KNOWN) + ")"


@case("align_proba", "SELECT case_id, " + ", ".join(f"round({_P[m]} / {_TOTAL}, 6) AS p_{m}" for m in fv.MODES) + " FROM fx_pred")
def _(spark, sf):
    df = st.with_probabilities(st.predictions(spark, sf))
    return align_proba(df).select("case_id", *[F.round(F.col("aligned")[i], 6).alias(f"p_{m}") for i, m in enumerate(fv.MODES)])


_TRUE_P = "CASE main_mode " + " ".join(f"WHEN {m} THEN {_P[m]} / {_TOTAL}" for m in fv.MODES) + " END"
_SQUARES = " + ".join(f"pow({_P[m]} / {_TOTAL} - CASE WHEN main_mode = {m} THEN 1 ELSE 0 END, 2)" for m in fv.MODES)


@case("nll", f"SELECT age_group, round(avg(-ln(greatest({_TRUE_P}, 2.220446049250313e-16::DOUBLE))), 6) AS nll FROM fx_pred GROUP BY age_group")
def _(spark, sf):
    return _round(M.probability_metrics(st.with_probabilities(st.predictions(spark, sf)), ["age_group"]), "nll").select("age_group", "nll")


@case("brier", f"SELECT age_group, round(avg({_SQUARES}), 6) AS brier_score FROM fx_pred GROUP BY age_group")
def _(spark, sf):
    scored = M.probability_metrics(st.with_probabilities(st.predictions(spark, sf)), ["age_group"])
    return _round(scored, "brier_score").select("age_group", "brier_score")


_NAME = "replace((SELECT mode_label FROM fx_modes WHERE mode = label), ' ', '_')"
_CLASS_METRICS = f"""
SELECT {_RUN}, 'f1_' || {_NAME} AS metric, 2.0 * hits / (support + predicted) AS value FROM run_classes WHERE support > 0
UNION ALL SELECT {_RUN}, 'precision_' || {_NAME}, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END FROM run_classes WHERE support > 0
UNION ALL SELECT {_RUN}, 'recall_' || {_NAME}, hits / support FROM run_classes WHERE support > 0"""
_MICRO_METRICS = f"""
SELECT {_RUN}, 'accuracy' AS metric, accuracy AS value FROM run_micro
UNION ALL SELECT {_RUN}, 'macro_f1', macro_f1 FROM run_micro
UNION ALL SELECT {_RUN}, 'weighted_f1', weighted_f1 FROM run_micro
UNION ALL {_CLASS_METRICS}"""
_SHARE_NAME = "(SELECT replace(mode_label, ' ', '_') FROM fx_modes m WHERE m.mode = s.mode)"
_MACRO_METRICS = f"""
SELECT {_RUN}, 'mode_share_mae' AS metric, mode_share_mae AS value FROM run_macro
UNION ALL SELECT {_RUN}, 'mode_share_js', mode_share_js FROM run_macro
UNION ALL SELECT {_RUN}, 'share_gap_' || {_SHARE_NAME}, p - t FROM run_shares s
UNION ALL SELECT {_RUN}, 'true_share_' || {_SHARE_NAME}, t FROM run_shares s
UNION ALL SELECT {_RUN}, 'pred_share_' || {_SHARE_NAME}, p FROM run_shares s"""


@case("evaluate_predictions", f"""SELECT {_RUN}, metric, round(value, 6)::DOUBLE AS value FROM ({_MICRO_METRICS}
UNION ALL SELECT {_RUN}, 'nll', avg(-ln(greatest({_TRUE_P}, 2.220446049250313e-16::DOUBLE))) FROM fx_runs_valid GROUP BY ALL
UNION ALL SELECT {_RUN}, 'brier_score', avg({_SQUARES}) FROM fx_runs_valid GROUP BY ALL)""")
def _(spark, sf):
    scored = M.evaluate_predictions(st.with_probabilities(valid_runs(spark, sf)), RUN, "classes", "proba")
    return _round(scored, "value")


@case("mode_share_mae", f"SELECT {_RUN}, round(mode_share_mae, 6) AS mode_share_mae FROM run_macro")
def _(spark, sf):
    macro = M.macro_metrics(M.confusion_cube(valid_runs(spark, sf), RUN), RUN)
    return _round(macro, "mode_share_mae").select(*RUN, "mode_share_mae")


@case("mode_share_js", f"SELECT {_RUN}, round(mode_share_js, 6) AS mode_share_js FROM run_macro")
def _(spark, sf):
    macro = M.macro_metrics(M.confusion_cube(valid_runs(spark, sf), RUN), RUN)
    return _round(macro, "mode_share_js").select(*RUN, "mode_share_js")


@case("share_gaps", f"""SELECT {_RUN}, mode, round(t, 6) AS true_share, round(p, 6) AS pred_share, round(p - t, 6) AS share_gap FROM run_shares""")
def _(spark, sf):
    gaps = M.share_gaps(M.macro_metrics(M.confusion_cube(valid_runs(spark, sf), RUN), RUN), RUN)
    return _round(gaps, "true_share", "pred_share", "share_gap")


@case("macro_metrics", f"SELECT {_RUN}, metric, round(value, 6) AS value FROM ({_MACRO_METRICS})")
def _(spark, sf):
    return _round(M.evaluate_macro(M.confusion_cube(valid_runs(spark, sf), RUN), RUN), "value")


_GROUPS = " UNION ALL ".join(
    f"SELECT '{c}' AS subgroup, {c} AS subgroup_value, main_mode, predicted_mode, trip_weight FROM fx_valid" for c in fv.ALL_SUBGROUP_COLUMNS)


@case("subgroup_macro", f"""
SELECT subgroup, subgroup_value, any_value(n) AS n_trips, round(avg(abs(t - p)), 6) AS mode_share_mae,
       round(sqrt((sum(a * ln(2 * a / (a + b))) + sum(b * ln(2 * b / (a + b)))) / 2), 6) AS mode_share_js
FROM (SELECT *, (t + 1e-10) / sum(t + 1e-10) OVER w AS a, (p + 1e-10) / sum(p + 1e-10) OVER w AS b
      FROM (SELECT g.subgroup, g.subgroup_value, m.mode, count(*) AS n,
                   COALESCE(sum(trip_weight) FILTER (WHERE main_mode = m.mode), 0) / sum(trip_weight) AS t,
                   count(*) FILTER (WHERE predicted_mode = m.mode) / count(*) AS p
            FROM ({_GROUPS}) g CROSS JOIN fx_modes m GROUP BY ALL) WINDOW w AS (PARTITION BY subgroup, subgroup_value))
GROUP BY subgroup, subgroup_value""")
def _(spark, sf):
    valid = filter_valid_predictions(st.predictions(spark, sf))
    cube = M.confusion_cube(valid, subgroups=fv.ALL_SUBGROUP_COLUMNS)
    return _round(M.subgroup_macro(cube, fv.ALL_SUBGROUP_COLUMNS), "mode_share_mae", "mode_share_js")


def _attribute(name, predicted, codes):
    domain = " UNION ALL ".join(f"SELECT {c} AS code" for c in codes)
    return f"""SELECT survey_year, '{name}' AS attribute, round(avg(abs(t - p)), 6) AS share_mae FROM (
SELECT survey_year, code, COALESCE(sum(trip_weight) FILTER (WHERE {name} = code), 0) / sum(trip_weight) AS t,
       count(*) FILTER (WHERE {predicted} = code) / count(*) AS p FROM fx_pred CROSS JOIN ({domain}) d GROUP BY ALL) GROUP BY survey_year"""


@case("attribute_share_mae", _attribute("trip_purpose", "(CASE h % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 7 END)", [1, 2, 7])
      + " UNION ALL " + _attribute("departure_period", "(1 + h % 4)", [1, 2, 3, 4]))
def _(spark, sf):
    h = F.col("h")
    df = st.predictions(spark, sf).withColumns({
        "predicted_purpose": F.when(h % 3 == 0, 1).when(h % 3 == 1, 2).otherwise(7), "predicted_period": 1 + h % 4})
    errors = M.attribute_share_mae(df, {
        "trip_purpose": ("predicted_purpose", fv.PURPOSES), "departure_period": ("predicted_period", list(fv.PERIOD_LABELS))}, ["survey_year"])
    return _round(errors, "share_mae")


ALL_METRICS = f"""{_MICRO_METRICS} UNION ALL {_MACRO_METRICS}
UNION ALL SELECT {_RUN}, 'n_total', count(*) FROM fx_runs GROUP BY ALL
UNION ALL SELECT {_RUN}, 'n_valid', count(*) FROM fx_runs_valid GROUP BY ALL"""

_RUN_GROUPS = " UNION ALL ".join(
    f"SELECT {_RUN}, '{c}' AS subgroup, {c}::INT AS subgroup_value, main_mode, predicted_mode, trip_weight FROM fx_runs_valid" for c in fv.SUBGROUP_COLUMNS)
SUBGROUP_METRICS = f"""
SELECT {_RUN}, subgroup, subgroup_value, any_value(n) AS n_trips, round(avg(abs(t - p)), 6) AS mode_share_mae,
       round(sqrt((sum(a * ln(2 * a / (a + b))) + sum(b * ln(2 * b / (a + b)))) / 2), 6) AS mode_share_js
FROM (SELECT *, (t + 1e-10) / sum(t + 1e-10) OVER w AS a, (p + 1e-10) / sum(p + 1e-10) OVER w AS b
      FROM (SELECT {", ".join("g." + k for k in RUN)}, g.subgroup, g.subgroup_value, m.mode, any_value(g.n) AS n,
                   COALESCE(sum(g.w) FILTER (WHERE g.main_mode = m.mode), 0) / sum(g.w) AS t,
                   COALESCE(sum(g.c) FILTER (WHERE g.predicted_mode = m.mode), 0) / sum(g.c) AS p
            FROM (SELECT *, sum(c) OVER (PARTITION BY {_RUN}, subgroup, subgroup_value) AS n FROM (
                    SELECT {_RUN}, subgroup, subgroup_value, main_mode, predicted_mode, sum(trip_weight) AS w, count(*) AS c
                    FROM ({_RUN_GROUPS}) GROUP BY ALL)) g CROSS JOIN fx_modes m GROUP BY ALL) WINDOW w AS (PARTITION BY {_RUN}, subgroup, subgroup_value))
GROUP BY {_RUN}, subgroup, subgroup_value"""


@case("evaluate_all", f"""SELECT {_RUN}, metric, NULL::VARCHAR AS subgroup, NULL::INT AS subgroup_value, NULL::BIGINT AS n_trips, round(value, 6)::DOUBLE AS value FROM ({ALL_METRICS})
UNION ALL SELECT {_RUN}, 'mode_share_mae', subgroup, subgroup_value, n_trips::BIGINT, mode_share_mae FROM ({SUBGROUP_METRICS})
UNION ALL SELECT {_RUN}, 'mode_share_js', subgroup, subgroup_value, n_trips::BIGINT, mode_share_js FROM ({SUBGROUP_METRICS})""")
def _(spark, sf):
    """Both results: metrics of all rows, and those of every subgroup value."""
    metrics, subgroups = M.evaluate_all(st.run_predictions(spark, sf), RUN)
    whole = metrics.select(*RUN, "metric", F.lit(None).cast("string").alias("subgroup"), F.lit(None).cast("int").alias("subgroup_value"),
                           F.lit(None).cast("long").alias("n_trips"), "value")
    parts = M.unpivot(subgroups, [*RUN, "subgroup", "subgroup_value", "n_trips"], ["mode_share_mae", "mode_share_js"])
    return _round(whole.unionByName(parts), "value")
