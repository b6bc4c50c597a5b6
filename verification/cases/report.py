from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators import report as RP
from verification import survey_tables as st
from verification.cases import case

_M = fv.REPORT_METRICS


def metrics(spark, sf):
    return st.run_metrics(spark, sf)[0]


_GRID = """(SELECT * FROM (VALUES ('mnl'), ('boosted_trees'), ('retrieval'), ('prompt_only')) m(model)
CROSS JOIN (SELECT CAST(x AS DOUBLE) AS fewshot_ratio FROM (VALUES (0.01), (0.05), (0.10)) v(x)))"""


@case("comparison_table", "SELECT model, fewshot_ratio, " + ", ".join(
    f"round(COALESCE(avg({m}), 'nan'::DOUBLE), 6) AS {m}, round(COALESCE(stddev_samp({m}), 0), 6) AS {m}_std" for m in _M)
    + f" FROM {_GRID} LEFT JOIN run_metrics USING (model, fewshot_ratio) GROUP BY model, fewshot_ratio")
def _(spark, sf):
    table = RP.comparison_table(metrics(spark, sf), st.MODELS + ["prompt_only"])
    return table.select("model", "fewshot_ratio", *[F.round(c, 6).alias(c) for m in _M for c in (m, f"{m}_std")])


@case("formatted_table", "SELECT upper(model) AS model, printf('%.0f', fewshot_ratio * 100) || '%' AS fewshot_percent, " + ", ".join(
    f"printf('%.3f', avg({m})) || ' ± ' || printf('%.3f', COALESCE(stddev_samp({m}), 0)) AS {m}" for m in _M)
    + " FROM run_metrics GROUP BY model, fewshot_ratio")
def _(spark, sf):
    return RP.formatted_table(metrics(spark, sf))


@case("fewshot_curve", """
SELECT model, round(fewshot_ratio * 100, 6) AS ratio_percent, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS std
FROM run_metrics GROUP BY model, fewshot_ratio""")
def _(spark, sf):
    curve = RP.fewshot_curve(metrics(spark, sf), "macro_f1")
    return curve.select("model", *[F.round(c, 6).alias(c) for c in ("ratio_percent", "mean", "std")])


_SHARE = "count(*) FILTER (WHERE model = '{0}' AND predicted_mode = mode) / count(*) FILTER (WHERE model = '{0}' AND predicted_mode >= 1)"


@case("share_comparison", f"""
SELECT mode, mode_label, round(count(*) FILTER (WHERE model = 'mnl' AND main_mode = mode) / count(*) FILTER (WHERE model = 'mnl'), 6) AS ground_truth_share,
 {", ".join(f"round({_SHARE.format(m)}, 6) AS {m}_share" for m in st.MODELS)}
FROM fx_modes CROSS JOIN fx_runs WHERE fewshot_ratio = CAST(0.05 AS DOUBLE) AND seed = 42 GROUP BY mode, mode_label""")
def _(spark, sf):
    table = RP.share_comparison(st.run_predictions(spark, sf), st.MODELS, 0.05, 42)
    return table.select("mode", "mode_label", *[F.round(c, 6).alias(c) for c in table.columns if c.endswith("_share")])
