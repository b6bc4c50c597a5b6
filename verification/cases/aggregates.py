from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators import aggregates as A
from surveyalign.operators import setops
from verification import survey_tables as st
from verification.cases import case


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@case("value_distribution", """
SELECT mode_raw AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_tp GROUP BY mode_raw""")
def _(spark, sf):
    return rounded(A.value_distribution(st.trip(spark, sf), "mode_raw"), "share")


@case("label_counts", "SELECT mode_raw AS label, count(*) AS n FROM fx_tp WHERE mode_raw IS NOT NULL GROUP BY mode_raw")
def _(spark, sf):
    return A.label_counts(st.trip(spark, sf), "mode_raw")


@case("category_ranges", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, CAST({c} AS BIGINT) AS value FROM fx_unified WHERE {c} IS NOT NULL" for c in fv.CATEGORICAL_COLUMNS))
def _(spark, sf):
    return A.category_ranges(st.unified(spark, sf))


@case("mode_shares", """
SELECT 'weighted' AS kind, m.mode, round(COALESCE(sum(c.trip_weight) FILTER (WHERE c.main_mode = m.mode), 0) / sum(c.trip_weight), 6) AS share
FROM fx_modes m CROSS JOIN fx_unified c GROUP BY m.mode
UNION ALL
SELECT 'counted', m.mode, round(count(*) FILTER (WHERE c.main_mode = m.mode) / count(*), 6) FROM fx_modes m CROSS JOIN fx_unified c GROUP BY m.mode""")
def _(spark, sf):
    df = st.unified(spark, sf)
    both = A.mode_shares(df, weight="trip_weight").select(F.lit("weighted").alias("kind"), "*").unionByName(
        A.mode_shares(df).select(F.lit("counted").alias("kind"), "*"))
    return rounded(both, "share")


@case("profile_column", """
SELECT 'int' AS dtype, count(*) AS n_total, count(*) FILTER (WHERE b2 IS NULL) AS n_null, count(DISTINCT b2) AS n_distinct,
       min(b2) AS min_value, max(b2) AS max_value,
       (SELECT string_agg(COALESCE(CAST(b2 AS STRING), 'null'), ',' ORDER BY mem) FROM (SELECT mem, b2 FROM fx_hm ORDER BY mem LIMIT 20)) AS head_20
FROM fx_hm""")
def _(spark, sf):
    return A.profile_column(st.member(spark, sf), "b2", "mem").withColumn("n_null", F.col("n_null").cast("bigint"))


@case("cross_year_shares", """
SELECT main_mode, mode_label, round(n1 / sum(n1) OVER (), 6) AS share_2011, round(n2 / sum(n2) OVER (), 6) AS share_2022 FROM (
SELECT main_mode, count(*) FILTER (WHERE survey_year = 2011) AS n1, count(*) FILTER (WHERE survey_year = 2022) AS n2
FROM fx_clean GROUP BY main_mode) JOIN fx_modes ON mode = main_mode""")
def _(spark, sf):
    return rounded(A.cross_year_shares(st.clean(spark, sf)), "share_2011", "share_2022")


@case("year_mode_distribution", """
SELECT survey_year, field, code, label, n, round(n / sum(n) OVER (PARTITION BY survey_year, field) * 100, 6) AS percent FROM (
SELECT survey_year, 'main_mode' AS field, main_mode AS code, mode_label AS label, count(*) AS n FROM fx_clean JOIN fx_modes ON mode = main_mode GROUP BY ALL
UNION ALL SELECT survey_year, 'trip_purpose', trip_purpose, CASE trip_purpose WHEN 1 THEN 'Work' WHEN 2 THEN 'Education' ELSE 'Other' END, count(*) FROM fx_clean GROUP BY ALL)""")
def _(spark, sf):
    return rounded(A.year_mode_distribution(st.clean(spark, sf)), "percent")


_STATS = ["journey_time", "hh_size", "trip_weight", "age_group", "employment_status"]


@case("feature_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM fx_clean" for c in _STATS))
def _(spark, sf):
    return rounded(A.feature_stats(st.clean(spark, sf), _STATS), "median", "mean", "std")


@case("seed_mean_std", """
SELECT model, fewshot_ratio, metric, round(avg(value), 6) AS mean, round(COALESCE(stddev_samp(value), 0), 6) AS std, count(value) AS n_seeds
FROM (UNPIVOT run_metrics ON accuracy, macro_f1, mode_share_mae, mode_share_js INTO NAME metric VALUE value)
GROUP BY model, fewshot_ratio, metric""")
def _(spark, sf):
    metrics, _subgroups = st.run_metrics(spark, sf)
    return rounded(A.seed_mean_std(metrics.where(F.col("metric").isin(fv.REPORT_METRICS))), "mean", "std")


@case("distinct_pairs", "SELECT DISTINCT mode_raw, pur FROM fx_tp")
def _(spark, sf):
    return setops.distinct_pairs(st.trip(spark, sf), "mode_raw", "pur")


@case("label_set_difference", "SELECT mode_raw AS label, count(*) AS n FROM fx_tp WHERE mode_raw NOT BETWEEN 1 AND 9 GROUP BY mode_raw")
def _(spark, sf):
    return setops.label_set_difference(st.trip(spark, sf), "mode_raw", fv.MODES)
