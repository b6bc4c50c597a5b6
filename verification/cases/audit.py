from pyspark.sql import functions as F

from surveyalign.operators import audit as D
from surveyalign.operators.filters import filter_main_modes
from verification import survey_tables as st
from verification.cases import case
from verification.cases.retrieval import split


@case("illegal_code_check", """
SELECT count(*) FILTER (WHERE mode_raw = 10) AS n_code_10, count(*) FILTER (WHERE mode_raw = 99) AS n_code_99,
       count(*) FILTER (WHERE mode_raw = 999) AS n_code_999, count(*) FILTER (WHERE mode_raw > 9) AS n_above_limit,
       CAST(max(mode_raw) AS DOUBLE) AS max_code FROM fx_tp""")
def _(spark, sf):
    return D.illegal_code_check(st.trip(spark, sf), "mode_raw")


@case("crosswalk_audit", """
SELECT DISTINCT CAST(raw_mode_2011 AS BIGINT) AS raw_code, main_mode AS unified_code,
       COALESCE((SELECT mode_label FROM fx_modes WHERE mode = main_mode), 'Unknown') AS unified_label
FROM fx_unified WHERE survey_year = 2011""")
def _(spark, sf):
    return D.crosswalk_audit(st.unified(spark, sf).where("survey_year = 2011"), "raw_mode_2011")


@case("stage_distributions", """
SELECT 'raw' AS stage, CAST(mode_raw AS BIGINT) AS value, count(*) AS n FROM fx_tp WHERE survey_year = 2022 GROUP BY ALL
UNION ALL SELECT 'filtered', mode_raw, count(*) FROM fx_tp WHERE survey_year = 2022 AND mode_raw <= 9 GROUP BY ALL
UNION ALL SELECT 'harmonised', main_mode, count(*) FROM fx_unified WHERE survey_year = 2022 GROUP BY ALL
UNION ALL SELECT 'cleaned', main_mode, count(*) FROM fx_clean WHERE survey_year = 2022 GROUP BY ALL
UNION ALL SELECT split, main_mode, count(*) FROM fx_split GROUP BY ALL""")
def _(spark, sf):
    raw = st.tables_2022(spark, sf)["trip"]
    stages = {
        "raw": (raw, "Main_mode"),
        "filtered": (filter_main_modes(raw), "Main_mode"),
        "harmonised": (st.unified(spark, sf).where("survey_year = 2022"), "main_mode"),
        "cleaned": (st.clean_2022(spark, sf), "main_mode"),
    }
    rows = split(spark, sf)
    stages.update({s: (rows.where(F.col("split") == s), "main_mode") for s in ("test", "few_shot", "pool")})
    return D.stage_distributions(stages)


@case("snapshot_compare", """
SELECT (SELECT count(*) FROM fx_clean) AS n_cached, (SELECT count(*) FROM fx_unified WHERE main_mode >= 1) AS n_fresh,
       false AS row_count_matches, true AS label_set_matches""")
def _(spark, sf):
    """The stored table against the harmonised rows before the record filter."""
    return D.snapshot_compare(st.clean(spark, sf), st.unified(spark, sf).where("main_mode >= 1"))


@case("snapshot_diff", """
SELECT case_id, CASE CAST(household_id AS BIGINT) % 11 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'count' END AS status, 1 AS n_cached,
  CAST(CASE CAST(household_id AS BIGINT) % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS n_fresh
FROM fx_clean WHERE CAST(household_id AS BIGINT) % 11 <= 2""")
def _(spark, sf):
    """The stored trips against a copy without some households, with others changed and others twice."""
    trips = st.clean(spark, sf)
    rest = F.col("household_id").cast("long") % 11
    copy = trips.where(rest != 0).withColumn("trip_weight", F.when(rest == 1, F.col("trip_weight") + 1).otherwise(F.col("trip_weight")))
    found = D.snapshot_diff(trips, copy.unionByName(trips.where(rest == 2)), ["case_id"])
    return found.select("case_id", "status", F.col("n_cached").cast("int").alias("n_cached"), F.col("n_fresh").cast("int").alias("n_fresh"))


@case("prediction_audit", """
SELECT model, fewshot_ratio, seed, 'true' AS side, main_mode AS label, count(*) AS n, main_mode BETWEEN 1 AND 9 AS in_domain FROM fx_runs GROUP BY ALL
UNION ALL SELECT model, fewshot_ratio, seed, 'predicted', predicted_mode, count(*), predicted_mode BETWEEN 1 AND 9 FROM fx_runs GROUP BY ALL""")
def _(spark, sf):
    return D.prediction_audit(st.run_predictions(spark, sf))
