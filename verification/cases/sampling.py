from pyspark.sql import functions as F

from surveyalign.operators import sampling as S
from surveyalign.operators.setops import exclude_sampled
from verification import survey_tables as st
from verification.cases import case

_RANKED = """(SELECT *, ROW_NUMBER() OVER (PARTITION BY main_mode ORDER BY md5(case_id || ':42'), case_id) AS rn,
 count(*) OVER (PARTITION BY main_mode) AS n FROM fx_clean WHERE survey_year = 2022)"""


@case("stratified_sample", f"SELECT case_id, main_mode FROM {_RANKED} WHERE rn <= greatest(1, floor(n * CAST(0.2 AS DOUBLE)))")
def _(spark, sf):
    return S.stratified_sample(st.clean_2022(spark, sf), 0.2).select("case_id", "main_mode")


@case("split_test_pool_fewshot", "SELECT * FROM fx_split")
def _(spark, sf):
    return S.split_test_pool_fewshot(st.clean_2022(spark, sf), fewshot_ratio=0.05)


@case("fewshot_variants", """
SELECT case_id, main_mode, ratio AS fewshot_ratio, seed,
       CASE WHEN in_test THEN 'test' WHEN rn2 <= greatest(1, floor(n2 * ratio)) THEN 'few_shot' ELSE 'pool' END AS split
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ratio, seed, main_mode, in_test ORDER BY md5(case_id || ':' || CAST(seed + 1 AS STRING)), case_id) AS rn2,
             count(*) OVER (PARTITION BY ratio, seed, main_mode, in_test) AS n2
      FROM (SELECT *, rn <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) AS in_test
            FROM (SELECT case_id, main_mode, seed,
                         ROW_NUMBER() OVER (PARTITION BY seed, main_mode ORDER BY md5(case_id || ':' || CAST(seed AS STRING)), case_id) AS rn,
                         count(*) OVER (PARTITION BY seed, main_mode) AS n
                  FROM fx_clean CROSS JOIN (VALUES (42), (123), (456)) s(seed) WHERE survey_year = 2022))
      CROSS JOIN (SELECT CAST(x AS DOUBLE) AS ratio FROM (VALUES (0.01), (0.05), (0.10)) r(x)))""")
def _(spark, sf):
    return S.fewshot_variants(st.clean_2022(spark, sf))


@case("dry_run_sample", """
SELECT case_id, main_mode FROM fx_clean WHERE survey_year = 2022 ORDER BY md5(case_id || ':42'), case_id LIMIT 20""")
def _(spark, sf):
    return S.dry_run_sample(st.clean_2022(spark, sf), 20, 42).select("case_id", "main_mode")


@case("exclude_sampled", f"SELECT case_id, main_mode FROM {_RANKED} WHERE rn > greatest(1, floor(n * CAST(0.2 AS DOUBLE)))")
def _(spark, sf):
    df = st.clean_2022(spark, sf)
    return exclude_sampled(df, S.stratified_sample(df, 0.2)).select("case_id", "main_mode")


@case("event_stratified_sample", """
SELECT event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS STRING) || ':7'), CAST(event_id AS STRING)) AS rn,
 count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn <= greatest(1, floor(n * CAST(0.1 AS DOUBLE)))""")
def _(spark, sf):
    """The same operator on a table of another shape."""
    events = st.table(spark, sf, "events").withColumn("key", F.col("event_id").cast("string"))
    return S.stratified_sample(events, 0.1, "event_type", 7, "key").select("event_id", "event_type")
