from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators import retrieval as R
from surveyalign.operators.features import TabularEncoder
from surveyalign.operators.report import results_frame
from surveyalign.session import shared_dir
from surveyalign.sources import artifacts, runs, tables
from verification import survey_tables as st
from verification.cases import case
from verification.cases.features import _SUMMARY as SUMMARY
from verification.cases.features import mode_mean_prototypes
from verification.cases.metrics import ALL_METRICS, SUBGROUP_METRICS
from verification.cases.retrieval import parts

RUN = ["model", "fewshot_ratio", "seed"]


@case("read_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_table(spark, sf):
    return tables.read_table(spark, f"{sf}/customer.parquet")


@case("write_table", """
SELECT 'parquet' AS fmt, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
UNION ALL SELECT 'csv', o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def write_table(spark, sf):
    orders = st.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    parts = []
    for fmt in ("parquet", "csv"):
        path = f"{shared_dir(spark, 'orders')}.{fmt}"
        tables.write_table(orders, path, fmt)
        parts.append(tables.read_table(spark, path, orders.schema).select(F.lit(fmt).alias("fmt"), "*"))
    return parts[0].unionByName(parts[1])


_LINE = """CASE o_orderkey % 97 WHEN 0 THEN concat(o_orderkey, ',', o_custkey) WHEN 1 THEN concat(o_orderkey, ',', o_custkey, ',x,y')
 WHEN 2 THEN concat(o_orderkey, ',', o_custkey, ',"', o_orderpriority) WHEN 3 THEN concat('n', o_orderkey, ',', o_custkey, ',x') ELSE concat(o_orderkey, ',', o_custkey, ',"', o_orderpriority, ',"') END"""


@case("quarantine_csv", f"""
SELECT 'good' AS reason, CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, o_orderpriority || ',' AS text FROM orders WHERE o_orderkey % 97 > 3
UNION ALL SELECT CASE o_orderkey % 97 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'quotes' ELSE 'value' END, NULL, NULL, {_LINE} FROM orders WHERE o_orderkey % 97 <= 3""")
def quarantine_csv(spark, sf):
    """Orders as csv lines, some of them short, long, badly quoted or with text for a number."""
    path, bad = shared_dir(spark, "lines"), shared_dir(spark, "quarantine")
    orders = st.table(spark, sf, "orders").select(F.expr(_LINE).alias("value"))
    orders.unionByName(spark.createDataFrame([("k,c,text",), ("",)], "value string")).write.text(path)
    good = tables.read_csv_quarantined(spark, path, "k long, c long, text string", bad)
    none = F.lit(None).cast("long")
    return good.select(F.lit("good").alias("reason"), "k", "c", "text").unionByName(
        spark.read.parquet(bad).select("reason", none.alias("k"), none.alias("c"), F.col("line").alias("text")))


@case("read_survey_tables", """
SELECT 'household' AS role, count(*) AS n_rows FROM customer
UNION ALL SELECT 'member', count(*) FROM orders
UNION ALL SELECT 'trip', count(*) FROM lineitem
UNION ALL SELECT 'lookup', count(*) FROM nation""")
def read_survey_tables(spark, sf):
    paths = {"household": "customer", "member": "orders", "trip": "lineitem", "lookup": "nation"}
    return tables.table_counts(
        tables.read_survey_tables(spark, {role: f"{sf}/{name}.parquet" for role, name in paths.items()}))


_RUN_FILE = "model || '_ratio' || printf('%.2f', fewshot_ratio) || '_seed' || CAST(seed AS STRING)"
_FILE_METRICS = f"""
SELECT {_RUN_FILE} AS source_file, model || '_' || metric AS metric, round(value, 6)::DOUBLE AS value FROM ({ALL_METRICS})"""


def _metrics(spark, sf):
    """Long metrics and subgroup metrics of all runs, tallied once per session."""
    return st.run_metrics(spark, sf)


@case("evaluate_increment", f"""
SELECT model, fewshot_ratio, seed, metric, round(value, 6)::DOUBLE AS value FROM ({ALL_METRICS})""")
def evaluate_increment(spark, sf):
    """Prediction sets that arrive in two parts; the second tally reads the files of the second part only."""
    path, state = shared_dir(spark, "predictions"), shared_dir(spark, "tallies")
    rows = st.run_predictions(spark, sf)
    for part, name in ((rows.where("seed = 42"), "first"), (rows.where("seed <> 42"), "second")):
        runs.write_prediction_sets(part, f"{path}/{name}")
        runs.tally_new_files(spark, path, state)
    metrics, _subgroups = runs.evaluate_tallied(spark, path, state)
    return metrics.select(*RUN, "metric", F.round("value", 6).alias("value"))


def _write_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    runs.write_metrics(_metrics(spark, sf)[0], path)
    return path


@case("write_metrics", _FILE_METRICS.replace("source_file", "run"))
def write_metrics(spark, sf):
    """The written objects, read as plain text files."""
    objects = spark.read.text(_write_metrics(spark, sf))
    return objects.select("run", F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value")).withColumn(
        "value", F.round("value", 6))


@case("write_subgroup_metrics", SUBGROUP_METRICS.replace("model, fewshot_ratio, seed, subgroup,", f"{_RUN_FILE} AS source_file, subgroup,", 1))
def write_subgroup_metrics(spark, sf):
    path = shared_dir(spark, "subgroups")
    runs.write_subgroup_metrics(_metrics(spark, sf)[1], path)
    loaded = runs.load_subgroup_metrics(spark, path)
    return loaded.withColumns({c: F.round(c, 6) for c in ("mode_share_mae", "mode_share_js")})


@case("load_all_metrics", _FILE_METRICS)
def load_all_metrics(spark, sf):
    return runs.load_all_metrics(spark, _write_metrics(spark, sf)).withColumn("value", F.round("value", 6))


@case("results_frame", """
SELECT model, fewshot_ratio, seed, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(mode_share_mae, 6) AS mode_share_mae, round(mode_share_js, 6) AS mode_share_js FROM run_metrics""")
def results(spark, sf):
    wide = results_frame(runs.load_all_metrics(spark, _write_metrics(spark, sf)), fv.REPORT_METRICS)
    return wide.select(*RUN, *[F.round(m, 6).alias(m) for m in fv.REPORT_METRICS])


@case("read_prediction_sets", """
SELECT model, fewshot_ratio, seed, main_mode, predicted_mode, count(*) AS n FROM fx_runs GROUP BY ALL""")
def read_prediction_sets(spark, sf):
    path = shared_dir(spark, "predictions")
    runs.write_prediction_sets(st.run_predictions(spark, sf), path)
    return runs.read_prediction_sets(spark, path).groupBy(*RUN, "main_mode", "predicted_mode").agg(
        F.count(F.lit(1)).alias("n"))


@case("save_load_artifacts", """
SELECT case_id, """ + ", ".join(f"round(z{i}, 6) AS z{i}" for i in range(1, 9)) + """
FROM fx_scaled WHERE survey_year = 2011""")
def save_load_artifacts(spark, sf):
    past = st.clean_2011(spark, sf)
    encoder = TabularEncoder.fit(past)
    path = shared_dir(spark, "memory")
    artifacts.save_memory(encoder.transform(past), encoder, path)
    memory, loaded = artifacts.load_memory(spark, path)
    again = loaded.transform(memory.drop("features"))
    return again.select("case_id", *[F.round(F.col("features")[i - 1], 6).alias(f"z{i}") for i in range(1, 9)])


_CROSSWALK_ROWS = ", ".join(
    f"('{field}', {year}, {raw}, {code})" for (field, year), mapping in fv.CROSSWALKS.items() for raw, code in mapping.items())


@case("crosswalk_table", f"""
SELECT x.field, x.survey_year, x.raw_code, x.code, COALESCE(n, 0) AS n_trips FROM (VALUES {_CROSSWALK_ROWS}) x(field, survey_year, raw_code, code)
LEFT JOIN (SELECT 'trip_purpose' AS field, survey_year, pur AS raw_code, count(*) AS n FROM fx_tp GROUP BY ALL
  UNION ALL SELECT 'main_mode', survey_year, mode_raw, count(*) FROM fx_tp GROUP BY ALL) u
ON x.field = u.field AND x.survey_year = u.survey_year AND x.raw_code = u.raw_code""")
def crosswalk_table(spark, sf):
    """Every mapping, with the trips that use it where trips have the field."""
    coded = st.trip(spark, sf).select("survey_year", F.inline(F.array(
        F.struct(F.lit("trip_purpose").alias("field"), F.col("pur").alias("raw_code")),
        F.struct(F.lit("main_mode").alias("field"), F.col("mode_raw").alias("raw_code")))))
    keys = ["field", "survey_year", "raw_code"]
    used = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trips"))
    return tables.crosswalk_table(spark).join(used, keys, "left").select(*keys, "code", F.coalesce("n_trips", F.lit(0)).alias("n_trips"))


@case("save_prototypes", f"SELECT prototype_id, {SUMMARY} AS summary FROM fx_proto")
def save_prototypes(spark, sf):
    path = shared_dir(spark, "prototypes")
    artifacts.save_prototypes(mode_mean_prototypes(spark, sf), path)
    return artifacts.load_prototypes(spark, path).prototypes.select("prototype_id", "summary")


@case("save_index", "SELECT query_id, rank, case_id, score FROM fx_few_neighbours")
def save_index(spark, sf):
    """Neighbours from a stored and reloaded index."""
    _encoder, _historical, few, test = parts(spark, sf)
    path = shared_dir(spark, "index")
    artifacts.save_index(R.build_index(few, 8), path)
    return R.retrieve_topk(test, artifacts.load_index(spark, path), 8).select("query_id", "rank", "case_id", "score")
