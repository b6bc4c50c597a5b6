"""Harmonisation fallbacks, joins, sources and sampling guarantees."""

import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.operators import aggregates, audit, filters, harmonize, joins, report, sampling
from surveyalign.session import shared_dir, shared_root
from surveyalign.sources import runs, tables
from verification import survey_tables as st

TRIP = "Q_NO string, MEM string, Trip_no string, Pur string, Mode_Hier string, Deptm string, Arrtm string, Joutm string, D5 int, D6 int, TiPer string, WT_TRIP string"


def raw_2011(spark, trips):
    return {
        "household": spark.createDataFrame([("1", "3", "97", 1.0, None)], "Q_NO string, A3 string, B15 string, C2A1 double, C2B2 double"),
        "member": spark.createDataFrame([("1", "1", "2", "130", "3")], "Q_NO string, MEM string, B1 string, B2 string, E_Status string"),
        "trip": spark.createDataFrame(trips, TRIP),
        "lookup": spark.createDataFrame([(10, 4), (10, 4), (11, 5), (11, 6)], "`11TPUSB` int, DB26 int"),
    }


def test_harmonized_text_tables(spark):
    trips = [("1", "1", "2", "4", "6", "830", "900", "30", 10, 99, "1", "2.5")]
    row = harmonize.harmonize_2011(joins.load_joined_2011(raw_2011(spark, trips))).collect()
    assert len(row) == 1
    assert row[0].asDict() == {
        "case_id": "2011_1_1_2", "household_id": "1", "person_id": "1_1", "trip_no": 2, "survey_year": 2011,
        "hh_size": 3, "car_availability": 1, "age_group": -1, "sex": 2, "employment_status": 4, "income_group": 0,
        "trip_purpose": 1, "departure_period": 1, "journey_time": 30.0, "origin_zone": "4", "destination_zone": "0",
        "main_mode": 6, "trip_weight": 2.5, "raw_mode_2011": "6", "raw_purpose_2011": "4"}


def test_zone_with_two_districts_multiplies_rows(spark):
    trips = [("1", "1", "1", "1", "1", "830", "900", "30", 11, 10, "1", "1")]
    rows = joins.load_joined_2011(raw_2011(spark, trips)).select("origin_db26").collect()
    assert sorted(r[0] for r in rows) == [5, 6]


def test_unknown_member_and_household_keep_the_trip(spark):
    trips = [("77", "x", None, None, None, None, None, None, 10, 10, None, None)]
    row = harmonize.harmonize_2011(joins.load_joined_2011(raw_2011(spark, trips))).first()
    assert (row.case_id, row.hh_size, row.car_availability, row.employment_status) == ("2011_77_-1_0", -1, 0, 7)
    assert (row.trip_purpose, row.main_mode, row.raw_mode_2011, row.trip_weight) == (7, -1, "-1", 1.0)


def test_journey_fallback_needs_an_empty_column(spark):
    trips = [("1", "1", "1", "1", "1", "2330", "15", None, 10, 10, "1", "1"),
             ("1", "1", "2", "1", "1", "800", "830", "7", 10, 10, "1", "1")]
    journey = lambda rows: [r[0] for r in harmonize.harmonize_2011(
        joins.load_joined_2011(raw_2011(spark, rows))).orderBy("trip_no").select("journey_time").collect()]
    assert journey(trips) == [None, 7.0]
    assert journey(trips[:1]) == pytest.approx([45.0])


def test_missing_zone_columns_of_the_second_survey(spark):
    joined = spark.createDataFrame(
        [(5, 1, 1, 1, 3, 8.5, 20.0, 1.0, 30, 1, 1)],
        "Q_no int, Mem int, Trip_no int, T_Pur int, Main_mode int, D7 double, `Journey Time` double, WT_TRIP double, B2 int, B1 int, E_status int")
    row = harmonize.harmonize_2022(joined).first()
    assert (row.origin_zone, row.departure_period, row.hh_size, row.income_group, row.raw_mode_2011) == ("", 1, -1, 0, None)
    assert [f.name for f in harmonize.harmonize_2022(joined).schema] == fv.CANONICAL_COLUMNS


def test_filters_keep_missing_journeys(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, None), (1, 1, 1, float("nan")), (1, 1, 1, 240.0), (1, 1, 1, 240.5), (-1, 1, 1, 1.0), (1, 1, -1, 1.0)],
        "main_mode int, trip_purpose int, age_group int, journey_time double")
    seen = Observation()
    assert filters.apply_all_filters(df, seen).count() == 3
    assert seen.get == {"n_input": 6, "n_valid": 4, "n_kept": 3}


def test_main_mode_filter_drops_null_but_not_zero(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (None,)], "Main_mode int")
    assert sorted(r[0] for r in filters.filter_main_modes(df).collect()) == [0, 9]


# ---- Sampling -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def strata(spark):
    rows = [(f"c{i}", 1 if i < 700 else 2 if i < 997 else 3 if i < 1000 else None) for i in range(1003)]
    return spark.createDataFrame(rows, "case_id string, main_mode int")


def test_sample_sizes(strata):
    sample = sampling.stratified_sample(strata, 0.2)
    sizes = {r[0]: r[1] for r in sample.groupBy("main_mode").count().collect()}
    assert sizes == {1: 140, 2: int(297 * 0.2), 3: 1}


def test_sample_does_not_depend_on_partitioning(strata):
    ids = lambda df: sorted(r[0] for r in sampling.stratified_sample(df, 0.1, seed=9).select("case_id").collect())
    assert ids(strata) == ids(strata.repartition(7)) and ids(strata) != sorted(
        r[0] for r in sampling.stratified_sample(strata, 0.1, seed=10).select("case_id").collect())


def test_split_covers_the_table_once(strata):
    split = sampling.split_test_pool_fewshot(strata, fewshot_ratio=0.1)
    assert split.count() == 1003 and split.select("case_id").distinct().count() == 1003
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("main_mode", "split").count().collect()}
    assert counts[1, "test"] == 140 and counts[1, "few_shot"] == 56 and counts[1, "pool"] == 504
    assert counts[3, "test"] == 1 and counts[3, "few_shot"] == 1 and counts[3, "pool"] == 1
    assert counts[None, "pool"] == 3


def test_refined_histograms_give_the_same_sample(strata, monkeypatch):
    ids = lambda: sorted(r[0] for r in sampling.stratified_sample(strata, 0.3).select("case_id").collect())
    plain = ids()
    monkeypatch.setattr(sampling, "RANK_ROWS", 1)
    monkeypatch.setattr(sampling, "HASH_STEP", 1)
    assert ids() == plain


def test_variants_equal_single_splits(strata):
    grid = sampling.fewshot_variants(strata, [0.01, 0.1], [42, 123])
    for ratio, seed in ((0.01, 123), (0.1, 42)):
        one = sampling.split_test_pool_fewshot(strata, fewshot_ratio=ratio, seed=seed).select("case_id", "split")
        part = grid.where((F.col("fewshot_ratio") == ratio) & (F.col("seed") == seed)).select("case_id", "split")
        assert one.exceptAll(part).count() == 0 and part.exceptAll(one).count() == 0


# ---- Sources --------------------------------------------------------------------------

def test_table_formats(spark):
    df = spark.createDataFrame([(1, "a,b")], "i int, s string")
    path = shared_dir(spark, "formats")
    tables.write_table(df, f"{path}.csv", "csv")
    assert tables.read_table(spark, f"{path}.csv").first().asDict() == {"i": "1", "s": "a,b"}
    with pytest.raises(ValueError):
        tables.write_table(df, path, "xlsx")
    with pytest.raises(ValueError):
        tables.read_table(spark, "trips.xlsx")
    with pytest.raises(FileNotFoundError, match="member"):
        tables.read_survey_tables(spark, {"member": f"{path}-missing.parquet"})


def test_run_names(spark):
    names = ["prompt_only_ratio0.05_seed42", "mnl_ratio0.10_seed7_metrics", "notes"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", *report.run_columns(F.col("n")))
    parsed = {r.n: (r.model, r.fewshot_ratio, r.seed) for r in df.collect()}
    assert parsed == {names[0]: ("prompt_only", 0.05, 42), names[1]: ("mnl", 0.1, 7), names[2]: (None, None, None)}


def test_metric_files_with_different_keys(spark, tmp_path):
    (tmp_path / "mnl_ratio0.01_seed42_metrics.json").write_text('{"mnl_accuracy": 0.5, "seed": 42}')
    (tmp_path / "mnl_ratio0.05_seed42_metrics.json").write_text('{"mnl_accuracy": 0.6,\n "mnl_macro_f1": 0.4}')
    (tmp_path / "broken.json").write_text("{not json")
    loaded = runs.load_all_metrics(spark, str(tmp_path))
    values = {(r.source_file, r.metric): r.value for r in loaded.collect()}
    assert values["mnl_ratio0.01_seed42_metrics", "mnl_accuracy"] == 0.5 and len(values) == 4
    wide = report.results_frame(loaded, ["accuracy", "macro_f1"]).orderBy("fewshot_ratio").collect()
    assert [(r.model, r.accuracy, r.macro_f1) for r in wide] == [("mnl", 0.5, None), ("mnl", 0.6, 0.4)]
    assert [r[0] for r in runs.unreadable_metrics(spark, str(tmp_path)).collect()] == ["broken"]


def test_empty_metric_folder(spark, tmp_path):
    (tmp_path / "broken.json").write_text("[]")
    assert runs.load_all_metrics(spark, str(tmp_path)).count() == 0


# ---- Reports and audits ---------------------------------------------------------------

def test_comparison_counts_every_run_once(spark):
    rows = [("mnl", 0.01, s, "accuracy", v) for s, v in ((42, 0.5), (42, 0.5), (123, 0.7))]
    df = spark.createDataFrame(rows, "model string, fewshot_ratio double, seed int, metric string, value double")
    table = report.comparison_table(df, ["mnl", "other"], [0.01], ["accuracy"]).collect()
    assert table[0].accuracy == pytest.approx(0.6) and table[0].accuracy_std == pytest.approx(0.02 ** 0.5)
    assert table[1].accuracy != table[1].accuracy and table[1].accuracy_std == 0.0


def test_snapshot_compare(spark):
    a = spark.createDataFrame([(1,), (2,)], "main_mode int")
    b = spark.createDataFrame([(1,), (1,)], "main_mode int")
    same, other = audit.snapshot_compare(a, a).first(), audit.snapshot_compare(a, b).first()
    assert same.row_count_matches and same.label_set_matches
    assert other.row_count_matches and not other.label_set_matches


def test_prediction_audit_allows_all_nine_modes(spark):
    df = spark.createDataFrame([("m", 0.01, 1, 9, 8), ("m", 0.01, 1, 7, -1)],
                               "model string, fewshot_ratio double, seed int, main_mode int, predicted_mode int")
    bad = audit.prediction_audit(df).where("not in_domain").collect()
    assert [(r.side, r.label) for r in bad] == [("predicted", -1)]


def test_empty_share_table(spark):
    df = spark.createDataFrame([], "main_mode int, trip_weight double")
    shares = aggregates.mode_shares(df, weight="trip_weight").collect()
    assert len(shares) == 9 and all(r.share == 0.0 for r in shares)


def test_fast_path_of_zone_lookup_is_broadcast_by_size(spark, sf_dir):
    plan = joins.load_joined_2011(st.tables_2011(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---- Scale ----------------------------------------------------------------------------

def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session("spark://host:7077"))
    assert shared_root(session("local[2]"))


def test_hot_household_is_split_at_run_time(spark):
    """A third of all trips belongs to one household and no side may be broadcast."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {key: spark.conf.get(key, None) for key in small}
    trips = spark.range(120_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("q_no"), F.sha1(F.col("id").cast("string")).alias("v"))
    households = spark.range(120_000).select(F.col("id").alias("q_no"), (F.col("id") % 5).alias("a3"))
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        joined = joins.join_household(trips, households, "q_no")
        assert joined.where("q_no = 1 and a3 = 1").count() == 40_001
        rows = joined.collect()
        assert len(rows) == 120_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_sample_plan_ranks_no_whole_stratum(spark, sf_dir):
    flagged = sampling.stratified_flag(st.clean_2022(spark, sf_dir), 0.2, "main_mode", 42)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
