"""Plans and state that decide how the derived tables and the stored runs grow."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from surveyalign.functions.responses import parse_responses
from surveyalign.operators import inference as I
from surveyalign.operators import medians as M
from surveyalign.operators import retrieval as R
from surveyalign.sources import runs
from verification import cases
from verification import survey_tables as st

cases.load_all()

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trip_sorts_its_lines_once(spark):
    """One sort of the lines by order serves the numbering and the join; the other one is that of the orders."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(st.trip(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 1 and plan.count("+- Window") + plan.count(":- Window") == 1
    assert plan.count("Sort [") == 2


def test_clean_runs_compiled(spark):
    """The JVM never compiles a method of more than 8000 bytes; rows then go through it interpreted."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        codes = st.clean_lazy(spark, SF)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000


def test_runs_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """Open files for every run while writing, and not afterwards; runs beyond that number are all written too."""
    setting, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(int(spark.conf.get(setting))), write(self, *a, **b))[1])
    before = spark.conf.get(setting)
    rows = spark.range(0, 400, 1, 1).selectExpr(
        "concat('m', id % 100) AS model", "0.05D AS fewshot_ratio", "42 AS seed", "id", "CAST(id % 9 AS INT) AS predicted_mode")
    runs.write_prediction_sets(rows, str(tmp_path / "sets"))
    assert seen == [runs.OPEN_RUNS] and spark.conf.get(setting) == before
    back = runs.read_prediction_sets(spark, str(tmp_path / "sets")).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_examples_are_grouped_as_codes(spark):
    """Labels and JSON are made of what was grouped, not shuffled and sorted themselves."""
    plan = _plan(cases.QUERIES["render_examples"](spark, SF))
    grouped = plan[plan.rindex("ObjectHashAggregate"):]
    assert "json" not in plan.lower() and "Unknown" not in grouped


@pytest.fixture
def sorted_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _trips(spark):
    """40 trips of 10 vectors."""
    return spark.range(0, 40, 1, 4).selectExpr(
        "concat('c', lpad(id, 3, '0')) AS case_id", "2022 AS survey_year",
        "array(CAST(id % 5 AS DOUBLE), CAST(id % 2 AS DOUBLE) - 0.5, 1D) AS features")


def test_rows_meet_by_a_number_before_their_vectors(spark, sorted_joins, monkeypatch):
    """Wide rows are ordered by the hash of their vector, and by the vector where hashes are equal."""
    trips = _trips(spark)
    found = R.retrieve(trips, R.build_index(trips, 3), 3)
    plan = _plan(found)
    assert re.search(r"SortMergeJoin \[_hash#\d+L, ", plan) and "_hash" not in found.columns
    for r in found.collect():
        assert [n.case_id for n in r.neighbours] == [f"c{int(r.case_id[1:]) % 10 + 10 * i:03d}" for i in range(3)]
    monkeypatch.setattr(R, "materialize", lambda df, name: df)
    assert re.search(r"Sort \[_hash#\d+L ASC", _plan(R._candidates(trips, 3, "case_id", 0)))


def test_equal_hashes_do_not_mix_vectors(spark, monkeypatch):
    monkeypatch.setattr(R, "vector_hash", lambda *parts: F.lit(7).cast("long"))
    trips = _trips(spark)
    found = R.retrieve(trips, R.build_index(trips, 3), 3).collect()
    assert len(found) == 40
    for r in found:
        assert [n.case_id for n in r.neighbours] == [f"c{int(r.case_id[1:]) % 10 + 10 * i:03d}" for i in range(3)]


def test_distinct_queries_are_hashed(spark, monkeypatch):
    monkeypatch.setattr(R, "materialize", lambda df, name: df)
    found = R.distinct_queries(_trips(spark))
    assert "SortAggregate" not in _plan(found)
    assert found.count() == found.select("query_id").distinct().count() == 10


def test_median_of_codes_is_counted(spark, monkeypatch):
    """Where the middle lies within one value, no row is listed; a bracket of two values still is."""
    explode, listed = F.explode, []
    monkeypatch.setattr(M.F, "explode", lambda c: (listed.append(1), explode(c))[1])
    codes = spark.range(0, 1001).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "IF(id % 3 = 0, NULL, 7) AS b")
    assert M.exact_medians(codes, {c: F.col(c) for c in "ab"}) == {"a": 2.0, "b": 7.0} and not listed
    pairs = spark.range(0, 1000).selectExpr("CAST(id % 2 AS DOUBLE) AS a", "id % 5 AS b")
    assert M.exact_medians(pairs, {c: F.col(c) for c in "ab"}) == {"a": 0.5, "b": 2.0} and listed


def test_only_shown_examples_become_demonstrations(spark):
    record = "named_struct('case_id', 'x', 'survey_year', 2022, 'hh_size', 1, 'car_availability', 1, 'age_group', 1, 'sex', 1," \
             "'employment_status', 1, 'income_group', 1, 'trip_purpose', 1, 'departure_period', 1, 'journey_time', 5D," \
             "'origin_zone', '1', 'destination_zone', '2', 'main_mode', 1)"
    evidence = spark.range(1).selectExpr(f"inline(array({record}))").selectExpr(
        "*", *[f"transform(sequence(1, 9), i -> named_struct('rank', i, 'record', {record})) AS {c}" for c in ("historical", "update")],
        "'s' AS prototype_summary")
    prompts = I.build_prompts(evidence.localCheckpoint())
    assert re.search(r"transform\(slice\(historical#\d+, 1, 3\)", _plan(prompts)) and re.search(r"transform\(slice\(update#\d+, 1, 4\)", _plan(prompts))
    text = prompts.first().messages[1].content
    assert text.count("Example 3:") == 2 and text.count("Example 4:") == 1 and "Example 5:" not in text


@pytest.mark.parametrize("query", ["error_isolation", "parse_responses"])
def test_responses_are_parsed_compiled(spark, query):
    codes = cases.QUERIES[query](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
    assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 8000


def test_fallback_takes_the_first_key_with_a_code(spark):
    rows = [('{"mode": 77, "mode_code": "x", "transport_mode": "4", "predicted": 5}', 4), ('{"predicted": true}', 1), ('{"mode": null, "predicted": 3.9}', 3),
            ('{"mode": 2, "mode_code": 8}', 2), ('{"predicted_mode": 0, "transport_mode": null}', 1), ('{"a": 1} {"mode": 7}', 1), ('x {"mode": 7} {"mode": 8}', 7)]
    found = parse_responses(spark.createDataFrame(rows, "raw_response string, want int"))
    assert found.where("predicted_mode <> want").count() == 0
