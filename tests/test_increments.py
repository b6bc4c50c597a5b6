"""Tallies of new files, differences of snapshots, quarantined csv lines."""

import pytest
from pyspark.sql import functions as F

from surveyalign.operators import audit as D
from surveyalign.operators import metrics as M
from surveyalign.session import shared_dir
from surveyalign.sources import runs, tables

RUN = ["model", "fewshot_ratio", "seed"]


def _predictions(spark, seeds, shift=0):
    rows = [("mnl", 0.05, s, 1 + i % 3, 1 + (i * s + shift) % 3 if i % 9 else -1, i % 2 + 1, 1 + i % 4, 1.0 + i % 5) for s in seeds for i in range(60)]
    return spark.createDataFrame(rows, "model string, fewshot_ratio double, seed int, main_mode int, predicted_mode int, sex int, age_group int, trip_weight double")


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_an_increment_equals_a_full_tally(spark):
    path, state, groups = shared_dir(spark, "predictions"), shared_dir(spark, "state"), ["sex", "age_group"]
    tally = lambda: {r.file for r in runs.tally_new_files(spark, path, state, groups).collect()}

    def equals_full():
        full = M.evaluate_all(runs.read_prediction_sets(spark, path), RUN, groups)
        assert [_rows(f) for f in runs.evaluate_tallied(spark, path, state, groups)] == [_rows(f) for f in full]

    runs.write_prediction_sets(_predictions(spark, [1, 2]).coalesce(1), f"{path}/a")
    assert len(tally()) == 2 and tally() == set()
    equals_full()
    runs.write_prediction_sets(_predictions(spark, [3]).coalesce(1), f"{path}/b")
    assert all("/b/" in f for f in tally())
    equals_full()
    runs.write_prediction_sets(_predictions(spark, [1, 2], shift=1).coalesce(1), f"{path}/a")   # replaces both files
    changed = tally()
    assert len(changed) == 2 and all("/a/" in f for f in changed)
    equals_full()
    # A tally whose list of files was never written does not count.
    spark.read.parquet(f"{state}/cube").limit(5).withColumn("batch", F.lit("lost")).write.mode("append").parquet(f"{state}/cube")
    equals_full()


def test_snapshot_differences(spark):
    rows = [(i, f"t{i}", float(i)) for i in range(3000)] + [(None, None, None), (None, None, None)]
    cached = spark.createDataFrame(rows, "k long, `a b` string, v double").repartition(3)
    assert D.snapshot_diff(cached, cached.repartition(7), ["k"]).count() == 0
    assert D.snapshot_diff(cached.limit(0), cached.limit(0), ["k"]).count() == 0
    fresh = [(i, f"t{i}", -1.0 if i == 7 else float(i)) for i in range(3000) if i != 9] + [(8, "t8", 8.0), (5000, None, 1.0), (None, None, None)]
    found = D.snapshot_diff(cached, spark.createDataFrame(fresh, cached.schema), ["k"], D.snapshot_tree(cached, ["k"])).collect()
    assert {r.k: (r.status, r.n_cached, r.n_fresh) for r in found} == {
        7: ("changed", 1, 1), 8: ("count", 1, 2), 9: ("removed", 1, 0), 5000: ("added", 0, 1), None: ("count", 2, 1)}
    # A value that moves to the column beside it, with a null in its place, is a change.
    left, right = (spark.createDataFrame([(1, *pair)], "k long, a string, b string") for pair in (("x", None), (None, "x")))
    assert [r.status for r in D.snapshot_diff(left, right, ["k"]).collect()] == ["changed"]


def test_bad_lines_are_set_aside(spark):
    path, bad = shared_dir(spark, "lines"), shared_dir(spark, "bad")
    lines = ["id,name,n", '1,"a, b",2', "2,,", '3,"open,4', "4,x", "5,x,1,2", "six,x,1", "", '"id","name","n"', '7,"he said ""no""",3', "8,x,9.5"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(path)
    good = {r.id: (r.name, r.n) for r in tables.read_csv_quarantined(spark, path, "id int, name string, n int", bad).collect()}
    assert good.keys() == {1, 2, 7} and good[1] == ("a, b", 2) and good[2] == (None, None) and good[7][1] == 3
    assert {r.line: r.reason for r in spark.read.parquet(bad).collect()} == {
        '3,"open,4': "quotes", "4,x": "short", "5,x,1,2": "long", "six,x,1": "value", "8,x,9.5": "value"}
    empty = shared_dir(spark, "none")
    spark.createDataFrame([], "value string").write.text(empty)
    assert tables.read_csv_quarantined(spark, empty, "id int", shared_dir(spark, "bad")).count() == 0


def test_a_tally_names_runs_after_it_counts(spark):
    path = shared_dir(spark, "predictions")
    runs.write_prediction_sets(_predictions(spark, [1, 2]), path)
    found = runs._tally(spark.read.option("recursiveFileLookup", True).parquet(path), ["sex"], "trip_weight")
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate ", 1)[1].split("\n", 1)[1]
    assert "Relation" in below and "regexp" not in below
    assert {tuple(r) for r in found.select(*RUN).distinct().collect()} == {("mnl", 0.05, 1), ("mnl", 0.05, 2)}
