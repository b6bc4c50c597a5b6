"""Runs that stop and go on: the answer ledger and the stream of subgroup errors."""

import os

import pytest
from pyspark.sql import functions as F

from surveyalign.operators import inference as I
from surveyalign.session import shared_dir
from surveyalign.streaming.memory_feed import feed_subgroup_errors, merge_errors, read_subgroup_errors


def _prompts(spark, n, copies=3):
    rows = spark.range(n * copies).select(F.col("id").alias("case_id"), (F.col("id") % n).cast("string").alias("text"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select("case_id", F.array(message("system", F.lit("s")), message("user", F.concat(F.lit("trip "), "text"))).alias("messages")).repartition(3)


def _asked(log):
    return [line for name in os.listdir(log) for line in open(os.path.join(log, name)).read().splitlines()]


def _logging(log, stop=None, fail=()):
    def predictor(prompts):
        if stop and os.path.exists(stop) and "trip 7" in prompts:
            os._exit(1)
        if any(p in fail for p in prompts):
            raise RuntimeError("rejected")
        with open(os.path.join(log, str(os.getpid())), "a") as out:
            out.writelines(p + "\n" for p in prompts)
        return ['{"predicted_mode": 3, "confidence": 0.5, "reasoning_brief": "ok"}'] * len(prompts)
    return predictor


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    log, stop, ledger = tmp_path / "log", tmp_path / "stop", shared_dir(spark, "ledger")
    log.mkdir()
    stop.touch()
    prompts = _prompts(spark, 60)
    ask = lambda: I.ask_into_ledger(prompts, _logging(str(log), str(stop)), ledger, "p", wave_rows=10, batch_size=4)
    with pytest.raises(Exception):
        ask()
    saved = {r.digest for r in I._read_ledger(spark, ledger).collect()}
    assert len(saved) < 60
    stop.unlink()
    before = len(_asked(log))
    answers = ask()
    assert answers.count() == 60 and answers.where("error IS NOT NULL").isEmpty()
    assert len(_asked(log)) - before == 60 - len(saved)
    assert ask().count() == 60 and len(_asked(log)) - before == 60 - len(saved)
    found = I.batch_inference(prompts, _logging(str(log)), ledger=ledger, predictor_name="p")
    assert found.count() == 180 and found.where("predicted_mode <> 3").isEmpty() and len(_asked(log)) - before == 60 - len(saved)
    other = I.batch_inference(prompts, _logging(str(log)), ledger=ledger, predictor_name="another")
    assert other.count() == 180 and len(_asked(log)) - before == 120 - len(saved)


def test_failed_prompts_are_asked_again(spark, tmp_path):
    ledger, prompts = shared_dir(spark, "ledger"), _prompts(spark, 8)
    run = lambda fail: I.batch_inference(prompts, _logging(str(tmp_path), fail=fail), retry_delay=0.0, ledger=ledger, predictor_name="p")
    assert run(("trip 2", "trip 5")).where("predicted_mode = -1 AND reasoning_brief = 'error: rejected'").count() == 6
    assert run(()).where("predicted_mode = 3").count() == 24
    assert run(("trip 2",)).where("predicted_mode = 3").count() == 24
    empty = I.batch_inference(prompts.limit(0), _logging(str(tmp_path)), ledger=shared_dir(spark, "none"))
    assert empty.count() == 0


def test_rows_that_fail_wait_together(monkeypatch):
    waits, tries = [], []
    monkeypatch.setattr(I.time, "sleep", waits.append)

    def predictor(prompts):
        if len(prompts) == 1:
            tries.append(prompts[0])
        if "bad" in prompts[0] and (len(prompts) > 1 or tries.count(prompts[0]) < 3 or prompts[0] == "bad 0"):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    answer = I.isolated(predictor, max_retries=3, retry_delay=1.0)
    responses, errors = answer(["bad 0", "a", "bad 1", "b"])
    assert waits == [1.0, 2.0] and errors == ["no", None, None, None] and responses == [None, "A", "BAD 1", "B"]


def test_a_replayed_batch_changes_nothing(spark):
    path = shared_dir(spark, "errors")
    batch = lambda *rows: spark.createDataFrame(list(rows), "g string, error double")
    state = lambda: {r.g: r.error for r in read_subgroup_errors(spark, path).collect()}
    assert read_subgroup_errors(spark, path) is None
    run = merge_errors(path, ["g"], keep=2)
    run(batch(("a", 0.1), ("b", 0.2), ("b", 0.3)), 0)
    run(batch(("b", 0.9)), 1)
    run(batch(("c", 0.5), (None, 0.7)), 2)
    wanted = {"a": 0.1, "b": 0.9, "c": 0.5, None: 0.7}
    assert state() == wanted
    run(batch(("c", 0.5), (None, 0.7)), 2)
    assert state() == wanted
    for number in range(3, 7):
        run(batch(("a", float(number))), number)
    assert state() == {**wanted, "a": 6.0}


def test_stream_of_errors_from_files(spark):
    source, path, marks = (shared_dir(spark, n) for n in ("incoming", "errors", "marks"))
    for rows in ([("a", 0.1), ("b", 0.2)], [("b", 0.9)], [("c", 0.4)]):
        spark.createDataFrame(rows, "g string, error double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("g string, error double").parquet(source)
        feed_subgroup_errors(stream, path, marks, ["g"]).awaitTermination(120)
    assert {r.g: r.error for r in read_subgroup_errors(spark, path).collect()} == {"a": 0.1, "b": 0.9, "c": 0.4}
