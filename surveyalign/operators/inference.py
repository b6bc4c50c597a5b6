"""Batch prediction over prompts with a caller-supplied predictor."""

from __future__ import annotations

import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.responses import parse_responses
from surveyalign.functions.text import context, demonstration, evidence_messages, profile_messages
from surveyalign.operators.prototypes import PrototypeMemory, attach_prototype
from surveyalign.operators.retrieval import RetrievalIndex, retrieve_all
from surveyalign.session import materialize, shared_dir

Predictor = Callable[[list[str]], list[str]]


def retrieve_evidence(
    queries: DataFrame,
    historical: RetrievalIndex | None = None,
    fewshot: RetrievalIndex | None = None,
    prototypes: PrototypeMemory | None = None,
    top_k: int = fv.TOP_K,
) -> DataFrame:
    """Evidence per encoded query row: half of ``top_k`` historical and ``top_k`` few-shot trips.

    Adds the arrays ``historical`` and ``update`` of neighbours and the prototype columns.
    A memory that is not given leaves its array empty.
    """
    searches = {"historical": (historical, top_k // 2), "update": (fewshot, top_k)}
    given = {name: (index, k) for name, (index, k) in searches.items() if index is not None}
    if not given:
        raise ValueError("no memory to retrieve from")
    found = retrieve_all(queries, given)
    for name in searches:
        if name not in given:
            found = found.withColumn(name, F.array().cast(found.schema[next(iter(given))].dataType))
    return attach_prototype(found, prototypes)


def build_prompts(evidence: DataFrame, max_historical: int = 3, max_update: int = 4) -> DataFrame:
    """Add ``messages``: the system and user message of every row with evidence."""
    # Only the examples that are shown become demonstrations.
    demos = lambda name, shown: F.transform(F.slice(name, 1, shown), lambda n: demonstration(n["record"]))
    return evidence.withColumn("messages", evidence_messages(
        context(), F.col("prototype_summary"), demos("historical", max_historical), demos("update", max_update),
        max_historical, max_update))


def build_zero_shot_prompts(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", profile_messages(context()))


def majority_predictor(prompts: list[str]) -> list[str]:
    """Local stand-in for a model: the most frequent mode among the examples of each prompt."""
    codes = {label: code for code, label in fv.MODE_LABELS.items()}
    answers = []
    for prompt in prompts:
        seen = Counter(re.findall(r"→ Mode: (.+)", prompt))
        if not seen:
            answers.append('{"predicted_mode": 1, "confidence": 0.1, "reasoning_brief": "no examples"}')
            continue
        label, votes = min(seen.items(), key=lambda item: (-item[1], codes.get(item[0], 0)))
        answers.append(
            f'{{"predicted_mode": {codes.get(label, 1)}, "confidence": {votes / sum(seen.values()):.3f}, '
            f'"reasoning_brief": "{votes} of {sum(seen.values())} examples"}}')
    return answers


def isolated(predictor: Predictor, max_retries: int = 3, retry_delay: float = 5.0):
    """Predictor over a batch whose failures stay with their own row.

    A batch that fails is halved, and halves that fail are halved again, so one bad row among n
    costs about 2 log2(n) calls more. Rows that fail alone are tried ``max_retries`` times in all,
    with one doubling wait before each further round of them, and then answered by their error.
    Returns (responses, errors).
    """
    def call(prompts: list[str]) -> list[str]:
        responses = predictor(prompts)
        if len(responses) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts, {len(responses)} responses")
        return [r or "" for r in responses]

    def run(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        try:
            return call(prompts), [None] * len(prompts)
        except Exception as error:
            if len(prompts) == 1:
                return [None], [str(error)[:100]]
            half = len(prompts) // 2
            left, right = run(prompts[:half]), run(prompts[half:])
            return left[0] + right[0], left[1] + right[1]

    def answer(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
        if not prompts:
            return [], []
        responses, errors = run(prompts)
        for attempt in range(max_retries - 1):
            bad = [i for i, error in enumerate(errors) if error is not None]
            if not bad:
                break
            time.sleep(retry_delay * 2 ** attempt)
            for i in bad:
                [responses[i]], [errors[i]] = run([prompts[i]])
        return responses, errors

    return answer


def prompt_digest(predictor_name: str) -> Column:
    """Digest of all ``messages`` of a row and the name of who answers them."""
    told = F.transform("messages", lambda m: F.concat_ws("\x01", m["role"], m["content"]))
    return F.sha2(F.concat_ws("\x00", F.lit(predictor_name), F.array_join(told, "\x02")), 256)


_LEDGER = "digest string, raw_response string, error string"


def ask_into_ledger(
    prompts: DataFrame, predictor: Predictor, ledger: str, predictor_name: str,
    max_retries: int = 3, retry_delay: float = 5.0, batch_size: int = 256, wave_rows: int = 100_000,
) -> DataFrame:
    """Answers (digest, raw_response, error) to all ``messages``, kept in the table at ``ledger``.

    Every distinct prompt is asked once; those that the ledger has an answer to are not asked
    again, those that failed are. Prompts go out in waves of about ``wave_rows``, each an append
    of its own: a run that is stopped and started again loses at most the wave it was in. The
    ledger belongs in a folder that outlives the application.
    """
    spark = prompts.sparkSession
    digest = prompt_digest(predictor_name).alias("digest")
    wanted = prompts.select(digest, F.element_at("messages", -1)["content"].alias("prompt")).groupBy("digest").agg(F.min("prompt").alias("prompt"))
    told = _read_ledger(spark, ledger)
    todo = materialize(wanted.join(told.where("error IS NULL"), "digest", "left_anti"), "todo")
    n = todo.count()
    waves = math.ceil(n / wave_rows)
    answer = isolated(predictor, max_retries, retry_delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start:start + batch_size]
                responses, errors = answer(part["prompt"].tolist())
                yield pd.DataFrame({"digest": part["digest"], "raw_response": responses, "error": errors})

    folder = shared_dir(spark, "waves")
    wave = F.pmod(F.xxhash64("digest"), F.lit(max(1, waves))).cast("int")
    if n:
        # A folder per wave: a wave reads its own prompts only.
        todo.withColumn("wave", wave).repartition("wave", F.pmod(F.hash("digest"), F.lit(max(1, math.ceil(wave_rows / 2000))))).write.partitionBy("wave").parquet(folder)
    for w in range(waves):
        part = spark.read.schema("digest string, prompt string, wave int").parquet(folder).where(F.col("wave") == w).drop("wave")
        part.mapInPandas(run, _LEDGER).write.mode("append").parquet(ledger)
    return _read_ledger(spark, ledger)


def _read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per digest, an answer rather than an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LEDGER)
    rows = spark.read.schema(_LEDGER).parquet(ledger)
    best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "raw_response", "error")).alias("a")
    return rows.groupBy("digest").agg(best).select("digest", "a.raw_response", "a.error")


def batch_inference(
    prompts: DataFrame,
    predictor: Predictor = majority_predictor,
    key: str = "case_id",
    max_retries: int = 3,
    retry_delay: float = 5.0,
    batch_size: int = 256,
    ledger: str | None = None,
    predictor_name: str = "",
) -> DataFrame:
    """Predict every row with ``messages``: key, prototype id, example counts and the parsed answer.

    The predictor runs inside the tasks on Arrow batches; only the key, the prompt and the
    small evidence columns are shipped to it, at most ``batch_size`` prompts a call. A failed
    row has mode -1 and its error text. With a ``ledger`` (see ``ask_into_ledger``) equal prompts
    are asked once, and a run that was stopped goes on where it was.
    """
    has = lambda c: c in prompts.columns
    slim = prompts.select(
        key,
        F.element_at("messages", -1)["content"].alias("prompt"),
        (F.col("prototype_id") if has("prototype_id") else F.lit(-1)).alias("prototype_id"),
        (F.size("historical") if has("historical") else F.lit(0)).alias("n_hist_examples"),
        (F.size("update") if has("update") else F.lit(0)).alias("n_update_examples"),
        prompt_digest(predictor_name).alias("digest"),
    )
    answer = isolated(predictor, max_retries, retry_delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start:start + batch_size]
                responses, errors = answer(part["prompt"].tolist())
                yield part.drop(columns="prompt").assign(raw_response=responses, error=errors)

    if ledger is None:
        slim = slim.drop("digest")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("prompt").schema)
        answered = slim.mapInPandas(run, f"{fields}, raw_response string, error string")
    else:
        answers = ask_into_ledger(prompts, predictor, ledger, predictor_name, max_retries, retry_delay, batch_size)
        answered = slim.drop("prompt").join(answers, "digest").drop("digest")
    parsed = parse_responses(answered)
    failed = F.col("error").isNotNull()
    return parsed.select(
        key,
        F.when(failed, -1).otherwise(F.col("predicted_mode")).alias("predicted_mode"),
        F.when(failed, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(failed, F.concat(F.lit("error: "), F.col("error")))
        .otherwise(F.col("reasoning_brief")).alias("reasoning_brief"),
        F.when(failed, -1).otherwise(F.col("prototype_id")).alias("prototype_id"),
        "n_hist_examples", "n_update_examples",
    )


def usage_summary(log: DataFrame) -> DataFrame:
    """Token totals and calls of a response log (prompt_tokens, completion_tokens)."""
    return log.agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (F.sum("prompt_tokens") + F.sum("completion_tokens")).alias("total_tokens"),
        F.count(F.lit(1)).alias("call_count"),
    )
