"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one bit
per failed rule; policies are masks over those bits, so a new policy or an ablation reads the
narrow ledger and never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import (covered, fresh_name, slices, span_hashes, text_buffer, window_hashes, window_rows,
                                    word_spans, mix)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper", "n_letters", "n_stutters"]

WINDOW = 8

#: Rule name -> SQL condition of failure over the measures. The position is the bit.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "few_letter_words": "100 * n_letter_words < 60 * n_words",
    "upper_case": "2 * n_upper > n_letters",
    "stutter": "100 * n_stutters > 30 * n_words",
}

#: The two rules that every policy holds.
BASE_RULES = ("too_few_words", "repeated_windows")

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BASE_RULES,
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "few_letter_words", "upper_case"),
    "v2": tuple(RULES),
}

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_WORDY = _LETTER | (np.arange(256) >= 128)


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _per_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a text column, one pass over its bytes."""
    data, rows = text_buffer(column)
    n = len(rows) - 1
    starts, ends, first = word_spans(data, rows)
    n_words = np.diff(first)
    in_word = np.zeros(len(data) + 1, np.int64)
    in_word[starts] += 1
    np.subtract.at(in_word, ends, 1)
    in_word = np.cumsum(in_word[:-1]) > 0
    letters_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_WORDY[data], out=letters_before[1:])
    letter_word = letters_before[ends] > letters_before[starts]

    # Lines: cut at \n and at the row ends; a line counts if a word begins in it.
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    cut[:-1] |= data == 10
    line_from = np.flatnonzero(cut[:-1])
    line_to = np.append(line_from[1:], len(data)) if len(line_from) else line_from
    if len(line_from):
        line_from = line_from + (data[line_from] == 10)
        # A row that begins with \n has an empty line before it, which holds no word.
    has_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[has_word], line_to[has_word]
    line_row = np.searchsorted(rows, line_from, side="right") - 1
    key = span_hashes(data, line_from, line_to) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    repeated = np.ones(len(key), bool)
    repeated[np.unique(key, return_index=True)[1]] = False

    words = span_hashes(data, starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][n_words > 0]] = False
    at, window_row = window_rows(first, WINDOW)
    key = window_hashes(words, WINDOW)[at] ^ mix(window_row.astype(np.uint64) + np.uint64(1))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = covered(at[counts[inverse] > 1] if len(at) else at, WINDOW, len(starts))
    return {
        "n_words": n_words,
        "word_chars": _per_row(in_word & ((data & 0xC0) != 0x80), rows),
        "n_symbols": _per_row(_SYMBOL[data], rows),
        "n_dup_lines": np.bincount(line_row[repeated], minlength=n),
        "n_repeat_words": _per_row(hit, first),
        "n_lines": np.bincount(line_row, minlength=n),
        "n_letter_words": _per_row(letter_word, first),
        "n_upper": _per_row(_UPPER[data], rows),
        "n_letters": _per_row(_LETTER[data], rows),
        "n_stutters": _per_row(again, first),
    }


def _bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("int")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measures and ``fail_bits``.

    A null text counts as empty: all measures 0, so ``too_few_words`` fails. Null or repeated
    ids keep their rows. Other columns are not carried, so their names cannot clash. An empty
    table gives an empty ledger.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = measure(part.column("text"))
                yield pa.record_batch([part.column("id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], ["id", *MEASURES])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    measured = source.mapInArrow(run, schema)
    return measured.withColumn("fail_bits", _bits()).withColumnRenamed("id", id_col)


def apply_policy(entries: DataFrame, policy: str = "v2", verdict: str = "kept") -> DataFrame:
    """Ledger rows with ``base_failed`` and the verdict of one policy."""
    base, full = mask(BASE_RULES), mask(POLICIES[policy])
    return entries.withColumn("base_failed", F.col("fail_bits").bitwiseAND(base) != 0).withColumn(
        verdict, F.col("fail_bits").bitwiseAND(base | full) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, and those that only it rejects.

    The ledger first shrinks to one row per bit pattern (at most 2 ** rules), combined before
    the shuffle; the rest is arithmetic on those patterns.
    """
    spark = entries.sparkSession
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(p, r, mask(rules), mask([r])) for p, rules in POLICIES.items() for r in rules]
    policies = spark.createDataFrame(rows, "policy string, rule string, policy_mask int, rule_mask int")
    in_policy = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    hit = in_policy.bitwiseAND(F.col("rule_mask")) != 0
    return patterns.join(policies, F.col("fail_bits") >= 0).groupBy("policy", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(in_policy == F.col("rule_mask"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(in_policy != 0, F.col("n")).otherwise(0)).alias("n_rejected"))


def keep_good(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the policy keeps, all columns unchanged, in one pass without a shuffle."""
    extra = fresh_name(docs, "fail_bits")
    full = mask(BASE_RULES) | mask(POLICIES[policy])
    names, where = docs.columns, docs.columns.index(text_col)
    inner = [f"c{i}" for i in range(len(names))]
    source = docs.toDF(*inner)
    schema = T.StructType([*source.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner[where], 1 << 20):
                found = measure(part.column(where))
                yield pa.record_batch([*part.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)], [*inner, *MEASURES])

    judged = source.mapInArrow(run, schema).withColumn(extra, _bits())
    return judged.where(F.col(extra).bitwiseAND(full) == 0).select(*inner).toDF(*names)
