"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept, and its result is written and read again
before the next: a lost executor costs part of one stage, and Spark knows the true sizes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.llm.common import documents, fresh_name, materialize
from surveyalign.llm.lines import remove_repeated_lines
from surveyalign.llm.minhash import keep_first
from surveyalign.llm.packing import pack
from surveyalign.llm.passages import remove_repeated_passages
from surveyalign.llm.quality import keep_good

TOKENIZER = "word_bpe_49k.json"


def _with_kept_text(docs: DataFrame, cleaned: DataFrame, kept: str, lost) -> DataFrame:
    """Columns of ``docs`` with the kept text; untouched rows stay, rows that lost all their words go.

    ``n_chars`` is counted again where the text changed.
    """
    left = cleaned.where((lost == 0) | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = F.when(lost == 0, F.col("text")).otherwise(F.col(kept))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(lost == 0, F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return left.select(*(value.alias(name) for name, value in columns.items()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the newest quality policy."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line equals or almost equals; blank lines stay."""
    exact, near, kept = (fresh_name(docs, c) for c in ("n_exact", "n_near", "kept_text"))
    cleaned = remove_repeated_lines(docs, exact_chars=1)
    return _with_kept_text(docs, cleaned, kept, F.col(exact) + F.col(near))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: five-word shingles, similarity 0.8."""
    return keep_first(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that an earlier document holds."""
    removed, kept = (fresh_name(docs, c) for c in ("n_removed", "kept_text"))
    cleaned = remove_repeated_passages(docs, keep_layout=True)
    return _with_kept_text(docs, cleaned, kept, F.col(removed))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Near copies within edit distance and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the filters keep."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
