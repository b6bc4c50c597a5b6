"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, one spelling of
equivalent words, punctuation as blanks. Where a line may or may not be a copyright line, the
text has a form for either case. Its digest is looked up in the digests of known
licence texts by a hash join. Whole documents are looked up, and each of their lines, where
licence notices stand inside other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.llm.common import materialize
from surveyalign.llm.licence_texts import EQUIVALENT_SPELLINGS, LICENCE_TEXTS

_START = r"^[^\p{L}\p{N}(]*"

#: Lines that begin like a copyright line, those that surely are one, and those that may be an item (c) of a list.
_LIKE = _START + r"(copyright|\(c\)|©|all rights reserved)"
_SURE = _START + r"(copyright[\s:]*(\(c\)|©|\p{Nd}{4})|\(c\)\s*(copyright|\p{Nd}{4})|©|all rights reserved)"
_ITEM = _START + r"\(c\)"


def canonical_line(line: Column) -> Column:
    """(words, doubt): canonical form of a line; ``doubt`` is 0 for ordinary lines and 3 for sure copyright lines.

    Between them are 1, a line that begins with the word only, as wrapped licences do, and 2, (c) alone.
    """
    low = F.lower(line)
    # A blank at the end, for spellings that need one after them.
    plain = F.concat(low, F.lit(" "))
    for spelling, common in EQUIVALENT_SPELLINGS.items():
        plain = F.replace(plain, F.lit(spelling), F.lit(common))
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    doubt = F.when(~low.rlike(_LIKE), 0).when(low.rlike(_SURE), 3).when(low.rlike(_ITEM), 2).otherwise(1)
    return F.struct(words.alias("words"), doubt.alias("doubt"))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines of a text that keep a word; null for null."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda line: line["words"] != "")


def canonical_texts(lines: Column) -> Column:
    """Canonical forms of a whole text: with all lines, then without those of doubt 3, 2 and more, 1 and more.

    The first two do not depend on where a known text is wrapped; the others find texts below a
    notice without sign and year.
    """
    def form(least: int) -> Column:
        return F.array_join(F.transform(F.filter(lines, lambda line: line["doubt"] < least), lambda line: line["words"]), " ")

    return F.when(F.exists(lines, lambda line: line["doubt"] > 0), F.array_distinct(F.array(*map(form, (4, 3, 2, 1))))).otherwise(F.array(form(4)))


def known_licences(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, size, licence): digests of known texts; ``texts`` has columns licence and text.

    Texts with the same canonical form count as the licence that sorts first.
    """
    if texts is None:
        texts = spark.createDataFrame([(name, text) for name, variants in LICENCE_TEXTS.items() for text in variants], "licence string, text string")
    found = texts.select("licence", F.explode(canonical_texts(canonical_lines(F.col("text")))).alias("canonical")).where("canonical <> ''")
    return found.groupBy(F.sha2("canonical", 256).alias("digest"), F.length("canonical").alias("size")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``licence`` of the whole text, ``notices`` and ``n_notices``.

    ``notices`` lists, sorted and distinct, the licences of which the text holds a line;
    ``n_notices`` counts such lines. A null or empty text has none. Repeated rows and ids and
    null ids keep their rows: rows are told apart by number, not by id. Other columns are not
    carried. An empty table gives an empty result.

    Texts are read once and never shuffled: one pass stores the digests, which are only taken of
    forms as long as some known form, and those few are joined with the known ones. The lengths
    of known forms are collected; their number is bounded by the list of licences.
    """
    known = known_licences(docs.sparkSession, texts)
    sizes = known.agg(F.collect_set("size").alias("sizes")).first()["sizes"]
    rows = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))

    def digested(forms: Column) -> Column:
        return F.coalesce(F.transform(F.filter(forms, lambda x: F.length(x).isin(sizes)), lambda x: F.sha2(x, 256)), F.array())

    digests = rows.select("id", digested(canonical_texts(F.col("lines"))).alias("own"), digested(F.col("lines")["words"]).alias("of_lines"))
    table = materialize(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    asked = table.select("row", F.lit(True).alias("whole"), F.explode("own").alias("digest")).union(
        table.select("row", F.lit(False), F.explode("of_lines")))
    found = asked.join(known.select("digest", "licence"), "digest").groupBy("row").agg(
        F.min(F.when(F.col("whole"), F.col("licence"))).alias("licence"), F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("notices"),
        F.count(F.when(~F.col("whole"), 1)).alias("n_notices"))
    joined = table.select("row", "id").join(found, "row", "left")
    return joined.select(F.col("id").alias(id_col), "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
                         F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
