"""Spelling variants: words one edit apart, by a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix a node of the reversed one; both
kinds are numbered. A word with place i skipped is the pair (prefix up to i, suffix after i), a word
cut at i the pair (prefix up to i, suffix from i). Two words that share a skipping pair differ in
one replaced character; a word whose skipping pair is a cutting pair of another has one character
more. So whole-number pairs, joined, give exactly the words one edit apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.llm.common import join_facts, materialize, mix, slices

#: Code points of words that a task takes apart at a time, in bytes.
STRIP_BYTES = 1 << 18

_CUT, _SKIP, _FIRST_SKIP = 0, 1, 2

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)

RUN = "[a-zÀ-ÿ]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_slips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """(word): every letter run of every text, lower-cased (A-Z only), with planted slips.

    Where ``every`` divides h, the crc32 of ``<id>:<run>``, the run loses code point h % length.
    Null texts have no runs; a null id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), lower_ascii(F.col(text_col)).alias("text")).select(
        "id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary"))).select(F.when(F.col("h") % every == 0, slip).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(w, word, n), stored: the words that are long and frequent enough; ``w`` grows in code-point order."""
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return materialize(counted.orderBy("word").select(F.monotonically_increasing_id().alias("w"), "word", "n"), "vocabulary")


def _chains(codes: np.ndarray, first: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """128-bit identities of trie nodes, [2, nodes]: node t of a word continues its node t - 1 by one character.

    Words are concatenated in ``codes``; nodes of a word lie together, the root first. ``step`` is
    1 for prefixes and -1 for suffixes, whose first character is the word's last.
    """
    nodes = np.empty((2, int((lengths + 1).sum())), np.uint64)
    root = np.cumsum(lengths + 1) - (lengths + 1)
    nodes[:, root] = _FACTORS[:, None]
    order = np.argsort(-lengths, kind="stable")
    start = first if step == 1 else first + lengths - 1
    left = np.sort(lengths)
    for t in range(int(lengths.max(initial=0))):
        active = order[:len(left) - np.searchsorted(left, t, side="right")]
        char = codes[start[active] + step * t].astype(np.uint64) + np.uint64(1)
        nodes[:, root[active] + t + 1] = mix(nodes[:, root[active] + t] * _FACTORS[::-1, None] + char * _FACTORS[:, None])
    return nodes


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word its cutting pairs and skipping pairs, both nodes by their identity."""
    for batch in batches:
        for part in slices(batch, "word", STRIP_BYTES):
            words = part.column("word").to_pylist()
            lengths = np.array([len(word) for word in words], np.int64)
            codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            first = np.cumsum(lengths) - lengths
            forward, backward = _chains(codes, first, lengths, 1), _chains(codes, first, lengths, -1)
            root = np.cumsum(lengths + 1) - (lengths + 1)
            # Place i of a word: prefix node i; suffix node length - i is what follows a cut at i.
            cut_word = np.repeat(np.arange(len(words)), lengths + 1)
            cut_at = np.arange(len(cut_word)) - root[cut_word]
            skip_word = np.repeat(np.arange(len(words)), lengths)
            skip_at = np.arange(len(skip_word)) - first[skip_word]
            new_run = np.ones(len(codes), bool)
            new_run[1:] = codes[1:] != codes[:-1]
            kind = np.concatenate([np.full(len(cut_word), _CUT), np.where((skip_at == 0) | new_run, _FIRST_SKIP, _SKIP)])
            word = np.concatenate([cut_word, skip_word])
            prefix = root[word] + np.concatenate([cut_at, skip_at])
            suffix = root[word] + np.concatenate([lengths[cut_word] - cut_at, lengths[skip_word] - skip_at - 1])
            row = part.column("w").to_numpy()[word], part.column("n").to_numpy()[word], kind.astype(np.int8)
            yield pa.record_batch([pa.array(c) for c in (*row, *forward[:, prefix].view(np.int64), *backward[:, suffix].view(np.int64))],
                                  ["w", "n", "kind", "p1", "p2", "s1", "s2"])


def _numbered(pairs: DataFrame, keys: list[str], number: str, total: int) -> DataFrame:
    """``pairs`` with the number of a trie node in place of its identity."""
    nodes = materialize(pairs.groupBy(*keys).agg(F.count("*").alias("size")).withColumn(number, F.monotonically_increasing_id()), "nodes")
    return join_facts(pairs, nodes, keys, "size", total).drop(*keys)


def near_words(words: DataFrame) -> DataFrame:
    """(w, n_near, best) of the words of a ``vocabulary`` that have words one edit apart.

    ``best`` is (n, w) of the most frequent of them, the smallest among equals. A skipping pair is
    shared by words that differ in one character, and at most one word owns a cutting pair, so a
    group never has more members than the alphabet has letters, and one.
    """
    pairs = materialize(words.mapInArrow(_pairs, "w long, n long, kind byte, p1 long, p2 long, s1 long, s2 long"), "pairs")
    total = pairs.count()
    joined = _numbered(_numbered(pairs, ["p1", "p2"], "prefix", total), ["s1", "s2"], "suffix", total)
    groups = joined.groupBy("prefix", "suffix").agg(F.collect_list(F.struct((-F.col("n")).alias("minus"), "w", "kind")).alias("members")).where(F.size("members") > 1)

    def near(one, other):
        both_skip = (one["kind"] != _CUT) & (other["kind"] != _CUT)
        longer = ((one["kind"] == _FIRST_SKIP) & (other["kind"] == _CUT)) | ((one["kind"] == _CUT) & (other["kind"] == _FIRST_SKIP))
        return (one["w"] != other["w"]) & (both_skip | longer)

    each = groups.select("members", F.explode("members").alias("one")).select(
        F.col("one.w").alias("w"), F.filter("members", lambda other: near(F.col("one"), other)).alias("others")).where(F.size("others") > 0)
    return each.groupBy("w").agg(F.sum(F.size("others")).cast("long").alias("n_near"), F.min(F.array_min("others")).alias("best")).select(
        "w", "n_near", F.struct((-F.col("best.minus")).alias("n"), F.col("best.w").alias("w")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(w, root) of words with a form. Counts double along a chain, so it has at most 63 links and a few doublings."""
    now = materialize(forms.select("w", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("w").alias("at"), F.col("root").alias("next"))
        after = materialize(now.join(further, now.root == further["at"], "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("w", "root")
        now = after.select("w", "root")


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of a ``vocabulary``.

    ``n_near`` counts the words at one inserted, deleted or replaced code point. ``form`` is the
    most frequent of them (ties: the smallest) if it occurs ``ratio`` times as often as the word
    or more, else null, and ``form_n`` its count; ``root`` is where the chain of forms ends, the
    word itself without a form. ``ratio`` is 2 or more. An empty vocabulary gives an empty result.

    Trie nodes are told apart by 128-bit hash chains of their characters before they are numbered:
    with 10 ** 12 nodes two share a number with a chance below 10 ** -14.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    found = words.join(near_words(words), "w", "left")
    enough = F.col("best.n") >= ratio * F.col("n")
    judged = materialize(found.select("w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"),
                                      F.when(enough, F.col("best.n")).alias("form_n")), "judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    form_names = words.select(F.col("w").alias("form"), F.col("word").alias("form_word"))
    root_names = words.select(F.col("w").alias("root"), F.col("word").alias("root_word"))
    named = judged.join(form_names, "form", "left").join(roots, "w", "left").join(root_names, "root", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
