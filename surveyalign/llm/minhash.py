"""Near-duplicate documents by bottom-k sketches from one hash function.

A sketch holds the k smallest shingle hashes of a document. Two sets with similarity t or more
share at least ``need`` retained values (always for small sets, else up to about one pair in
10**9, see ``overlap_needed``), so each document enters the inverted lists of its
``|sketch| - need + 1`` rarest values only. That leaves passages shared by many documents out:
their values are frequent, and a document has rarer ones. Lists with the same first member form
one cluster, and clusters are compared in tiles of bounded size: the union sketch of a pair
estimates its similarity, and the full shingle sets verify what the estimate lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyalign.llm.common import distinct, lowered, materialize, slices, span_hashes, text_buffer, window_hashes, window_rows, word_spans
from surveyalign.llm.components import connected_components

KEPT_VALUES = 48

#: Shared values that a linked pair of large documents is sure to have. With similarity 0.85
#: fewer have a chance of 7e-13, with 0.8 one of 9e-10.
SURE_OVERLAP = 20

TILE = 512

#: Shingle columns of one matrix product.
COLUMNS = 4096


def overlap_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Retained values that a document of ``n`` shingles must share with any document it links to."""
    return np.minimum(SURE_OVERLAP, -(-n * percent // 100))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; the whole sequence where words are fewer, none without words."""
    data, rows = text_buffer(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, rows)
    words = span_hashes(data, starts, ends)
    at, row = window_rows(first, size)
    found = window_hashes(words, size)[at]
    cuts = np.searchsorted(row, np.arange(len(rows)))
    out = []
    for r in range(len(rows) - 1):
        if cuts[r + 1] > cuts[r]:
            out.append(distinct(found[cuts[r]:cuts[r + 1]]))
        else:
            own = words[first[r]:first[r + 1]]
            out.append(window_hashes(own, len(own)) if len(own) else np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, sketch): set size, digest of the set, the least hashes as 64-bit integers in order."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                yield pa.record_batch([
                    part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s[:KEPT_VALUES].tobytes() for s in sets], pa.binary())], ["id", "n", "key", "sketch"])

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("sketch", T.BinaryType())])
    return source.mapInArrow(run, schema)


def _values(classes: DataFrame) -> DataFrame:
    """(value, node) of every retained hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(s.as_buffer(), "<i8") for s in batch.column("sketch")]
            if found:
                node = np.repeat(batch.column("node").to_numpy(), [len(f) for f in found])
                yield pa.record_batch([pa.array(np.concatenate(found)), pa.array(node)], ["value", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "value long, node long")


def _clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(leader, node): every document with the least member of each of its inverted lists."""
    values = _values(classes)
    frequent = values.groupBy("value").agg(F.count("*").alias("freq")).where("freq > 1")
    shared = values.join(frequent, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("shared"))
    need = F.least(F.lit(SURE_OVERLAP), F.ceil(F.col("n") * percent / 100)).cast("int")
    kept = F.least(F.col("n"), F.lit(KEPT_VALUES)).cast("int")
    # Values that no other document retains are the rarest and take their places first.
    places = F.greatest(kept - need + 1 - (kept - F.size("shared")), F.lit(0))
    index = materialize(shared.join(classes.select("node", "n"), "node").select("node", F.explode(F.slice("shared", 1, places)["value"]).alias("value")), "index")
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))
    leaders = index.groupBy("value").agg(F.min(order)["node"].alias("leader"), F.count("*").alias("members")).where("members > 1")
    return index.join(leaders, "value").select("leader", "node").distinct()


def _tiled(clusters: DataFrame) -> DataFrame:
    """Adds (i, j): a cluster of s documents is cut into chunks of about ``TILE``, and each pair of chunks is a tile."""
    sizes = clusters.groupBy("leader").agg(F.count("*").alias("s"), F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    chunks = F.ceil(F.col("s") / TILE).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int").alias("c")
    spread = clusters.join(sizes.select("leader", chunks.alias("chunks")), "leader").select("leader", "node", "chunks", chunk)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
    return spread.select("leader", "node", "c", other).select(
        "leader", "node", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))


def _matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the values that two sets hold."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = counts[column] > 1
    place = np.cumsum(counts > 1) - 1
    row, column = row[wanted], place[column[wanted]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def union_estimates(left: np.ndarray, right: np.ndarray, k: int = KEPT_VALUES) -> np.ndarray:
    """Similarity of pairs of full sketches: the share of the k least values of the union that both hold."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    inside = np.cumsum(~again, axis=1) <= k
    return (again & inside).sum(axis=1) / k


def _promising(percent: int):
    """Documents of a tile that have a partner whose estimate does not rule a link out."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in pdf["sketch"]]
        shared = _matrix(sets)
        needed = np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n)
        need = overlap_needed(n, percent)
        a, b = np.nonzero(np.triu(needed & (shared >= np.maximum.outer(need, need)), 1))
        full = np.array([len(s) == KEPT_VALUES for s in sets])
        keep = np.ones(len(a), bool)
        check = np.flatnonzero(full[a] & full[b])
        if len(check):
            stack = np.stack([s if f else np.zeros(KEPT_VALUES, np.uint64) for s, f in zip(sets, full)])
            for k in range(0, len(check), 20_000):
                c = check[k:k + 20_000]
                keep[c] = union_estimates(stack[a[c]], stack[b[c]]) >= SURE_OVERLAP / KEPT_VALUES
        return pdf.loc[np.unique(np.concatenate([a[keep], b[keep]])), ["leader", "i", "j", "node"]]
    return run


def forest(linked: np.ndarray) -> np.ndarray:
    """Least index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, new)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verified(percent: int):
    """Links (a, b) of a tile that hold its components together, from the full shingle sets."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        n = np.array([len(s) for s in sets], np.int64)
        common = _matrix(sets).astype(np.int64)
        union = np.add.outer(n, n) - common
        label = forest((common * 100 >= percent * union) & ~np.eye(len(n), dtype=bool))
        node = pdf["node"].to_numpy()
        away = label != np.arange(len(n))
        return pd.DataFrame({"a": node[away], "b": node[label[away]]})
    return run


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted classes, one row each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        classes.join(wanted, "node", "left_semi").select("node", "key", F.col("first_id").alias("id")), "id").select("node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"), size)
                right = [i for i, (s, key) in enumerate(zip(sets, part.column("key").to_pylist())) if len(s) and digest(s) == key]
                yield pa.record_batch([part.column("node").take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())],
                                      ["node", "shingles"])

    found = rows.mapInArrow(run, "node long, shingles binary")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
                yield pa.record_batch([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    # Classes whose rows all have null ids are found by the digest of their sets.
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(text_col).alias("text")).mapInArrow(keyed, "key binary, shingles binary")
    unnamed = classes.where(F.col("first_id").isNull()).join(wanted, "node", "left_semi").select("node", "key")
    return found.unionByName(nameless.join(unnamed, "key").select("node", "shingles")).dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of ``size``-word
    shingles; ``component_id`` is the least id reachable. A null text, or one without words, has
    an empty set and links with nothing. Rows with the same set are one class and always linked,
    whatever their ids; a null id is kept and never is a component's id unless no other is.
    Other columns are not carried. An empty table gives an empty result.
    """
    table = materialize(sketches(docs, size, id_col, text_col), "sketches")
    grouped = table.where("n > 0").groupBy("key").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    tiles = materialize(_tiled(_clusters(classes, percent)), "tiles")
    members = tiles.join(classes.select("node", "n", "sketch"), "node")
    promising = materialize(members.groupBy("leader", "i", "j").applyInPandas(_promising(percent), "leader long, i int, j int, node long"), "promising")
    sets = materialize(_full_sets(docs, classes, promising.select("node").distinct(), size, id_col, text_col), "sets")
    links = promising.join(sets, "node").groupBy("leader", "i", "j").applyInPandas(_verified(percent), "a long, b long")
    roots = connected_components(links)
    named = classes.select("node", "key", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_key = named.join(least, "root").select(F.col("key").alias("k"), "component_id")
    found = table.join(by_key, F.col("key") == F.col("k"), "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for; all columns unchanged.

    Ids are expected to be unique here; rows that repeat an id stay or go together.
    """
    kept = near_duplicates(docs, size, percent, id_col, text_col).where("kept").select(F.col(id_col).alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
