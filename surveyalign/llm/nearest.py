"""Largest inner products by collision counting over single projections.

Vectors get one more component so that all have the length of the longest; then the largest inner
product with a query is the smallest distance to it. A shard holds, for each of many random lines,
its vectors' places on the line in sorted order. A query lays a window around its own place on
every line and counts how many windows a vector falls into; windows widen step by step, which
rehashes nothing (virtual rehashing), and each step counts only what is new. A vector that
collides often enough is compared with the query in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyalign.llm.common import materialize

#: Distinct vectors of a shard, distinct queries of a block, and queries whose windows are laid out at a time.
SHARD, BLOCK, STRIP = 8192, 2048, 32

#: Lines, half a window's width in units of the radius, first radius in units of the longest vector, growth per step.
LINES, WIDTH, FIRST, GROWTH = 96, 1.0, 0.05, 1.5

#: A vector at the radius itself stays below the threshold with at most this chance; nearer ones with less.
MISS = 0.02

#: Above one collision in FEW possible ones, ranks are compared line by line instead of walking the windows.
FEW = 16

#: A query vector with more than 1 / HOT_QUERIES of all query rows meets its answer by broadcast; there are at most as many.
HOT_QUERIES = 1000

_SEED = 20_240_501


def collisions_needed(lines: int = LINES, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a vector at the radius reaches with a chance of ``1 - miss`` or more.

    Its place on a line differs from the query's by a normal variable as wide as the radius.
    """
    hit = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(lines + 1):
        below += math.comb(lines, count) * hit ** count * (1 - hit) ** (lines - count)
        if below > miss:
            return count
    return lines


def _directions(dim: int) -> np.ndarray:
    """Random lines in ``dim + 1`` dimensions, the same in every task."""
    return np.random.default_rng([_SEED, dim]).normal(size=(dim + 1, LINES))


class Shard:
    """Distinct vectors and their sorted places on every line.

    ``order`` lists the vectors along a line, ``rank`` says where on a line each vector stands.
    """

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors, self.longest = vectors, longest
        rest = np.sqrt(np.maximum(longest ** 2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        self.lines = _directions(vectors.shape[1])
        places = (np.hstack([vectors, rest[:, None]]) @ self.lines).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, self.order, axis=1)
        self.rank = np.empty(self.order.shape, np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, self.order, np.arange(len(vectors), dtype=self.rank.dtype)[None, :], axis=1)
        self.needed = collisions_needed()

    def _windows(self, own: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and last place + 1 inside the windows, [query, step, line]; ``radius`` is [query, step]."""
        low, high = (np.empty((*radius.shape, len(self.places)), np.int64) for _ in range(2))
        for line, places in enumerate(self.places):
            low[..., line] = np.searchsorted(places, own[:, line, None] - WIDTH * radius, side="left")
            high[..., line] = np.searchsorted(places, own[:, line, None] + WIDTH * radius, side="right")
        return low, high

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places in the shard, scores): the ``k`` best found, with all that tie with the last.

        Only scores of ``floor`` or more matter, and a query with a floor starts with the window
        that its distance asks for. Without one, windows widen until k vectors are
        found, then to the distance of the k-th; the last window holds the whole shard.
        """
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        own = np.hstack([queries / length[:, None] * self.longest, np.zeros((len(queries), 1))]) @ self.lines
        steps = self.longest * FIRST * GROWTH ** np.arange(math.ceil(math.log(2 / FIRST, GROWTH)) + 1)
        steps[-1] = np.inf
        known = np.isfinite(floor)
        reach = np.zeros(len(queries))
        reach[known] = self._distance(floor[known], length[known]) * (1 + 1e-9) + 1e-9 * self.longest
        for group in (np.flatnonzero(known), np.flatnonzero(~known)):
            for first in range(0, len(group), STRIP):
                part = group[first:first + STRIP]
                radius = reach[part, None] if known[part[0]] else np.broadcast_to(steps, (len(part), len(steps)))
                low, high = self._windows(own[part], radius)
                for at, q in enumerate(part):
                    yield q, *self._widen(queries[q], length[q], k, radius[at], low[at], high[at])

    def _distance(self, score, length):
        """Distance that a score means: both ends are as long as the longest vector."""
        return np.sqrt(np.maximum(2 * self.longest * (self.longest - score / length), 0.0))

    def _inside(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Collisions of every vector with one query's windows: ranks wrap below ``low``, so one comparison tells."""
        kind = self.rank.dtype
        inside = self.rank - low.astype(kind)[:, None] < (high - low).astype(kind)[:, None]
        return inside.sum(axis=0, dtype=np.int32)

    def _widen(self, query: np.ndarray, length: float, k: int, radius: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(self.vectors), np.int32)
        seen = np.zeros(len(self.vectors), bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        wide = (high - low).sum(axis=1)
        a = b = np.zeros(len(self.places), np.int64)
        before, goal = 0, 0.0
        for step, r in enumerate(radius):
            final = step == len(radius) - 1
            # k vectors over the threshold need this many collisions, so narrower windows cannot end a search.
            if not final and (wide[step] < k * self.needed or r < goal):
                continue
            lo, hi = low[step], high[step]
            if (wide[step] - before) * FEW > self.rank.size:
                counts = self._inside(lo, hi)
            else:
                edges = ((lo, a), (b, hi)) if before else ((lo, hi),)
                new = [self.order[t, x[t]:y[t]] for x, y in edges for t in np.flatnonzero(x < y)]
                if new:
                    counts += np.bincount(np.concatenate(new), minlength=len(counts)).astype(np.int32)
            a, b, before = lo, hi, wide[step]
            often = np.flatnonzero((counts >= self.needed) & ~seen)
            seen[often] = True
            found = np.concatenate([found, often])
            scores = np.concatenate([scores, (self.vectors[often] * query).sum(axis=1)])
            if len(found) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[scores >= edge], scores[scores >= edge]
            if len(found) >= k:
                goal = self._distance(scores.min(), length)
                if goal <= r:
                    break
        return found, scores


@dataclass(frozen=True)
class Index:
    """Distinct vectors in shards: ``classes`` (e, ids, dim, node), ``shards`` (dim, place, nodes, ids, vectors).

    ``longest`` and ``shares`` give the longest vector and the number of shards per vector length;
    entries are held as multiples of 2 ** ``exponent``. ``k`` is the most neighbours a search returns.
    """
    classes: DataFrame
    shards: DataFrame
    longest: dict[int, float]
    shares: dict[int, int]
    exponent: int
    k: int


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, e) of the rows that take part; -0.0 becomes 0.0, so that equal vectors are equal keys."""
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce(finite & F.exists("e", lambda c: c != 0), F.lit(False))
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where(good).withColumn(
        "e", F.transform("e", lambda c: c + F.lit(0.0)))


def _per_dim(values: dict[int, int]) -> Column:
    picked = F.lit(1)
    for dim, value in values.items():
        picked = F.when(F.col("dim") == dim, F.lit(value)).otherwise(picked)
    return picked


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _shard_rows(exponent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.ldexp(_matrix(pdf["e"]), -exponent)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "place": pdf["place"].iloc[:1], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()],
                             "ids": [pdf["ids"].tolist()], "vectors": [vectors.tobytes()]})
    return run


def build_index(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Index of all vectors that can take part, for searches of up to ``k`` neighbours.

    Equal vectors are one class that knows its ``k + 1`` smallest ids, which is all that a search
    for k others can return. Classes go to shards by a hash, so every shard is a fair sample.
    Nothing is fitted: the driver learns the longest vector and the number of vectors per length.
    """
    source = _usable(vectors, id_col, vector_col)
    kind = source.schema["id"].dataType.simpleString()
    ranked = source.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy(F.col("id").asc_nulls_last()))).where(F.col("r") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"])
    classes = materialize(ranked.groupBy("e").agg(ids.alias("ids")).select("e", "ids", F.size("e").alias("dim"), F.monotonically_increasing_id().alias("node")), "classes")
    largest = classes.agg(F.max(F.array_max(F.transform("e", F.abs)))).first()[0]
    exponent = math.frexp(largest or 1.0)[1]
    square = F.aggregate("e", F.lit(0.0), lambda total, c: total + (c / float(largest or 1.0)) * (c / float(largest or 1.0)))
    facts = {r.dim: (r.n, math.sqrt(r.square) * math.ldexp(largest, -exponent))
             for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("square")).toLocalIterator()}
    longest = {dim: length * (1 + 1e-9) for dim, (_, length) in facts.items()}
    shares = {dim: -(-n // SHARD) for dim, (n, _) in facts.items()}
    placed = classes.withColumn("place", F.pmod(F.xxhash64("node"), _per_dim(shares)).cast("int"))
    shards = placed.groupBy("dim", "place").applyInPandas(_shard_rows(exponent), f"dim int, place int, nodes binary, ids array<array<{kind}>>, vectors binary")
    return Index(classes, materialize(shards, "shards"), longest, shares, exponent, k)


def _block_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of queries; each is held as a multiple of the power of two above its largest entry."""
    vectors = _matrix(pdf["e"])
    shift = np.frexp(np.abs(vectors).max(axis=1))[1]
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "home": pdf["home"].iloc[:1], "qnodes": [pdf["qnode"].to_numpy(np.int64).tobytes()],
                         "queries": [np.ldexp(vectors, -shift[:, None]).tobytes()], "shifts": [shift.astype(np.int64).tobytes()],
                         "floors": [pdf["floor"].to_numpy(np.float64).tobytes()]})


_BLOCKS = "dim int, block int, home int, qnodes binary, queries binary, shifts binary, floors binary"


def _visit(longest: dict[int, float], exponent: int, k: int):
    """One shard against one block of queries: ``near`` orders a query's hits, ``score`` is the product itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, place, nodes, vectors, qnodes, queries, shifts, floors = (
                    batch.column(c)[row].as_py() for c in ("dim", "place", "nodes", "vectors", "qnodes", "queries", "shifts", "floors"))
                nodes, qnodes, shifts = (np.frombuffer(b, np.int64) for b in (nodes, qnodes, shifts))
                shard = Shard(np.frombuffer(vectors).reshape(-1, dim), longest[dim])
                found = [(np.full(len(at), q), at, scores) for q, at, scores in shard.search(np.frombuffer(queries).reshape(-1, dim), k, np.frombuffer(floors))]
                q, at, near = (np.concatenate([f[c] for f in found]) for c in range(3))
                with np.errstate(over="ignore", under="ignore"):
                    score = np.ldexp(near, shifts[q] + exponent)
                ids = batch.column("ids")[row].values.take(pa.array(at))
                yield pa.record_batch([pa.array(qnodes[q]), pa.array(nodes[at]), pa.array(near), pa.array(score), ids], ["qnode", "node", "near", "score", "ids"])
    return run


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): up to ``index.k`` nearest of every query row, nearest first.

    Nearest means the largest inner product in double precision; ties go to the smaller id, null
    ids last. A query's own row, an indexed row with its id (or as null) and its vector, is no
    candidate; other rows that repeat it are. Queries and candidates that are null, empty, zero,
    or hold null or non-finite components take no part; vectors meet only vectors of their own
    length. Repeated query rows get one answer each. Other columns are not carried. Empty tables
    give an empty result. Products beyond a double's range are infinite, in their right order.

    Every distinct query first searches one shard; its k-th best score there bounds how far its
    windows widen in all others. A neighbour is missed with a chance of at most ``MISS``. Copies of
    a vector are searched for, and found, once.
    """
    k = index.k + 1
    rows = materialize(_usable(queries, id_col, vector_col), "queries")
    own = index.classes.select("e", F.col("node").alias("own"))
    asked = materialize(rows.select("e").distinct().join(own, "e", "left").select(
        "e", "own", F.size("e").alias("dim"), F.monotonically_increasing_id().alias("qnode")), "asked")
    blocks = {r.dim: -(-r.n // BLOCK) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}
    placed = asked.where(F.col("dim").isin(list(index.shares))).withColumn("block", F.pmod(F.xxhash64("qnode"), _per_dim(blocks)).cast("int")).withColumn(
        "home", F.pmod("block", _per_dim(index.shares)).cast("int")).drop("own")
    id_kind = index.shards.schema["ids"].dataType.elementType.simpleString()
    schema = f"qnode long, node long, near double, score double, ids {id_kind}"

    def visited(questions: DataFrame, name: str) -> DataFrame:
        pairs = questions.join(index.shards, ["dim", "place"]).repartition("dim", "place", "block")
        return materialize(pairs.mapInArrow(_visit(index.longest, index.exponent, k), schema), name)

    def packed(table: DataFrame) -> DataFrame:
        return table.groupBy("dim", "block").applyInPandas(_block_rows, _BLOCKS)

    nearest_first = (F.col("near").desc(), F.col("ids")[0].asc_nulls_last(), F.col("node"))
    place = F.row_number().over(Window.partitionBy("qnode").orderBy(*nearest_first))
    hits = visited(packed(placed.withColumn("floor", F.lit(float("-inf")))).withColumn("place", F.col("home")), "home")
    if max(index.shares.values(), default=1) > 1:
        floors = hits.withColumn("r", place).where(F.col("r") == k).select("qnode", F.col("near").alias("floor"))
        bounded = placed.join(floors, "qnode", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        others = F.explode(F.sequence(F.lit(0), (_per_dim(index.shares) - 1).cast("int")))
        hits = hits.union(visited(packed(bounded).withColumn("place", others).where("place <> home"), "others"))
    # Each class stands in the order by its smallest id, so k classes hold the k best rows.
    best = hits.withColumn("r", place).where(F.col("r") <= k).select("qnode", "node", "near", "score", F.posexplode("ids").alias("nth", "id"))
    order = F.row_number().over(Window.partitionBy("qnode").orderBy(F.col("near").desc(), F.col("id").asc_nulls_last(), "node", "nth"))
    ordered = best.withColumn("r", order).where(F.col("r") <= k)
    lists = ordered.groupBy("qnode").agg(F.array_sort(F.collect_list(F.struct("r", "id", "node", "score"))).alias("hits"))
    answers = materialize(asked.join(lists, "qnode").select("e", "own", "hits"), "answers")

    n_rows = rows.count()
    hot = materialize(rows.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") * HOT_QUERIES > n_rows).select("e"), "hot")
    met = rows.join(F.broadcast(answers.join(F.broadcast(hot), "e")), "e").union(rows.join(F.broadcast(hot), "e", "left_anti").join(answers, "e"))
    mine = F.array_position(F.transform("hits", lambda h: (h["node"].eqNullSafe(F.col("own")) & h["id"].eqNullSafe(F.col("id"))).cast("int")), 1)
    kept = F.slice(F.filter(F.col("hits"), lambda h, i: i + 1 != F.col("mine")), 1, index.k)
    return met.withColumn("mine", mine).select(F.col("id").alias("query_id"), F.posexplode(kept).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))
