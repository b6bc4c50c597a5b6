"""Exact top-k retrieval of similar labelled trips.

The score of a stored trip is ``0.5 * cosine + 0.3 * shift + 0.2 * priority``; shift and
priority depend on the stored trip alone and are kept as its ``offset``. Pairs of trips are
never materialised and no side is broadcast:

1. Stored trips with the same vector and offset score alike, so one representative stands
   for them and at most k of them can be returned. The same holds for query trips. However
   often a vector is repeated, it is scored once.
2. A sample of at most SAMPLE representatives is known to every task: the k-th best score
   within it bounds the k-th best score of the memory from below. At most MAX_PIVOTS of
   them divide the memory into cells: the angle between query and pivot together with the
   radius of the cell bounds every score in it from above. A query is sent only to the
   cells that can hold one of its k best, a few percent of them.
3. A cell of more than CELL_ROWS vectors is divided again, by as many pivots of its own as the
   root of its size, and a query that reaches the cell is sent on to the subcells it can need.
   The work per query so grows with the root of the memory.
4. Each (cell, chunk, query block) is one small matrix product that keeps k rows per query.

An index can be appended to: new vectors go to the cells of their pivots as a generation of
their own, the bounds of these cells widen, and only cells that grew too large are divided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.vectors import SCORE_DECIMALS, SIMILARITY_DECIMALS, cosine
from surveyalign.operators.features import TabularEncoder
from surveyalign.session import materialize

MAX_PIVOTS = 2048
SAMPLE = 8192            # vectors, whatever the size of the memory
PER_PIVOT = 16           # stored vectors per cell while the memory is small
CELL_ROWS = 4_000        # stored vectors of a cell that is not divided
CELL_CHUNK = 20_000      # stored vectors per matrix product
QUERY_BLOCK = 200_000    # distinct query vectors per matrix product
TASK_ROWS = 2_000        # vectors per task of the steps that compare them with the sample
SLAB = 2_000_000         # scores held at once by a task
SLACK = 1e-9             # covers the rounding of similarities


# ---- Memories -------------------------------------------------------------------------

def build_memory(
    df: DataFrame, encoder: TabularEncoder | None = None, features: list[str] = fv.RETRIEVAL_FEATURES
) -> tuple[DataFrame, TabularEncoder]:
    """The corpus with its vectors; the encoder is fitted on it unless one is shared."""
    encoder = encoder or TabularEncoder.fit(df, features)
    return encoder.transform(df), encoder


def update_memory(
    memory: DataFrame | None, new: DataFrame, encoder: TabularEncoder | None = None
) -> tuple[DataFrame, TabularEncoder]:
    """The memory with ``new`` appended, encoded as the memory is; an empty memory is built.

    Only ``new`` is encoded; ``append_index`` does the same for an index of the memory.
    """
    if memory is None:
        return build_memory(new, encoder)
    if encoder is None:
        raise ValueError("appending needs the encoder of the memory")
    return memory.unionByName(encoder.transform(new)), encoder


def upsert_subgroup_errors(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Latest error per subgroup: a subgroup of ``new`` replaces that of ``current``."""
    tagged = current.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    return tagged.groupBy(*keys).agg(F.max_by("error", "_version").alias("error"))


# ---- Scores ---------------------------------------------------------------------------

def shift_score(year: Column, target_year: int = fv.TARGET_YEAR) -> Column:
    """1.0 from the target year on, 0.5 before; a missing year counts as the earlier survey."""
    return F.when(F.coalesce(year, F.lit(fv.HISTORICAL_YEAR)) >= target_year, 1.0).otherwise(0.5)


def priority_score(error: Column | None = None) -> Column:
    """The error of the trip's subgroup; 1.0 where none is known, and for all trips without errors."""
    return F.lit(1.0) if error is None else F.coalesce(error.cast("double"), F.lit(1.0))


def with_priority(memory: DataFrame, errors: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The memory with a ``priority`` per trip from the subgroup errors (keys, error), if there are any."""
    if errors is None:
        return memory.withColumn("priority", priority_score())
    named = errors.select(*keys, F.col("error").alias("_error"))
    return memory.join(named, keys, "left").withColumn("priority", priority_score(F.col("_error"))).drop("_error")


def score_offset(year: Column, priority: Column | None = None) -> Column:
    return fv.LAMBDA_SHIFT * shift_score(year) + fv.LAMBDA_PRIORITY * (priority_score() if priority is None else priority)


def retrieval_score(similarity: Column, offset: Column) -> Column:
    return F.round(fv.LAMBDA_SIMILARITY * similarity + offset, SCORE_DECIMALS)


def score_pairs(pairs: DataFrame, query: str, corpus: str, year: str) -> DataFrame:
    """Similarity and score of given (query vector, corpus vector) rows."""
    similarity = cosine(F.col(query), F.col(corpus))
    return pairs.withColumn("similarity", similarity).withColumn(
        "score", retrieval_score(F.col("similarity"), score_offset(F.col(year))))


def topk_per_query(
    scored: DataFrame, k: int, query: str = "query_id", score: str = "score", key: str = "case_id"
) -> DataFrame:
    """The k best rows per query by score, ties by key.

    The rank filter is applied before the shuffle too, so a query with very many rows
    sends at most k of them per task.
    """
    best_first = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


# ---- Arrow helpers --------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.empty((0, 0))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def best_k(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, ties to the lower column."""
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, cols = np.nonzero(scores >= kth[:, None])
    else:
        rows, cols = (i.ravel() for i in np.indices(scores.shape))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


# ---- Index ----------------------------------------------------------------------------

@dataclass
class RetrievalIndex:
    """A memory prepared for searches of up to ``k`` neighbours."""

    candidates: DataFrame     # rep_id, key, record, at most k rows per representative; ids are not the caller's
    cells: DataFrame          # cell, chunk, rep_id, features, offset
    sample: np.ndarray        # unit vectors, at most SAMPLE; the first n_pivots are the pivots
    sample_offsets: np.ndarray
    n_pivots: int
    cell_radius: np.ndarray   # largest angle to the pivot, per cell; the last cell is that of zero vectors
    cell_offset: np.ndarray   # largest offset per cell, -inf for an empty cell
    cell_chunks: np.ndarray   # chunks by hash, or DIVIDED
    k: int
    cell_rows: np.ndarray | None = None   # vectors per cell
    subcells: DataFrame | None = None     # cell, sub, features, radius, offset, pieces, n_subs of the divided cells
    generation: int = 0


DIVIDED = -1
REGROWN = 4              # a divided cell is divided anew when it has this many times the rows it was divided for


def vector_id(first_key: Column, *parts: Column) -> Column:
    """Id of a vector: the first of its rows' keys, for the order of ties, then a digest of the vector.

    Keys may repeat among vectors, the ids do not.
    """
    text = F.concat_ws("|", *[p.cast("array<string>") if i == 0 else p.cast("string") for i, p in enumerate(parts)])
    return F.concat(F.coalesce(first_key.cast("string"), F.lit("")), F.lit("\x00"), F.sha2(text, 256))


def vector_hash(*parts: Column | str) -> Column:
    """Leading sort and join key of rows that meet by their vectors.

    A sort settles a number at a glance and an array only by reading both rows. The vectors
    themselves stay in the key, so rows that share a hash alone are told apart.
    """
    return F.xxhash64(*parts)


def build_index(memory: DataFrame, k: int, key: str = "case_id") -> RetrievalIndex:
    """Index a memory that has ``features`` and ``survey_year``; its columns become the records.

    A memory with ``priority`` (see ``with_priority``) is ranked by it too.
    """
    candidates = _candidates(memory, k, key, 0)
    representatives = candidates.where("nth = 1").select("rep_id", "features", "offset")
    n = representatives.count()
    n_pivots = max(1, min(MAX_PIVOTS, n // PER_PIVOT))
    chosen = representatives.orderBy(F.md5("rep_id"), "rep_id").limit(SAMPLE).toArrow()
    sample = _unit_rows(_matrix(chosen.column("features")))
    n_cells = len(sample[:n_pivots]) + 1
    empty = RetrievalIndex(
        candidates, None, sample, chosen.column("offset").to_numpy(), n_cells - 1, np.zeros(n_cells), np.full(n_cells, -np.inf),
        np.ones(n_cells, dtype=int), k, np.zeros(n_cells, dtype=int))
    return _with_rows(empty, representatives, n)


def append_index(index: RetrievalIndex, new: DataFrame, key: str = "case_id") -> RetrievalIndex:
    """The index with the encoded rows of ``new`` (columns as in the memory) as a further generation.

    Searches equal those of an index of the whole memory. Only new rows are grouped and placed;
    stored rows move only where their cell has grown beyond CELL_ROWS and is divided.
    """
    generation = index.generation + 1
    candidates = _candidates(new, index.k, key, generation)
    representatives = candidates.where("nth = 1").select("rep_id", "features", "offset")
    if not index.n_pivots:   # nothing stored so far, so nothing to place by
        return build_index(new, index.k, key)
    grown = replace(index, candidates=index.candidates.unionByName(candidates), generation=generation)
    return _with_rows(grown, representatives, representatives.count())


def _candidates(memory: DataFrame, k: int, key: str, generation: int) -> DataFrame:
    priority = F.col("priority") if "priority" in memory.columns else None
    record = F.struct(*[c for c in memory.columns if c not in ("features",)])
    same = Window.partitionBy("_hash", "features", "offset").orderBy("key")
    upto = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = vector_id(F.col("first_key"), F.col("features"), F.col("offset"))
    return materialize(
        memory.select("features", score_offset(F.col("survey_year"), priority).alias("offset"),
                      F.col(key).alias("key"), record.alias("record"))
        .withColumn("_hash", vector_hash("features", "offset"))
        .select("*", F.row_number().over(same).alias("nth"), F.first("key").over(upto).alias("first_key"))
        .where(F.col("nth") <= k)
        .withColumn("rep_id", F.concat(own, F.lit(f"\x00{generation}")) if generation else own).drop("first_key", "_hash"),
        "index-candidates",
    )


def _with_rows(index: RetrievalIndex, representatives: DataFrame, n: int) -> RetrievalIndex:
    """The index with further representatives in its cells."""
    pivots = index.sample[:index.n_pivots]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("features"))
            similarity = np.clip(_unit_rows(raw) @ pivots.T, -1.0, 1.0)
            cell = similarity.argmax(axis=1)
            angle = np.arccos(similarity[np.arange(len(cell)), cell])
            zero = ~raw.any(axis=1)
            cell[zero], angle[zero] = len(pivots), 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(angle), *batch.columns],
                names=["cell", "angle", *batch.schema.names])

    assigned = materialize(
        representatives.repartition(math.ceil(n / TASK_ROWS) or 1).mapInArrow(
            assign, "cell int, angle double, rep_id string, features array<double>, offset double"),
        "index-cells",
    )
    radius, offset, rows = index.cell_radius.copy(), index.cell_offset.copy(), index.cell_rows.copy()
    stats = assigned.groupBy("cell").agg(
        F.max("angle").alias("radius"), F.max("offset").alias("offset"), F.count(F.lit(1)).alias("n"))
    for row in stats.collect():  # one row per cell
        c = row["cell"]
        radius[c], offset[c], rows[c] = max(radius[c], row["radius"]), max(offset[c], row["offset"]), rows[c] + row["n"]
    before = index.cell_chunks
    chunks = before.copy()
    chunks[-1] = max(chunks[-1], math.ceil(rows[-1] / CELL_CHUNK))   # zero vectors have no angles to divide by
    subcells = index.subcells
    fixed = np.zeros(len(rows))   # rows that a divided cell was made for
    if subcells is not None:
        for c, n_subs in subcells.select("cell", "n_subs").distinct().collect():   # one row per divided cell
            fixed[c] = n_subs ** 2
    settled = (before == DIVIDED) & (rows <= REGROWN * fixed)
    divide = (rows > CELL_ROWS) & ~settled
    divide[-1] = False
    chunks[divide] = DIVIDED
    placed = ["cell", "chunk", "rep_id", "features", "offset"]
    count = F.get(F.lit([int(c) for c in chunks]), F.col("cell"))
    by_hash = F.pmod(F.xxhash64("rep_id"), count).cast("int")

    def in_cells(which: np.ndarray):
        return F.get(F.lit([bool(w) for w in which]), F.col("cell"))

    whole = index.cells
    if whole is not None and chunks[-1] != before[-1]:
        rest, zeros = whole.where(F.col("cell") != len(pivots)), whole.where(F.col("cell") == len(pivots))
        whole = rest.unionByName(zeros.withColumn("chunk", by_hash).select(*placed))
    parts = [assigned.where(in_cells(chunks != DIVIDED)).withColumn("chunk", by_hash).select(*placed)]
    if subcells is not None:
        subcells = subcells.where(in_cells(settled))
        parts.append(_into_subcells(assigned.where(in_cells(settled)), subcells.select("cell", "sub", "features"), rows).select(
            *placed[:1], "sub", "angle", *placed[2:]))
        wider = parts[-1].groupBy("cell", "sub").agg(F.max("angle").alias("r"), F.max("offset").alias("o"), F.count(F.lit(1)).alias("n"))
        pieces = F.greatest("pieces", F.ceil(F.col("n") / CELL_CHUNK).cast("int"))
        subcells = materialize(subcells.join(wider, ["cell", "sub"], "left").select(
            "cell", "sub", "features", F.greatest("radius", "r").alias("radius"), F.greatest("offset", "o").alias("offset"),
            F.coalesce(pieces, "pieces").alias("pieces"), "n_subs"), "index-subcells")
        parts[-1] = _pieced(parts[-1], subcells).select(*placed)
    if divide.any():
        crowded = assigned.where(in_cells(divide))
        if whole is not None:
            crowded = crowded.select("cell", "rep_id", "features", "offset").unionByName(whole.where(in_cells(divide)).drop("chunk"))
            whole = whole.where(~in_cells(divide))
        moved, fresh = _divided(crowded, rows)
        parts.append(moved.select(*placed))
        subcells = fresh if subcells is None else materialize(subcells.unionByName(fresh), "index-subcells")
    cells = parts[0]
    for part in parts[1:] + ([whole] if whole is not None else []):
        cells = cells.unionByName(part)
    return replace(index, cells=materialize(cells, "index-leaves") if len(parts) > 1 or whole is not None else cells,
                   cell_radius=radius, cell_offset=offset, cell_chunks=chunks, cell_rows=rows, subcells=subcells)


def _into_subcells(rows: DataFrame, pivots: DataFrame, sizes: np.ndarray) -> DataFrame:
    """Rows (cell, rep_id, features, offset) with their nearest subcell and the angle to its pivot."""
    per_task = TASK_ROWS * 10
    blocks = F.get(F.lit([math.ceil(n / per_task) or 1 for n in sizes.tolist()]), F.col("cell"))

    def place(stored: pa.Table, around: pa.Table) -> pa.Table:
        around = around.sort_by("sub")
        unit, subs = _unit_rows(_matrix(stored.column("features"))), around.column("sub").to_numpy()
        centres = _unit_rows(_matrix(around.column("features")))
        best, angle = np.empty(len(unit), np.int64), np.empty(len(unit))
        step = max(1, SLAB // max(1, len(subs)))
        for start in range(0, len(unit) if len(subs) else 0, step):
            similarity = np.clip(unit[start:start + step] @ centres.T, -1.0, 1.0)
            best[start:start + step] = similarity.argmax(axis=1)
            angle[start:start + step] = np.arccos(similarity.max(axis=1))
        fields = [stored.column(c) for c in ("cell", "rep_id", "features", "offset")]
        return pa.table([*fields, pa.array(subs[best], pa.int32()) if len(unit) else pa.array([], pa.int32()), pa.array(angle)],
                        names=["cell", "rep_id", "features", "offset", "sub", "angle"])

    slim = rows.select("cell", "rep_id", "features", "offset", F.pmod(F.xxhash64("rep_id"), blocks).cast("int").alias("block"))
    copied = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return materialize(slim.groupBy("cell", "block").cogroup(copied.groupBy("cell", "block")).applyInArrow(
        place, "cell int, rep_id string, features array<double>, offset double, sub int, angle double"), "index-subs")


def _divided(crowded: DataFrame, sizes: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Cells divided around as many of their own vectors as the root of their size: (rows, subcells)."""
    wanted = F.get(F.lit([math.ceil(n ** 0.5) for n in sizes.tolist()]), F.col("cell"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.md5("rep_id"), "rep_id"))
    pivots = materialize(crowded.select("cell", nth.alias("nth"), "features").where(F.col("nth") <= wanted).select(
        "cell", (F.col("nth") - 1).cast("int").alias("sub"), "features"), "index-pivots")
    rows = _into_subcells(crowded, pivots, sizes)
    stats = rows.groupBy("cell", "sub").agg(
        F.max("angle").alias("radius"), F.max("offset").alias("offset"), F.ceil(F.count(F.lit(1)) / CELL_CHUNK).cast("int").alias("pieces"))
    subcells = materialize(pivots.join(stats, ["cell", "sub"], "left").select(
        "cell", "sub", "features", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("offset", F.lit(float("-inf"))).alias("offset"),
        F.coalesce("pieces", F.lit(1)).alias("pieces"), wanted.cast("int").alias("n_subs")), "index-subcells")
    return _pieced(rows, subcells), subcells


def _pieced(rows: DataFrame, subcells: DataFrame) -> DataFrame:
    """Rows of subcells with their chunk: the subcell, and a piece of it if it is large."""
    facts = subcells.select("cell", "sub", "pieces", "n_subs")
    piece = F.pmod(F.xxhash64("rep_id"), F.col("pieces")).cast("int")
    return rows.join(facts, ["cell", "sub"]).withColumn("chunk", F.col("sub") + F.col("n_subs") * piece)


def _probe(index: RetrievalIndex, k: int, with_floor: bool = False):
    """Query batches to one row per (query, cell that can hold one of its k best, chunk).

    A divided cell has one row with chunk -1. ``with_floor`` adds the lower bound of the k-th best score.
    """
    sample, sample_offsets, n_pivots = index.sample, index.sample_offsets, index.n_pivots
    radius, cell_offset, chunks = index.cell_radius, index.cell_offset, index.cell_chunks
    weight = fv.LAMBDA_SIMILARITY
    step = max(1, SLAB // max(1, len(sample)))

    def reachable(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(sample):  # an empty memory
            return np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(len(vectors))
        similarity = np.clip(vectors @ sample.T, -1.0, 1.0)
        known = weight * similarity + sample_offsets
        n = known.shape[1]
        floor = np.partition(known, n - k, axis=1)[:, n - k] if n >= k else np.full(len(known), -np.inf)
        angle = np.arccos(similarity[:, :n_pivots])
        best = weight * np.cos(np.maximum(0.0, angle - radius[:-1])) + cell_offset[:-1]
        # The vectors of the last cell are zero and score their offset.
        best = np.hstack([best, np.full((len(best), 1), cell_offset[-1])])
        return *np.nonzero((best >= floor[:, None] - SLACK) & np.isfinite(best)), floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _unit_rows(_matrix(batch.column("features")))
            for start in range(0, len(vectors), step):
                rows, cells, floor = reachable(vectors[start:start + step])
                repeat = np.abs(chunks[cells])
                chunk = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                rows, cells = np.repeat(rows, repeat), np.repeat(cells, repeat)
                chunk[chunks[cells] == DIVIDED] = -1
                sent = batch.take(pa.array(rows + start))
                bound = [pa.array(floor[rows])] if with_floor else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), pa.array(chunk, pa.int32()), *sent.columns, *bound],
                    names=["cell", "chunk", *sent.schema.names, *(["floor"] if with_floor else [])])

    return run


def _refine(queries: pa.Table, around: pa.Table) -> pa.Table:
    """Queries of one divided cell to the chunks of the subcells that can hold one of their k best."""
    schema = pa.schema([("cell", pa.int32()), ("chunk", pa.int32()), ("query_id", pa.string()), ("features", pa.list_(pa.float64()))])
    if not queries.num_rows or not around.num_rows:
        return schema.empty_table()
    vectors, centres = _unit_rows(_matrix(queries.column("features"))), _unit_rows(_matrix(around.column("features")))
    sub, radius, offset, pieces, n_subs = (around.column(c).to_numpy() for c in ("sub", "radius", "offset", "pieces", "n_subs"))
    floor = queries.column("floor").to_numpy()
    parts = []
    step = max(1, SLAB // len(centres))
    for start in range(0, len(vectors), step):
        angle = np.arccos(np.clip(vectors[start:start + step] @ centres.T, -1.0, 1.0))
        best = fv.LAMBDA_SIMILARITY * np.cos(np.maximum(0.0, angle - radius)) + offset
        rows, at = np.nonzero((best >= floor[start:start + step, None] - SLACK) & np.isfinite(best))
        repeat = pieces[at]
        piece = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        rows, at = np.repeat(rows, repeat) + start, np.repeat(at, repeat)
        taken = queries.select(["cell", "query_id", "features"]).take(pa.array(rows))
        parts.append(pa.Table.from_arrays([taken.column("cell"), pa.array(sub[at] + n_subs[at] * piece, pa.int32()),
                                           taken.column("query_id").cast(pa.string()), taken.column("features").cast(schema.field("features").type)], schema=schema))
    return pa.concat_tables(parts)


def visits(asked: DataFrame, index: RetrievalIndex, k: int) -> DataFrame:
    """Stored (cell, chunk, query_id, features): where each query has to look."""
    n = asked.count()
    spread = asked.select("query_id", "features").repartition(math.ceil(n / TASK_ROWS) or 1)
    columns = "cell int, chunk int, query_id string, features array<double>"
    if index.subcells is None:
        return materialize(spread.mapInArrow(_probe(index, k), columns), "probes")
    probes = materialize(spread.mapInArrow(_probe(index, k, with_floor=True), f"{columns}, floor double"), "probes")
    inner = probes.where("chunk = -1")
    blocks = math.ceil(inner.count() / QUERY_BLOCK) or 1
    asked_here = inner.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    copied = index.subcells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    refined = asked_here.groupBy("cell", "block").cogroup(copied.groupBy("cell", "block")).applyInArrow(_refine, columns)
    return materialize(probes.where("chunk >= 0").drop("floor").unionByName(refined), "visits")


def _match(k: int):
    """One cell chunk against one query block: the k best representatives per query."""
    weight = fv.LAMBDA_SIMILARITY
    schema = pa.schema([("query_id", pa.string()), ("rep_id", pa.string()),
                        ("similarity", pa.float64()), ("score", pa.float64())])

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return schema.empty_table()
        corpus = corpus.sort_by("rep_id")
        stored = _unit_rows(_matrix(corpus.column("features"))).T
        offset = corpus.column("offset").to_numpy()
        asked = _unit_rows(_matrix(queries.column("features")))
        step = max(1, SLAB // stored.shape[1])
        parts = []
        for start in range(0, len(asked), step):
            similarity = np.round(asked[start:start + step] @ stored, SIMILARITY_DECIMALS)
            score = np.round(weight * similarity + offset, SCORE_DECIMALS)
            rows, cols = best_k(score, k)
            parts.append(pa.Table.from_arrays(
                [queries.column("query_id").take(pa.array(rows + start)).cast(pa.string()),
                 corpus.column("rep_id").take(pa.array(cols)).cast(pa.string()),
                 pa.array(similarity[rows, cols]), pa.array(score[rows, cols])], schema=schema))
        return pa.concat_tables(parts)

    return run


def distinct_queries(queries: DataFrame) -> DataFrame:
    """One row per query vector with an id of its own, the vector's digest: queries have no order of ties."""
    own = vector_id(F.lit(""), F.col("features")).alias("query_id")
    return materialize(queries.select("features").distinct().select("features", own), "queries")


def blocks_per_cell(probes: DataFrame, n_cells: int) -> list[int]:
    """How many blocks the queries of each cell fill; a cell without queries has none and is not copied."""
    counts = probes.groupBy("cell", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max("n").alias("n")).collect()  # one row per cell
    blocks = [0] * n_cells
    for row in counts:
        blocks[row["cell"]] = math.ceil(row["n"] / QUERY_BLOCK)
    return blocks


def neighbours(asked: DataFrame, index: RetrievalIndex, k: int) -> DataFrame:
    """(query_id, neighbours) of distinct query vectors: at most k each, best first.

    A neighbour is a struct (rank, case_id, similarity, score, record).
    """
    if k > index.k:
        raise ValueError(f"the index keeps {index.k} rows per vector, {k} were asked for")
    probes = visits(asked, index, k)
    blocks = F.get(F.lit(blocks_per_cell(probes, len(index.cell_radius))), F.col("cell"))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
    stored = index.cells.where(blocks > 0)
    if index.subcells is not None:   # only the subcells that a query looks into are copied
        stored = stored.join(probes.select("cell", "chunk").distinct(), ["cell", "chunk"], "left_semi")
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = ["cell", "chunk", "block"]
    local = probes.groupBy(*group).cogroup(stored.groupBy(*group)).applyInArrow(
        _match(k), "query_id string, rep_id string, similarity double, score double")
    # k representatives hold the k best rows: each one ahead contributes a row ahead.
    best = topk_per_query(local, k, key="rep_id").drop("rank")
    rows = best.join(index.candidates.select("rep_id", "key", "record"), "rep_id")
    ranked = topk_per_query(rows, k, key="key")
    return ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("key").alias("case_id"), "similarity", "score", "record"))).alias("neighbours"))


def retrieve_all(
    queries: DataFrame, searches: dict[str, tuple[RetrievalIndex, int]]
) -> DataFrame:
    """``queries`` (with ``features``) plus one array of neighbours per search {column: (index, k)}.

    The results of all searches meet on the distinct vectors, so the query table itself is
    joined once, however many memories are searched.
    """
    asked = distinct_queries(queries)
    found = asked
    for output, (index, k) in searches.items():
        lists = neighbours(asked, index, k).withColumnRenamed("neighbours", output)
        found = found.join(lists, "query_id", "left")
    found = materialize(found.drop("query_id").withColumn("_hash", vector_hash("features")), "neighbours")
    arrays = {
        output: F.coalesce(F.col(output), F.array().cast(found.schema[output].dataType)) for output in searches}
    hashed = queries.withColumn("_hash", vector_hash("features"))
    return hashed.join(found, ["_hash", "features"], "left").withColumns(arrays).drop("_hash")


def retrieve(
    queries: DataFrame, index: RetrievalIndex, k: int, output: str = "neighbours"
) -> DataFrame:
    """``queries`` plus an array of their k best stored trips."""
    return retrieve_all(queries, {output: (index, k)})


def retrieve_topk(queries: DataFrame, index: RetrievalIndex, k: int, key: str = "case_id") -> DataFrame:
    """One row per query and neighbour: (query_id, rank, case_id, similarity, score, record)."""
    found = retrieve(queries, index, k, "neighbours")
    return found.select(F.col(key).alias("query_id"), F.inline("neighbours"))
