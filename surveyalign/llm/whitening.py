"""Whitening of integer-scaled vectors from a covariance weighted by multiplicity.

Equal vectors become one class with a count. The covariance is a sum of weighted, centred matrix
products over the classes of every task; each class is whitened once and joined back to its rows.
Sums are whole numbers and exact, so centring loses nothing however far the data lie from zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyalign.llm.common import materialize

#: A class with more than this share of all rows is joined back by broadcast; there are at most as many.
HOT_CLASSES = 1000

#: Scaled entries are held inside this range, so that differences of two fit a long.
LARGEST = 2.0 ** 61

_LIMB = 1 << 32


@dataclass(frozen=True)
class Basis:
    """Whitening of the vectors of one length, small enough to travel with the tasks."""
    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    explained: np.ndarray
    scale: np.ndarray


def scaled(vector: Column, factor: int = 64, offset: int = 1_000_000) -> Column:
    """Array of floor(factor * entry) + offset as long."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * factor))) + F.lit(offset).cast("long"))


def _matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every vector length of a batch."""
    column = batch.column(name)
    lengths = column.value_lengths().to_numpy()
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task, in two limbs, and its number of rows (position -1)."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for rows, x in _matrices(batch, "x"):
            w = weight[rows]
            room = float(np.abs(x).max(initial=0)) * float(w.sum()) < 2.0 ** 62
            sums = (x * w[:, None]).sum(axis=0) if room else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            old = totals.get(x.shape[1], [0] * (x.shape[1] + 1))
            totals[x.shape[1]] = [a + int(b) for a, b in zip(old, [w.sum(), *sums])]
    out = [(dim, at - 1, v // _LIMB, v % _LIMB) for dim, values in totals.items() for at, v in enumerate(values)]
    yield pa.RecordBatch.from_pylist([dict(zip(("dim", "at", "high", "low"), r)) for r in out],
                                     pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n: the whole part of the mean goes off in whole numbers, its fraction in doubles."""
    whole = np.array([s // n for s in sums], np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - fraction


def _products(name: str, centre):
    """Upper triangle of a task's weighted product of centred vectors; ``centre(matrix)`` centres them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for rows, x in _matrices(batch, name):
                away = centre(x)
                product = (away * weight[rows, None]).T @ away
                totals[x.shape[1]] = totals[x.shape[1]] + product if x.shape[1] in totals else product
        for dim, product in totals.items():
            i, j = np.triu_indices(dim)
            yield pa.record_batch([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(product[i, j])],
                                  ["dim", "i", "j", "v"])
    return run


def _covariances(classes: DataFrame, name: str, centre, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Covariance per vector length; what reaches the driver is one triangle a length."""
    summed = classes.select(name, "weight").mapInArrow(_products(name, centre), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    found = {dim: np.zeros((dim, dim)) for dim in counts}
    for r in summed.toLocalIterator():
        found[r.dim][r.i, r.j] = found[r.dim][r.j, r.i] = r.v / counts[r.dim]
    return found


def _basis(covariance: np.ndarray, n: int, sums: tuple[int, ...], components: int) -> Basis:
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    trace = np.trace(covariance)
    real = values > max(values.max(initial=0), 0) * len(covariance) * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), np.nan)
    return Basis(n, sums, vectors, np.maximum(values, 0) / trace if trace > 0 else np.full(len(order), np.nan), scale)


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum of (n * x - S) ** 2 per row, exact."""
    far = max((abs(n * int(x[:, k].max()) - s) + abs(n * int(x[:, k].min()) - s) for k, s in enumerate(sums)), default=0)
    big = far * far * max(len(sums), 1) >= 1 << 62 or n * int(np.abs(x).max(initial=0)) >= 1 << 62
    kind = object if big else np.int64
    away = x.astype(kind) * n - np.array(sums, kind)
    return [int(v) for v in (away * away).sum(axis=1)]


def _whitened(bases: dict[int, Basis]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch, "x"):
                basis = bases[x.shape[1]]
                values = (_centred(x, basis.n, basis.sums) @ basis.directions) * basis.scale
                k = values.shape[1]
                taken = batch.take(pa.array(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * k, k), pa.int32()), pa.array(values.ravel()))
                deviation = pa.array([str(v) for v in _deviation(x, basis.n, basis.sums)], pa.string())
                yield pa.record_batch([*taken.columns, lists, deviation], [*taken.schema.names, "values", "deviation"])
    return run


def _identity_errors(classes: DataFrame, bases: dict[int, Basis]) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, per vector length."""
    width = {}
    for dim, b in bases.items():
        width[dim] = len(b.scale)
    at = F.size("x").alias("dim")
    means = classes.select(at, "weight", F.posexplode("values").alias("at", "v")).groupBy("dim", "at").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("m"))
    mean = {dim: np.zeros(k) for dim, k in width.items()}
    for r in means.toLocalIterator():
        mean[r.dim][r.at] = r.m
    errors = {}
    for dim, k in width.items():
        centre = mean[dim]
        covariance = _covariances(classes.where(F.size("x") == dim), "values", lambda m, c=centre: m - c, {k: bases[dim].n})[k]
        real = np.isfinite(bases[dim].scale)
        away = (covariance - np.eye(k))[np.ix_(real, real)]
        errors[dim] = float(np.abs(away).max()) if away.size else float("nan")
    return errors


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "counts") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row and component.

    Entries become whole numbers x = floor(64 * entry) + 1000000, held inside +-2 ** 61. With
    ``weights="counts"`` the fit list is all vectors, with ``"one"`` each distinct vector counts
    once. ``n`` is the length of the fit list, ``deviation`` the exact sum of (n * x - S) ** 2 over
    the dimensions (null beyond a long), ``whitened`` the projection on the component over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace. A component without
    variance has null ``whitened`` and no part in ``identity_error``; without any variance
    ``explained`` is null too. There are as many components as dimensions, at most ``components``.

    Rows whose vector is null or holds null or non-finite entries go; empty vectors have no
    components and so no rows. Vectors of different lengths are fitted apart. Repeated rows and
    null ids keep their rows; other columns are not carried. An empty table gives an empty result.

    The driver holds one covariance triangle per vector length. A class with over a thousandth of
    the rows is broadcast to them (at most ``HOT_CLASSES`` exist), the others are joined by a
    shuffle in which no key has more rows than that.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    table = materialize(source.where(F.coalesce(finite, F.lit(False)) & (F.size("e") > 0)).select("id", scaled(F.col("e")).alias("x")), "scaled")
    size = F.count("*").alias("size")
    classes = materialize(table.groupBy("x").agg(size).withColumn("weight", F.col("size") if weights == "counts" else F.lit(1).cast("long")), "classes")

    counts: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = {}
    whole = classes.select("x", "weight").mapInArrow(_whole_sums, "dim int, at int, high long, low long").groupBy("dim", "at").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    for r in whole.toLocalIterator():
        value = int(r.high) * _LIMB + int(r.low)
        if r["at"] < 0:
            counts[r.dim] = value
        else:
            sums.setdefault(r.dim, {})[r["at"]] = value
    kind = source.schema["id"].dataType.simpleString()
    if not counts:
        return spark.createDataFrame([], f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)
    centres = {dim: (counts[dim], tuple(sums[dim][k] for k in range(dim))) for dim in counts}
    covariances = _covariances(classes, "x", lambda x: _centred(x, *centres[x.shape[1]]), counts)
    bases = {dim: _basis(covariances[dim], *centres[dim], components) for dim in counts}

    done = materialize(classes.mapInArrow(_whitened(bases), "x array<long>, size long, weight long, values array<double>, deviation string"), "whitened")
    errors = _identity_errors(done, bases)
    n_rows = table.count()
    hot = F.col("size") * HOT_CLASSES > n_rows
    often, rest = done.where(hot).select("x", "values", "deviation"), done.where(~hot).select("x", "values", "deviation")
    joined = table.join(F.broadcast(often), "x").union(table.join(F.broadcast(often.select("x")), "x", "left_anti").join(rest, "x"))

    def by_length(value):
        picked = F.lit(None)
        for dim in bases:
            picked = F.when(F.size("x") == dim, value(dim)).otherwise(picked)
        return picked

    shares = by_length(lambda dim: F.array(*(F.lit(float(v)) for v in bases[dim].explained)))
    facts = joined.select(
        "id", by_length(lambda dim: F.lit(bases[dim].n).cast("long")).alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        by_length(lambda dim: F.lit(errors[dim])).alias("identity_error"), shares.alias("shares"), F.posexplode("values").alias("at", "whitened"))
    return facts.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"),
        F.nanvl(F.get("shares", F.col("at")), F.lit(None).cast("double")).alias("explained"), F.nanvl("identity_error", F.lit(None).cast("double")).alias("identity_error"))
