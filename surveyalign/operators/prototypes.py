"""Behaviour prototypes: clusters of encoded trips and their summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.text import prototype_label, prototype_summary
from surveyalign.operators.features import TabularEncoder
from surveyalign.session import materialize

TASK_ROWS = 20_000       # distinct vectors per task
START_ROWS = 20_000      # distinct vectors, in order of a digest, among which the starting centres are drawn
UNIT = float(1 << 30)    # sums are added as whole numbers of this share, so their order does not matter


@dataclass
class Clustering:
    centers: list[list[float]]
    inertia: float

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.centers)), "prototype_id int, centroid array<double>")

    @classmethod
    def from_frame(cls, df: DataFrame) -> "Clustering":
        rows = sorted(df.collect(), key=lambda r: r["prototype_id"])  # one row per cluster
        return cls([list(r["centroid"]) for r in rows], float("nan"))


def kmeans(
    encoded: DataFrame, k: int = fv.N_PROTOTYPES, seed: int = 42, restarts: int = 10,
    max_iter: int = 300, tol: float = 0.003,
) -> Clustering:
    """Best of ``restarts`` k-means runs by inertia, all advanced together: one job per iteration.

    Coded trips repeat few vectors, so the runs see each distinct vector once with its count as
    weight, which leaves the objective unchanged. Every run starts from weighted k-means++ draws
    among at most ``START_ROWS`` distinct vectors and ends when no centre is further than ``tol``,
    in standard deviations, from the mean of its rows. A centre without rows stays where it is. A
    task returns one sum per run and centre, whatever its rows.
    """
    counted = materialize(encoded.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("weight")), "kmeans-input")
    drawn = counted.orderBy(F.xxhash64("features"), "features").limit(START_ROWS).toPandas()   # bounded by the limit
    if drawn.empty:
        raise ValueError("no rows to cluster")
    points, weights = np.array(drawn["features"].tolist(), float), drawn["weight"].to_numpy()
    centers = np.stack([_starting_centers(points, weights, k, np.random.default_rng([seed, i])) for i in range(restarts)])
    stored = _blocks(counted)
    blocks = stored.rdd.map(lambda r: (np.frombuffer(r["vectors"]).reshape(-1, r["dim"]), np.frombuffer(r["weights"]))).persist(StorageLevel.MEMORY_AND_DISK)
    inertia, live = np.full(restarts, np.inf), np.arange(restarts)
    try:
        for _ in range(max_iter):
            parts = blocks.mapPartitions(_center_sums(centers[live]))
            totals = parts.treeReduce(np.add) if blocks.getNumPartitions() > 16 else sum(parts.collect())   # a fixed size per task
            sums = (totals / UNIT).astype(float)
            weight = sums[:, :, -2:-1]
            means = np.where(weight > 0, sums[:, :, :-2] / np.where(weight > 0, weight, 1), centers[live])
            inertia[live] = sums[:, :, -1].sum(axis=1)
            moved = np.linalg.norm(means - centers[live], axis=2).max(axis=1) > tol
            centers[live[moved]] = means[moved]
            live = live[moved]
            if not len(live):
                break
    finally:
        blocks.unpersist()
    best = int(inertia.argmin())
    return Clustering([[float(x) for x in c] for c in centers[best]], float(inertia[best]))


def _starting_centers(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Greedy k-means++: of a few draws by squared distance, the one that lowers the inertia most."""
    tries = 2 + int(math.log(k))
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    near = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = near * weights
        draws = rng.choice(len(points), tries, p=mass / mass.sum()) if mass.sum() > 0 else rng.choice(len(points), tries)
        options = np.minimum(near[None, :], ((points[None, :, :] - points[draws][:, None, :]) ** 2).sum(axis=2))
        best = int((options @ weights).argmin())
        chosen.append(points[draws[best]])
        near = options[best]
    return np.array(chosen)


def _blocks(counted: DataFrame) -> DataFrame:
    """Stored blocks (dim, vectors, weights) of distinct vectors; a fixed layout makes runs repeatable."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, weights = batch.column("features").flatten().to_numpy(zero_copy_only=False), batch.column("weight").to_numpy()
                yield pa.record_batch([pa.array([len(vectors) // batch.num_rows], pa.int32()), pa.array([vectors.tobytes()], pa.binary()),
                                       pa.array([weights.tobytes()], pa.binary())], ["dim", "vectors", "weights"])
    parts = max(1, math.ceil(counted.count() / TASK_ROWS))
    laid = counted.repartition(parts, "features").sortWithinPartitions("features")
    return materialize(laid.mapInArrow(run, "dim int, vectors binary, weights binary"), "kmeans-blocks")


def _center_sums(centers: np.ndarray):
    """Whole-number sums [run, centre, (vector, weight, squared distances)] of a task."""
    runs, k, dim = centers.shape

    def run(blocks) -> Iterator[np.ndarray]:
        total = np.zeros((runs, k, dim + 2), object)
        for vectors, weights in blocks:
            fields = np.hstack([vectors * weights[:, None], weights[:, None]])
            for r, middle in enumerate(centers):
                away = ((vectors[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
                own = away.argmin(axis=1)
                near = away[np.arange(len(own)), own] * weights
                sums = np.stack([np.bincount(own, f, k) for f in (*fields.T, near)], axis=1)
                total[r] += np.vectorize(lambda x: round(x * UNIT), otypes=[object])(sums)
        yield total
    return run


def nearest_center(features: Column, centers: list[list[float]]) -> Column:
    """Position of the nearest center, the first one on ties."""
    def distance(center):
        terms = [(F.get(features, F.lit(i)) - F.lit(float(c))) * (F.get(features, F.lit(i)) - F.lit(float(c)))
                 for i, c in enumerate(center)]
        return sum(terms[1:], terms[0])

    distances = F.array(*[distance(c) for c in centers])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def assign_prototype(encoded: DataFrame, clustering: Clustering, output: str = "prototype_id") -> DataFrame:
    return encoded.withColumn(output, nearest_center(F.col("features"), clustering.centers))


def _share_map(code: str, codes: list[int]) -> Column:
    n = F.count(F.lit(1))
    pairs = []
    for c in codes:
        pairs += [F.lit(c), F.count_if(F.col(code) == c) / n]
    return F.create_map(*pairs)


def summarize_prototypes(
    assigned: DataFrame, features: list[str] = fv.RETRIEVAL_FEATURES, cluster: str = "prototype_id"
) -> DataFrame:
    """One row per cluster: size, mean codes, mode and purpose shares, label.

    One aggregation over the cluster column; means count null as -1. A cluster without
    trips gives no row. Features the table lacks (the derived zone numbers) have no mean.
    """
    present = [c for c in features if c in assigned.columns]
    means = {c: F.avg(F.coalesce(F.col(c), F.lit(-1)).cast("double")) for c in present}
    demographics = F.create_map(*[x for c in present for x in (F.lit(c), means[c])])
    summary = assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_samples"),
        demographics.alias("demographic_summary"),
        _share_map("main_mode", fv.MODES).alias("mode_share"),
        _share_map("trip_purpose", fv.PURPOSES).alias("purpose_share"),
    )
    mean = lambda name, default: F.coalesce(F.col("demographic_summary")[name], F.lit(default))
    label = prototype_label(mean("age_group", 3.0), mean("employment_status", 1.0), mean("car_availability", 0.0))
    return summary.withColumn("semantic_label", label)


def with_summary(prototypes: DataFrame, cluster: str = "prototype_id") -> DataFrame:
    """Prototypes with their text description."""
    return prototypes.withColumn("summary", prototype_summary(
        F.col(cluster), F.col("semantic_label"), F.col("n_samples"), F.col("mode_share")))


@dataclass
class PrototypeMemory:
    encoder: TabularEncoder
    clustering: Clustering
    prototypes: DataFrame


def build_prototypes(
    df: DataFrame,
    k: int = fv.N_PROTOTYPES,
    features: list[str] = fv.RETRIEVAL_FEATURES,
    seed: int = 42,
    restarts: int = 10,
) -> PrototypeMemory:
    """Encode, cluster and summarise one survey year."""
    encoder = TabularEncoder.fit(df, features)
    encoded = encoder.transform(df)
    clustering = kmeans(encoded, k, seed, restarts)
    prototypes = summarize_prototypes(assign_prototype(encoded, clustering), features)
    return PrototypeMemory(encoder, clustering, materialize(with_summary(prototypes), "prototypes"))


def attach_prototype(encoded: DataFrame, memory: PrototypeMemory | None) -> DataFrame:
    """Prototype id and summary of every row; -1 and "" without prototypes."""
    if memory is None:
        return encoded.withColumns({"prototype_id": F.lit(-1), "prototype_summary": F.lit("")})
    texts = memory.prototypes.select("prototype_id", F.col("summary").alias("prototype_summary"))
    return (
        assign_prototype(encoded, memory.clustering).join(texts, "prototype_id", "left")
        .withColumn("prototype_summary", F.coalesce("prototype_summary", F.lit("Unknown prototype")))
    )
