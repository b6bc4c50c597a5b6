"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of one label are compared in tiles of bounded size. A unit vector u is stored as scale *
int8 codes + error, and the norms of both parts bound what the error can add to a product of
codes: |e.v| and |u.f| by Cauchy-Schwarz. Only pairs whose product plus bound reaches the
threshold are computed again in double precision, so none is missed and none is wrong.
Equal vectors are compared once and carry their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyalign.llm.common import materialize
from surveyalign.llm.components import connected_components
from surveyalign.llm.minhash import forest

TILE = 1024

#: Room for rounding of the double-precision norms and products themselves.
SLACK = 1e-9

#: Pairs computed again at a time.
PAIRS = 100_000


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of scale * codes, norm of the error) of unit row vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def possible_pairs(unit: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of unit vectors whose cosine may reach the threshold, by int8 products.

    The codes' products are integers below 2 ** 24 for up to 1,000 dimensions and so exact in
    single precision; more dimensions use double.
    """
    codes, scale, norm, error = quantise(unit)
    wide = np.float32 if unit.shape[1] <= 1000 else np.float64
    product = (codes[rows].astype(wide) @ codes[columns].astype(wide).T).astype(np.float64)
    product *= scale[rows, None] * scale[None, columns]
    bound = np.outer(norm[rows], error[columns]) + np.outer(error[rows], norm[columns]) + np.outer(error[rows], error[columns])
    a, b = np.nonzero(product + bound >= threshold - SLACK)
    return rows[a], columns[b]


def _linked(threshold: float):
    """Per vector of a tile: how many others it links to here, and the vector that holds its component together."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["embedding"].tolist(), np.float64)
        # By a power of two, which changes no cosine: squares neither overflow nor vanish.
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        length = np.sqrt((vectors * vectors).sum(axis=1))
        unit = vectors / length[:, None]
        size, chunk = pdf["size"].to_numpy(), pdf["c"].to_numpy()
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        rows, columns = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        a, b = possible_pairs(unit, rows, columns, threshold)
        if i == j:
            a, b = a[a < b], b[a < b]
        linked = np.zeros((len(pdf), len(pdf)), bool)
        for k in range(0, len(a), PAIRS):
            p, q = a[k:k + PAIRS], b[k:k + PAIRS]
            cosine = (vectors[p] * vectors[q]).sum(axis=1) / (length[p] * length[q])
            p, q = p[cosine >= threshold], q[cosine >= threshold]
            linked[p, q] = linked[q, p] = True
        n_links = linked @ size
        root = forest(linked)
        node = pdf["node"].to_numpy()
        some = n_links > 0
        return pd.DataFrame({"node": node[some], "n": n_links[some], "root": node[root[some]]})
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have as many components
    and their cosine in double precision is ``threshold`` or more. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing. Rows that repeat count as
    often as they occur; null ids keep their rows and never name a component that has another
    id. Other columns are not carried. An empty table gives an empty result.

    The comparisons of one label grow with the square of its distinct vectors; tiles keep each
    task's share at two chunks of ``TILE``.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    table = materialize(source.withColumn("good", good), "vectors")
    classes = materialize(table.where("good").groupBy("label", "embedding").agg(F.count("*").alias("size"), F.min("id").alias("first_id")).withColumn(
        "node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "classes")
    chunks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    spread = classes.join(chunks, ["label", "dim"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn(
        "i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).select("label", "dim", "i", "j", "c", "node", "size", "embedding")
    found = materialize(tiles.groupBy("label", "dim", "i", "j").applyInPandas(_linked(threshold), "node long, n long, root long"), "linked")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select("node", "root"))
    named = classes.select("node", "label", "embedding", "size", "first_id").join(links, "node", "left").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    facts = named.join(least, "root").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), "component")
    joined = table.join(facts, F.col("good") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.col("id").eqNullSafe(component).alias("kept"))
