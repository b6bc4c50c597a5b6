"""Consistency checks between the stages of the pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.functions.codes import decode
from surveyalign.session import materialize


def illegal_code_check(df: DataFrame, column: str) -> DataFrame:
    """One row: how often each excluded code occurs, and any code above the limit."""
    code = F.col(f"`{column}`").try_cast("double")
    return df.agg(
        *[F.count_if(code == c).alias(f"n_code_{c}") for c in fv.ILLEGAL_MODE_CODES],
        F.count_if(code > fv.MAX_RAW_MODE).alias("n_above_limit"),
        F.max(code).alias("max_code"),
    )


def crosswalk_audit(df: DataFrame, raw: str, unified: str = "main_mode") -> DataFrame:
    """Distinct raw to canonical pairs with the label."""
    return (
        df.select(F.col(raw).try_cast("bigint").alias("raw_code"), F.col(unified).alias("unified_code"))
        .distinct()
        .withColumn("unified_label", decode(F.col("unified_code"), fv.MODE_LABELS))
        .orderBy("raw_code", "unified_code")
    )


def stage_distributions(stages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Value counts, null included, of one column per stage."""
    parts = [
        df.groupBy(F.col(f"`{column}`").cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("stage"), "value", "n")
        for name, (df, column) in stages.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def snapshot_compare(cached: DataFrame, fresh: DataFrame, column: str = fv.TARGET_COLUMN) -> DataFrame:
    """Whether a stored table still has the rows and the label set of a fresh one."""
    tag = lambda df, flag: df.select(F.col(column).alias("label"), F.lit(flag).alias("cached"))
    counts = tag(cached, True).unionByName(tag(fresh, False)).groupBy("label").agg(
        F.count_if(F.col("cached")).alias("c"), F.count_if(~F.col("cached")).alias("f"))
    same_label = (F.col("c") > 0) == (F.col("f") > 0)
    return counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_cached"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_fresh"),
        (F.coalesce(F.sum("c"), F.lit(0)) == F.coalesce(F.sum("f"), F.lit(0))).alias("row_count_matches"),
        F.coalesce(F.bool_and(same_label | F.col("label").isNull()), F.lit(True)).alias("label_set_matches"),
    )


LEAVES, BRANCHES = 1 << 16, 1 << 8


def _fingerprinted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, leaf, and two independent fingerprints of each whole row."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    # A null is told from the values around it by its place.
    marked = [x for c in columns for x in (c.isNull(), c)]
    return df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).cast("int").alias("leaf"),
                     F.xxhash64(*marked).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *marked).cast("decimal(38,0)").alias("b"))


def snapshot_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """(branch, leaf, n, a, b): order-free sums of row fingerprints per key range, at most ``LEAVES`` rows.

    Worth storing with a table: a later comparison reads the tree, and the table only where it differs.
    """
    tallies = _fingerprinted(df, keys).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return tallies.select((F.col("leaf") % BRANCHES).alias("branch"), "leaf", "n", "a", "b")


def snapshot_diff(cached: DataFrame, fresh: DataFrame, keys: list[str], cached_tree: DataFrame | None = None) -> DataFrame:
    """(keys, status, n_cached, n_fresh) of the keys whose rows differ between two tables of the same columns.

    ``status`` is removed, added, changed (as many rows, other contents) or count (another number
    of rows). Rows may repeat and have any order; null keys are keys. Equal branches of the two
    trees are skipped, then equal leaves; rows are read again only in leaves that differ.
    """
    old = materialize(snapshot_tree(cached, keys) if cached_tree is None else cached_tree, "tree")
    new = materialize(snapshot_tree(fresh, keys), "tree")

    def unequal(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        sums = lambda df, side: df.groupBy(on).agg(F.struct(F.sum("n"), F.sum("a"), F.sum("b")).alias(side))
        return sums(left, "l").join(sums(right, "r"), on, "full").where(~F.col("l").eqNullSafe(F.col("r"))).select(on)

    branches = unequal(old, new, "branch")
    leaves = materialize(unequal(old.join(branches, "branch", "left_semi"), new.join(branches, "branch", "left_semi"), "leaf"), "leaves")
    side = lambda df, flag: _fingerprinted(df, keys).join(leaves, "leaf", "left_semi").select(*keys, F.lit(flag).alias("fresh"), "a", "b")
    rows = side(cached, 0).unionByName(side(fresh, 1))
    part = lambda flag: [F.sum(F.when(F.col("fresh") == flag, F.col(c))).alias(f"{c}{flag}") for c in ("a", "b")]
    facts = rows.groupBy(*keys).agg(F.count_if(F.col("fresh") == 0).alias("n_cached"), F.count_if(F.col("fresh") == 1).alias("n_fresh"), *part(0), *part(1))
    same = F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1")) & (F.col("n_cached") == F.col("n_fresh"))
    status = F.when(F.col("n_fresh") == 0, "removed").when(F.col("n_cached") == 0, "added").when(F.col("n_cached") == F.col("n_fresh"), "changed").otherwise("count")
    return facts.where(~same).select(*keys, status.alias("status"), "n_cached", "n_fresh")


def prediction_audit(
    predictions: DataFrame, keys: list[str] = ["model", "fewshot_ratio", "seed"], allowed: list[int] = fv.MODES
) -> DataFrame:
    """Labels per run: true and predicted ones with their counts, and whether they are allowed."""
    sides = F.array(
        F.struct(F.lit("true").alias("side"), F.col("main_mode").alias("label")),
        F.struct(F.lit("predicted").alias("side"), F.col("predicted_mode").alias("label")),
    )
    counts = predictions.groupBy(*keys, "main_mode", "predicted_mode").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.select(*keys, "n", F.inline(sides)).where(F.col("label").isNotNull())
        .groupBy(*keys, "side", "label").agg(F.sum("n").alias("n"))
        .withColumn("in_domain", F.col("label").isin(allowed))
    )
