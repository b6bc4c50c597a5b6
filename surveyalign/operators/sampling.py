"""Seeded stratified samples and splits, without a window over a whole stratum.

A stratum may hold most of the table, so its rows are never ranked in one task. The
rows are ordered by a seeded hash of their id; a histogram over the leading hash digits
finds the bucket where the quota of each stratum ends. The histogram is repeated inside
that bucket until few rows are left, only those are ranked, and what remains is a
comparison of every row with the last sampled key of its stratum. All passes read the id
and the stratum alone, and shuffle at most a few thousand counts per stratum and task.

Ids may repeat: rows with one id are told apart by their place in the table, which is part
of the order, so quotas hold to the row. The table is read several times and its rows must
keep their places: hand in a stored table, not a chain of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyalign.functions import fixed_values as fv
from surveyalign.session import materialize

HASH_STEP = 3            # hexadecimal digits per histogram, so at most 4096 counts per stratum
RANK_ROWS = 1_000_000    # rows of a stratum that are ranked in one task


ORDER_DIGITS = 32 + 16   # of the hash, then of the place


def seeded_key(key: Column, seed: Column | int) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(key, F.lit(":"), seed.cast("string")))


def place() -> Column:
    """Place of a row in a stored table, as text of fixed width."""
    return F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")


def _order_key(key: Column, seed: Column | int, row: Column) -> Column:
    """Seeded order of the rows by hash and place; no two rows share it. A null id sorts by its place."""
    return F.concat(F.coalesce(seeded_key(key, seed), seeded_key(F.lit(""), seed)), row)


def _last_sampled(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Per stratum the order key of the last row within the quota.

    ``rows`` has the strata, the order key ``_hash`` and the sampling ``_ratio``.
    """
    rows = rows.where(F.col(strata[-1]).isNotNull())
    per_stratum = Window.partitionBy(*strata)
    quota = F.greatest(F.lit(1), F.floor(F.sum("_n").over(per_stratum) * F.col("_ratio")))
    scope, digits = rows.withColumn("_take", F.lit(None).cast("bigint")), 0
    while True:
        digits += HASH_STEP
        histogram = scope.groupBy(*strata, F.substring("_hash", 1, digits).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_n"), F.first("_ratio").alias("_ratio"), F.first("_take").alias("_take"))
        upto = F.sum("_n").over(per_stratum.orderBy("_prefix"))
        cuts = materialize(
            histogram.select(*strata, "_prefix", "_n", upto.alias("_upto"),
                             F.coalesce(F.col("_take"), quota).alias("_wanted"))
            .where((F.col("_upto") - F.col("_n") < F.col("_wanted")) & (F.col("_upto") >= F.col("_wanted")))
            .select(*strata, "_prefix", "_n", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take")),
            "sample-cuts")
        scope = rows.withColumn("_prefix", F.substring("_hash", 1, digits)).join(
            cuts.drop("_n"), [*strata, "_prefix"]).drop("_prefix")
        largest = cuts.agg(F.max("_n")).first()[0]
        if largest is None or largest <= RANK_ROWS or digits >= ORDER_DIGITS:
            break
    rank = F.row_number().over(per_stratum.orderBy("_hash"))
    last = (
        scope.select(*strata, "_hash", "_take", rank.alias("_rank"))
        .where(F.col("_rank") == F.col("_take"))
        .select(*strata, F.col("_hash").alias("_last_hash"))
    )
    return materialize(last, "sample-last")


def _flag(rows: DataFrame, last: DataFrame, strata: list[str], flag: str) -> DataFrame:
    within = F.col("_hash") <= F.col("_last_hash")
    return (
        rows.join(last, strata, "left")
        .withColumn(flag, F.coalesce(within, F.lit(False)))
        .drop("_last_hash")
    )


def stratified_flag(
    df: DataFrame, ratio: float, stratum: str, seed: int, key: str = "case_id", flag: str = "sampled"
) -> DataFrame:
    """``df`` with a column that marks the sampled rows.

    Each stratum of n rows gives max(1, floor(n * ratio)) rows; a null stratum gives none.
    """
    rows = df.withColumn("_hash", _order_key(F.col(key), seed, place())).withColumn("_ratio", F.lit(float(ratio)))
    last = _last_sampled(rows.select(stratum, "_hash", "_ratio"), [stratum])
    return _flag(rows, last, [stratum], flag).select(*df.columns, flag)


def stratified_sample(
    df: DataFrame, ratio: float, stratum: str = fv.TARGET_COLUMN, seed: int = 42, key: str = "case_id"
) -> DataFrame:
    return stratified_flag(df, ratio, stratum, seed, key).where("sampled").drop("sampled")


def split_test_pool_fewshot(
    df: DataFrame,
    test_ratio: float = fv.TEST_RATIO,
    fewshot_ratio: float = 0.01,
    seed: int = 42,
    stratum: str = fv.TARGET_COLUMN,
    key: str = "case_id",
) -> DataFrame:
    """``df`` with a ``split`` column: test, then few_shot drawn from the rest, else pool.

    ``df`` is read several times; hand in a stored table, not a chain of joins.
    """
    placed = df.withColumn("_row", place())
    by_test = placed.withColumn("_hash", _order_key(F.col(key), seed, F.col("_row"))).withColumn("_ratio", F.lit(float(test_ratio)))
    tested = _flag(by_test, _last_sampled(by_test.select(stratum, "_hash", "_ratio"), [stratum]), [stratum], "_test")
    rows = (
        tested.withColumn("_hash", _order_key(F.col(key), seed + 1, F.col("_row")))
        .withColumn("_ratio", F.lit(float(fewshot_ratio)))
    )
    rest = rows.where(~F.col("_test")).select(stratum, "_hash", "_ratio")
    flagged = _flag(rows, _last_sampled(rest, [stratum]), [stratum], "_few")
    split = F.when(F.col("_test"), "test").when(F.col("_few"), "few_shot").otherwise("pool")
    return flagged.select(*df.columns, split.alias("split"))


def split_test(
    df: DataFrame, test_ratio: float = fv.TEST_RATIO, seed: int = 42, stratum: str = fv.TARGET_COLUMN, key: str = "case_id",
) -> tuple[DataFrame, DataFrame]:
    """The test rows of ``split_test_pool_fewshot`` and all others with their place ``_row``, both stored.

    They are the same for every few-shot ratio, which ``sample_fewshot`` then draws from the others.
    """
    rows = df.withColumn("_row", place())
    rows = rows.withColumn("_hash", _order_key(F.col(key), seed, F.col("_row"))).withColumn("_ratio", F.lit(float(test_ratio)))
    tested = _flag(rows, _last_sampled(rows.select(stratum, "_hash", "_ratio"), [stratum]), [stratum], "_test")
    parts = materialize(tested.select(*df.columns, "_row", "_test"), "tested")
    return materialize(parts.where("_test").select(*df.columns), "test"), parts.where("NOT _test").drop("_test")


def sample_fewshot(
    rest: DataFrame, ratio: float, seed: int = 42, stratum: str = fv.TARGET_COLUMN, key: str = "case_id",
) -> DataFrame:
    """The few-shot rows of ``split_test_pool_fewshot`` from the second table of ``split_test``."""
    rows = rest.withColumn("_hash", _order_key(F.col(key), seed + 1, F.col("_row"))).withColumn("_ratio", F.lit(float(ratio)))
    flagged = _flag(rows, _last_sampled(rows.select(stratum, "_hash", "_ratio"), [stratum]), [stratum], "_few")
    return flagged.where("_few").select(*rest.drop("_row").columns)


def fewshot_variants(
    df: DataFrame,
    ratios: list[float] = fv.FEWSHOT_RATIOS,
    seeds: list[int] = fv.SEEDS,
    test_ratio: float = fv.TEST_RATIO,
    stratum: str = fv.TARGET_COLUMN,
    key: str = "case_id",
) -> DataFrame:
    """The splits of the whole grid at once: (key, stratum, fewshot_ratio, seed, split).

    The few-shot samples of one seed are the first rows of one order, whatever the ratio: rows
    are hashed and compared once per seed, every ratio's last row comes from the same order,
    and rows meet the ratios in the final select alone.
    """
    by_seed = (
        df.select(key, stratum, place().alias("_row"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
        .withColumn("_hash", _order_key(F.col(key), F.col("seed"), F.col("_row")))
        .withColumn("_ratio", F.lit(float(test_ratio)))
    )
    strata = ["seed", stratum]
    tested = (
        _flag(by_seed, _last_sampled(by_seed.select(*strata, "_hash", "_ratio"), strata), strata, "_test")
        .withColumn("_hash", _order_key(F.col(key), F.col("seed") + 1, F.col("_row")))
    )
    rest = tested.where(~F.col("_test")).select(*strata, "_hash")
    cuts = None
    for ratio in ratios:
        last = _last_sampled(rest.withColumn("_ratio", F.lit(float(ratio))), strata)
        one = last.select(*strata, F.lit(float(ratio)).alias("fewshot_ratio"), "_last_hash")
        cuts = one if cuts is None else cuts.unionByName(one)
    limits = cuts.groupBy(*strata).agg(F.map_from_entries(F.collect_list(F.struct("fewshot_ratio", "_last_hash"))).alias("_limits"))
    few = F.coalesce(F.col("_hash") <= F.col("_limits")[F.col("fewshot_ratio")], F.lit(False))
    split = F.when(F.col("_test"), "test").when(few, "few_shot").otherwise("pool")
    grid = tested.join(limits, strata, "left").withColumn("fewshot_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return grid.select(key, stratum, "fewshot_ratio", "seed", split.alias("split"))


def dry_run_sample(df: DataFrame, n: int = 20, seed: int = 42, key: str = "case_id") -> DataFrame:
    """``n`` seeded random rows for a trial run."""
    return df.orderBy(seeded_key(F.col(key), seed), key).limit(n)
