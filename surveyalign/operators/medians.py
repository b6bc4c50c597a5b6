"""Exact medians without holding a column's distinct values anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRACKET = 2e-4           # share of the rows on either side of the middle that the first scan leaves open
ACCURACY = 10_000        # of the quantile sketch: its rank error is at most a row in so many
BINS = 4096              # counts per value range and pass
LIST_ROWS = 10_000       # values of a range that are listed instead of divided further
MAX_PASSES = 200


def exact_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """Median of every column over its values that are neither null nor NaN; None without any.

    The first scan brackets the middle rows of all columns by mergeable quantile sketches; the
    second only counts if both ends of every bracket are one value, which is then the median. Else it
    counts what lies below each bracket and lists or bins what lies inside, and that is all
    where a bracket holds few different values. Else the bin of the middle row is divided again,
    a scan at a time. Every scan is one aggregate over all columns that combines before the shuffle
    and returns at most ``BINS`` rows per column. A bracket that misses its row is the whole range.
    """
    values = {name: F.when(~F.isnan(c.cast("double")), c.cast("double") + 0.0) for name, c in columns.items()}
    if not values:
        return {}
    stats = df.agg(*[F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
                              F.percentile_approx(v, [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias("bracket")).alias(f"c{i}")
                     for i, v in enumerate(values.values())]).first()
    # One search per column and middle row: [column, low, high, rank inside the range].
    searches, found = {}, {}
    for i, name in enumerate(values):
        s = stats[f"c{i}"]
        if s["n"]:
            for rank in {(s["n"] - 1) // 2, s["n"] // 2}:
                searches[name, rank] = (*s["bracket"], max(1, int(4 * BRACKET * s["n"])), rank)
    bounds = {name: (stats[f"c{i}"]["low"], stats[f"c{i}"]["high"], stats[f"c{i}"]["n"]) for i, name in enumerate(values)}
    first = True
    wanted = {name: sorted(r for n, r in searches if n == name) for name in values}
    if all(low == high for low, high, _n, _rank in searches.values()):
        _settle_single(df, values, searches, found)
    for _ in range(MAX_PASSES):
        for key, (low, high, _n, _rank) in list(searches.items()):
            if low == high and not first:
                found[key] = low
                del searches[key]
        if not searches:
            break
        ranges = sorted({(name, low, high, n) for (name, _), (low, high, n, _) in searches.items()})
        parts = []
        for i, (name, low, high, n) in enumerate(ranges):
            v = values[name]
            step = high / BINS - low / BINS
            spread = F.lit(0.0) if step == 0 or math.isinf(step) else F.floor((v / 1.0 - F.lit(low)) / F.lit(step)).cast("double")
            # A short range, or one too narrow to divide, is listed value by value.
            bin_ = v if n <= LIST_ROWS or step == 0 else F.least(F.greatest(spread, F.lit(0.0)), F.lit(float(BINS - 1)))
            if math.isinf(step):
                bin_ = F.when(v < 0, F.lit(0.0)).otherwise(F.lit(1.0))
            inside = v.between(F.lit(low), F.lit(high))
            part = F.when(inside, F.struct(F.lit(i).alias("i"), F.lit(False).alias("below"), bin_.alias("bin"), v.alias("v")))
            if first:
                part = part.when(v < low, F.struct(F.lit(i).alias("i"), F.lit(True).alias("below"), F.lit(0.0).alias("bin"), v.alias("v")))
            parts.append(part)
        rows = df.select(F.explode(F.array(*parts)).alias("r")).where("r IS NOT NULL").groupBy("r.i", "r.below", "r.bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("r.v").alias("low"), F.max("r.v").alias("high")).collect()
        bins: dict[int, list] = {}
        for row in rows:
            bins.setdefault(row["i"], []).append(row)
        for key, (low, high, n, rank) in list(searches.items()):
            for row in sorted(bins[ranges.index((key[0], low, high, n))], key=lambda r: (not r["below"], r["bin"])):
                if rank < row["n"]:
                    searches[key] = (row["low"], row["high"], row["n"], rank) if not row["below"] else (*bounds[key[0]], key[1])
                    break
                rank -= row["n"]
            else:
                searches[key] = (*bounds[key[0]], key[1])
        first = False
    if searches:
        raise RuntimeError("medians did not settle")
    return {name: sum(found[name, r] for r in ranks) / len(ranks) if ranks else None for name, ranks in wanted.items()}


def _settle_single(df: DataFrame, values: dict[str, Column], searches: dict, found: dict) -> None:
    """Move searches whose bracket is one value from ``searches`` to ``found``, but for those that it misses."""
    at = {name: low for (name, _rank), (low, *_rest) in searches.items()}
    if not at:
        return
    counts = df.agg(*[F.struct(F.count_if(values[name] < low).alias("below"), F.count_if(values[name] == low).alias("equal")).alias(f"c{i}")
                      for i, (name, low) in enumerate(at.items())]).first()
    for i, (name, low) in enumerate(at.items()):
        below, equal = counts[f"c{i}"]
        for key in [k for k in searches if k[0] == name and below <= k[1] < below + equal]:
            found[key] = low
            del searches[key]
