"""Bootstrap intervals of means and fits by Poisson weights.

A resample gives each row a weight, how often it was drawn; for many rows that is a Poisson variable of
mean 1. The weight is taken from a digest of the row's key and the replicate, so it hangs on no layout, no
task and no order, and sums over it are added up where the rows are read: no row is ever moved to be
resampled. Each digest serves four replicates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.cells import cell

REPLICATES = 200
MOST = 9  # the greatest weight; beyond it lies less than one in a million
#: Upper bounds of the weights 0, 1, ... among 32-bit numbers.
BOUNDS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(MOST)]


def weight(digest: Column, quarter: Column) -> Column:
    """The Poisson weight that a quarter (0 to 3) of a row's MD5 digest in hexadecimal gives."""
    number = F.conv(F.substring(digest, quarter * 8 + 1, F.lit(8)), 16, 10).cast("long")
    out = F.lit(MOST)
    for k in range(MOST - 1, -1, -1):
        out = F.when(number < BOUNDS[k], k).otherwise(out)
    return out


def weighted(df: DataFrame, key: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each row once for each replicate that draws it, with `replicate` and `weight`."""
    own = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(cell(k).cast("string"), F.lit("")) for k in key])
    groups = df.withColumn("__group", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(replicates / 4) - 1))))
    digests = groups.withColumn("__digest", F.md5(F.concat_ws(":", own, F.col("__group").cast("string")).cast("binary")))
    quarters = digests.withColumn("__quarter", F.explode(F.sequence(F.lit(0), F.lit(3))))
    drawn = quarters.withColumns(
        {"replicate": F.col("__group") * 4 + F.col("__quarter"), "weight": weight(F.col("__digest"), F.col("__quarter"))}
    )
    return drawn.where((F.col("replicate") < replicates) & (F.col("weight") > 0)).drop("__group", "__digest", "__quarter")


def _interval(replicas: DataFrame, by: Sequence[str], names: Sequence[str], width: float) -> DataFrame:
    """Central percentiles of the replicates' figures; a group has at most as many as there are replicates."""
    low, high = (1 - width) / 2, (1 + width) / 2
    out = []
    for n in names:
        out += [F.percentile(n, F.lit(low)).alias(f"{n}_low"), F.percentile(n, F.lit(high)).alias(f"{n}_high")]
    return replicas.groupBy(*by).agg(*out)


def bootstrap_means(
    df: DataFrame, by: Sequence[str], measure: str, key: Sequence[str], replicates: int = REPLICATES, width: float = 0.95, seed: int = 0
) -> DataFrame:
    """`by…, n, mean, mean_low, mean_high`: means with bootstrap intervals. `key` names each row; missing measures are left out."""
    known = df.where(cell(measure).isNotNull()).select(*[cell(c) for c in dict.fromkeys([*by, *key])], cell(measure).cast("double").alias("__x"))
    means = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    drawn = weighted(known, key, replicates, seed)
    replicas = drawn.groupBy(*by, "replicate").agg((F.sum(F.col("__x") * F.col("weight")) / F.sum("weight")).alias("mean"))
    return _matched(means, _interval(replicas, by, ["mean"], width), by)


def bootstrap_fits(
    df: DataFrame, x: str, y: str, by: Sequence[str], key: Sequence[str], replicates: int = REPLICATES, width: float = 0.95, seed: int = 0
) -> DataFrame:
    """`by…, n, slope_low, slope_high, intercept_low, intercept_high` of linear fits of `y` on `x`.

    Rows with a missing side are left out. A replicate in which x never varies gives no fit.
    """
    known = df.where(cell(x).isNotNull() & cell(y).isNotNull()).select(
        *[cell(c) for c in dict.fromkeys([*by, *key])], cell(x).cast("double").alias("__x"), cell(y).cast("double").alias("__y")
    )
    sizes = known.groupBy(*by).agg(F.count("*").alias("n"))
    w, a, b = F.col("weight"), F.col("__x"), F.col("__y")
    sums = weighted(known, key, replicates, seed).groupBy(*by, "replicate").agg(
        F.sum(w).alias("w"), F.sum(w * a).alias("wx"), F.sum(w * b).alias("wy"), F.sum(w * a * a).alias("wxx"), F.sum(w * a * b).alias("wxy"),
        F.min(a).alias("least"), F.max(a).alias("most"),
    )
    spread = F.when(F.col("least") < F.col("most"), F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    slope = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), spread)
    fits = sums.withColumn("slope", slope).withColumn("intercept", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    return _matched(sizes, _interval(fits, by, ["slope", "intercept"], width), by)


def _matched(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups side by side, missing keys equal; both sides hold one row per group."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & cell(c).eqNullSafe(cell(f"__{c}"))
    return left.join(renamed, on, "left").drop(*[f"__{c}" for c in by])
