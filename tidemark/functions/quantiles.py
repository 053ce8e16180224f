"""Exact quantiles of any number of rows, without gathering them.

The built-in exact `percentile` keeps every distinct value of a group in one task. Here each wanted
rank has a bracket of values, at first the whole group:

1. the values inside a bracket are counted in `BUCKETS` equal parts, by partial aggregation where
   they are read; the running counts tell the part that holds a rank, and the part's least and
   greatest value are the next bracket;
2. this goes on until a bracket holds at most `KEPT` values or only one distinct one; parts are equal
   by value and, every other time, by magnitude, so clustered values and far outliers need few rounds;
3. the values of the last brackets are counted by value and ranked.

Brackets of one group are equal or have no value in common, as they are parts of one division. So one
count serves all ranks, and a value is counted once in a round, whatever the number of ranks. Brackets
are a few rows for each group and are written between rounds. Every round reads the table once and
shuffles nothing but counts. The ranks are exact whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.cells import cell
from tidemark.functions.joins import fits_broadcast, matches, spread_hot
from tidemark.session import stored

ACCURACY = 2_000  # of the approximate quantiles
BUCKETS = 4_096
KEPT = 10_000


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column,
    probabilities: Sequence[float],
    few_groups: bool | None = None,
    also: Mapping[str, Callable[[Column], Column]] | None = None,
    kept: int | None = None,
) -> DataFrame:
    """One row per group: `by…`, `n` and `quantiles`, linearly interpolated, in order.

    NULL and NaN are left out; a group of nothing else gives no row. `also` names further
    aggregates of the value that the first pass computes. `few_groups=True` states that the
    number of groups is bounded by construction; otherwise they are counted.
    """
    also, kept = also or {}, KEPT if kept is None else kept
    keys = [f"__k{i}" for i in range(len(by))]
    base = df.select(*[cell(b).alias(k) for b, k in zip(by, keys)], value.cast("double").alias("__v"))
    base = base.where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    facts = base.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        *[make(F.col("__v")).alias(name) for name, make in also.items()],
    )
    facts = stored(facts, "facts")
    if few_groups is None:
        few_groups = fits_broadcast(facts)

    # Two ranks for each probability, between which a quantile is interpolated.
    at = [F.lit(float(p)) * (F.col("__n") - 1) for p in probabilities]
    ranks = [r.cast("long") for a in at for r in (F.floor(a), F.ceil(a))]
    rows = [
        F.struct(
            F.lit(i).alias("__t"), r.alias("__rank"), F.col("__lo"), F.col("__hi"), F.lit(0).cast("long").alias("__before"), F.col("__n").alias("__inside")
        )
        for i, r in enumerate(ranks)
    ]
    brackets = facts.select(*keys, F.inline(F.array(*rows)))
    wide = (F.col("__inside") > kept) & (F.col("__lo") < F.col("__hi"))
    for turn in count():
        open_ones = brackets.where(wide)
        if open_ones.isEmpty():
            break
        narrowed = _narrowed(base, open_ones, keys, len(ranks), few_groups, by_magnitude=turn % 2 == 1)
        brackets = stored(brackets.where(~wide).unionByName(narrowed), "brackets")

    single = brackets.where("__lo = __hi").select(*keys, "__t", F.col("__lo").alias("__v"))
    last = brackets.where("__lo < __hi")
    counts = _inside(base, last, keys, len(ranks), few_groups).groupBy(*keys, "__lo", "__hi", "__v").agg(F.count("*").alias("__c"))
    ranked = _holding(counts, last, keys, "__v", few_groups).select(*keys, "__t", "__v")
    found = single.unionByName(ranked).groupBy(*keys).agg(
        *[F.min(F.when(F.col("__t") == i, F.col("__v"))).alias(f"__q{i}") for i in range(len(ranks))]
    )
    pairs = [(F.col(k), F.col(f"{k}_f")) for k in keys]
    found = found.select(*[F.col(k).alias(f"{k}_f") for k in keys], *[f"__q{i}" for i in range(len(ranks))])
    if keys:
        joined = facts.join(F.broadcast(found) if few_groups else found, matches(pairs))
    else:  # one group: its quantiles are one row
        one = found.agg(F.first(F.struct(*[f"__q{i}" for i in range(len(ranks))])).alias("q")).scalar()
        joined = facts.where("__n > 0").withColumns({f"__q{i}": one.getField(f"__q{i}") for i in range(len(ranks))})

    def between(i: int) -> Column:
        low, high = F.col(f"__q{2 * i}"), F.col(f"__q{2 * i + 1}")
        return F.when(low == high, low).otherwise(low + (high - low) * (at[i] - F.floor(at[i])))

    return joined.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)],
        F.col("__n").alias("n"),
        *also,
        F.array(*[between(i) for i in range(len(probabilities))]).alias("quantiles"),
    )


def _inside(base: DataFrame, brackets: DataFrame, keys: Sequence[str], most: int, few_groups: bool) -> DataFrame:
    """Each value once, with the bounds of its group's bracket that holds it; at most `most` brackets differ."""
    spans = brackets.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("__lo", "__hi"))).alias("__spans"))
    if keys:
        listed = spans.select(*[F.col(k).alias(f"{k}_s") for k in keys], "__spans")
        pairs = [(F.col(k), F.col(f"{k}_s")) for k in keys]
        if few_groups:
            joined = base.join(F.broadcast(listed), matches(pairs))
        else:
            left, right = spread_hot(base, listed, keys, [f"{k}_s" for k in keys])
            right = right.withColumnRenamed("__salt", "__salt_s")
            joined = left.join(right, matches([*pairs, (F.col("__salt"), F.col("__salt_s"))]))
    else:
        joined = base.withColumn("__spans", spans.scalar())
    span = [F.get("__spans", F.lit(i)) for i in range(most)]
    held = F.coalesce(*[F.when(F.col("__v").between(s["__lo"], s["__hi"]), s) for s in span])
    return joined.select(*keys, "__v", held.alias("__span")).where(F.col("__span").isNotNull()).select(*keys, "__v", "__span.*")


def _magnitude(v: Column) -> Column:
    """Grows with the value as its logarithm does, on both sides of 0; infinities lie beyond all others."""
    size = F.least(F.log(F.abs(v)), F.lit(1000.0)) + 746.0
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def _narrowed(
    base: DataFrame, brackets: DataFrame, keys: Sequence[str], most: int, few_groups: bool, by_magnitude: bool
) -> DataFrame:
    """The brackets' parts that hold their ranks."""
    place = _magnitude if by_magnitude else (lambda v: v / 2)  # halves, as a difference may exceed the range
    value, low, high = (place(F.col(c)) for c in ("__v", "__lo", "__hi"))
    share = F.try_divide(value - low, high - low)
    part = F.when(share.isNull() | F.isnan(share), F.when(F.col("__v") == F.col("__hi"), BUCKETS - 1).otherwise(0)).otherwise(
        F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    )
    counts = (
        _inside(base, brackets, keys, most, few_groups)
        .groupBy(*keys, "__lo", "__hi", part.cast("int").alias("__part"))
        .agg(F.count("*").alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    )
    hit = _holding(counts, brackets, keys, "__part", few_groups)
    bounds = [F.col("__least").alias("__lo"), F.col("__most").alias("__hi")]
    return hit.select(*keys, "__t", "__rank", *bounds, (F.col("__before") + F.col("__upto")).alias("__before"), F.col("__c").alias("__inside"))


def _holding(counts: DataFrame, brackets: DataFrame, keys: Sequence[str], order: str, few_groups: bool) -> DataFrame:
    """For each rank the counted part of its bracket that holds it; `__upto` of the bracket's values come before the part."""
    before = Window.partitionBy(*keys, "__lo", "__hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = [*keys, "__lo", "__hi"]
    placed = counts.withColumn("__upto", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumnsRenamed({c: f"{c}_c" for c in own})
    ranks = brackets.select(*own, "__t", "__rank", "__before")
    place = F.col("__rank") - F.col("__before")
    holds = (F.col("__upto") <= place) & (place < F.col("__upto") + F.col("__c"))
    joined = placed.join(F.broadcast(ranks) if few_groups else ranks, matches([(F.col(c), F.col(f"{c}_c")) for c in own]) & holds)
    return joined.drop(*[f"{c}_c" for c in own], "__lo", "__hi")
