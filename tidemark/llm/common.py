"""Helpers that the operators share: rows kept whole beside working columns, folds, dense positions.

Working columns never meet a caller's columns: the caller's row travels as one struct named `row`
and is unpacked at the end. Where an operator adds a column that the input already has, the
operator's column stands in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from tidemark.session import stored


def whole(df: DataFrame) -> Column:
    """All columns of a table as one struct, named `row`."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def fresh(taken: list[str], name: str) -> str:
    """A column name like `name` that none of the taken ones equals, whatever the case."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def unpacked(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The caller's columns out of `row`, with the added ones behind or in place of equal names."""
    names = {n.lower() for n in added}
    kept = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python are bounded by bytes, unless the session has a bound of its own.

    By rows alone, a batch of long texts takes many times the memory, in the JVM and in each worker.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; 2 is held out. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def text_of(column: Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def positioned(df: DataFrame, order: list[str], label: str, within: str | None = None) -> DataFrame:
    """Rows with `position` (gapless from 0) and `total` in the given order, for each value of `within`.

    No task sees more than its own range of the order: rows are dealt by range and written once with
    their place in their partition, then the partitions' sizes (a row for each partition and value)
    are summed up. A value that holds most rows is spread over partitions by the rest of the order.
    `order` must begin with `within` and be total, but for rows that are equal.
    """
    keys = [within] if within else []
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        label,
    ).withColumn("part", F.shiftrightunsigned("place", 33))
    runs = placed.groupBy("part", *keys).agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("run_part"),
        *[F.col(k).alias("run_key") for k in keys],
        "begin",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(every).alias("total"),
    )
    on = F.col("part") == F.col("run_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("run_key"))
    return (
        placed.join(runs, on)
        .withColumn("position", F.col("place") - F.col("begin") + F.col("offset"))
        .drop("place", "part", "run_part", "run_key", "begin", "offset")
    )
