"""Questions to an operation log `(run_id, step_no, op, op_type, column, args, success, error)`.

Logs of many runs are append-only tables of any size, so every view stays a DataFrame; the
histories are ordered rows, not lists gathered per operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.joins import lookup_join
from tidemark.plans.runner import LOG_SCHEMA, OPERATIONS, QUERY


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def record_log(log: DataFrame, path: str) -> None:
    """Put the logs of whole runs into a stored table, each run in place of what the table had of it.

    Runs are partitions, and only those that the log holds are replaced. So a run that is repeated, or a
    job that is retried, counts once. `append_log` keeps both.
    """
    rows = log.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("run_id").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log stored by `record_log`. Run ids are text, also where they look like numbers."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def calls_per_op(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("n_calls"))


def call_totals(log: DataFrame) -> DataFrame:
    """One row, `n_calls, n_ops`. The operations are counted from the per-operation counts."""
    return calls_per_op(log).agg(
        F.coalesce(F.sum("n_calls"), F.lit(0)).alias("n_calls"), F.count("op").alias("n_ops")
    )


def success_rates(log: DataFrame) -> DataFrame:
    """`op, n_calls, n_success, success_rate` and the percentage for display."""
    counts = log.groupBy("op").agg(F.count("*").alias("n_calls"), F.count_if("success").alias("n_success"))
    rate = F.col("n_success") / F.col("n_calls")
    return counts.withColumns({"success_rate": rate, "success_pct": F.round(rate * 100, 2)})


def history_by_op(log: DataFrame) -> DataFrame:
    """Every call under its operation, in run and step order."""
    return log.select("op", "run_id", "step_no", "args", "success").orderBy("op", "run_id", "step_no")


def history_by_column(log: DataFrame) -> DataFrame:
    """The successful changes under the column they touched, in run and step order."""
    changes = log.where(F.col("success") & (F.col("op_type") != QUERY))
    return changes.select("column", "run_id", "step_no", "op", "args").orderBy("column", "run_id", "step_no")


def attach_ids(log: DataFrame, tool_map: DataFrame, small: bool | None = None) -> DataFrame:
    """The flat log with each operation's `tool_id`; unmatched ones keep a NULL id.

    The map holds one row per name. Arguments are written as JSON.
    """
    ids = tool_map.select(F.col("name").alias("op"), "tool_id")
    flat = log.select("run_id", "step_no", "op", "success", F.to_json("args").alias("args"))
    return lookup_join(flat, ids, ["op"], "left", small)


def unmatched_ops(flat: DataFrame) -> DataFrame:
    """Operations that the map does not list, with their number of calls."""
    return flat.where(F.col("tool_id").isNull()).groupBy("op").agg(F.count("*").alias("n_calls"))


def with_op_types(log: DataFrame) -> DataFrame:
    """Add `op_type` to a recorded log that only has the operation's name."""
    kinds = F.create_map(*[F.lit(x) for name, o in OPERATIONS.items() for x in (name, o.op_type)])
    return log.withColumn("op_type", F.try_element_at(kinds, F.col("op")))
