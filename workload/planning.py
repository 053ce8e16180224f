"""Plans, their logs and the questions to logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.cells import literal_rows
from tidemark.plans import log as L
from tidemark.plans.runner import apply_plan, step
from tidemark.session import scratch_path
from tidemark.sources import files
from workload.tables import CALL_LOG, CALLS, call_log, on, round6

STEPS = [
    step("rename_column", column="o_orderstatus", new_column="status"),
    step("replace_substring", column="o_orderpriority", old_substring="-", new_substring=" "),
    step("drop_column", column="no_such_column"),
    step("convert_column_to_int", column="day"),
    step("convert_column_to_datetime", column="day"),
    step("convert_column_to_int", column="key_text"),
    step("sum_value", column="key_text", value=1),
    step("fill_col_na", column="price", fill_value=0.0),
    step("sum_value", column="imputed_price", value=1),
    step("divide_cols", first_col="price", second_col="key_text", new_col_name="price_per_key"),
    step("map_col_values", column="status", mapping={"O": 0, "F": 1}),
    step("rename_column", column="status", new_column="status_code"),
    step("get_n_cols"),
]


def _raw_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("string").alias("key_text"),
        "o_orderstatus",
        "o_orderpriority",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.nullif(F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("price"),
    )


@on("orders")
def plan_orders(orders: DataFrame) -> DataFrame:
    return round6(apply_plan(_raw_orders(orders), STEPS).df, "price_per_key")


@on("orders")
def plan_orders_log(orders: DataFrame) -> DataFrame:
    log = apply_plan(_raw_orders(orders), STEPS, run_id="orders").log
    return log.select("run_id", "step_no", "op", "op_type", "column", "success", "n_coerced")


@on("orders")
def plan_orders_lineage(orders: DataFrame) -> DataFrame:
    return apply_plan(_raw_orders(orders), STEPS).lineage_table("orders")


@on("lineitem")
def log_calls_per_op(lineitem: DataFrame) -> DataFrame:
    return L.calls_per_op(call_log(lineitem))


@on("lineitem")
def log_totals(lineitem: DataFrame) -> DataFrame:
    return L.call_totals(call_log(lineitem))


@on("lineitem")
def log_success_rates(lineitem: DataFrame) -> DataFrame:
    return round6(L.success_rates(call_log(lineitem)), "success_rate")


@on("lineitem")
def log_history_by_op(lineitem: DataFrame) -> DataFrame:
    return L.history_by_op(call_log(lineitem)).withColumn("args", F.to_json("args"))


@on("lineitem")
def log_history_by_column(lineitem: DataFrame) -> DataFrame:
    return L.history_by_column(L.with_op_types(call_log(lineitem))).withColumn("args", F.to_json("args"))


# The ids of the operations. Two names match no operation that can be called.
TOOL_IDS = [
    (1, "dummy", 0, True),
    (2, "get_n_cols", 0, True),
    (3, "get_cols_names", 0, True),
    (4, "has_nulls", 1, True),
    (5, "get_unique_counts", 1, True),
    (6, "get_column_type", 1, True),
    (7, "get_col_unique", 1, True),
    (8, "replace_substring", 3, False),
    (9, "drop_column", 1, False),
    (10, "map_col_values", 2, False),
    (11, "copy_column", 2, False),
    (12, "convert_column_to_datetime", 1, False),
    (13, "convert_column_to_float", 1, False),
    (14, "convert_column_to_int", 1, False),
    (15, "fill_col_na", 2, False),
    (16, "rename_column", 3, False),
    (17, "subtract_value", 2, False),
    (18, "sum_value", 2, False),
    (19, "divide_value", 2, False),
    (20, "multiply_value", 2, False),
    (21, "power_value", 2, False),
    (22, "subtract_cols", 3, False),
    (23, "sum_cols", 3, False),
    (24, "divide_cols", 3, False),
    (25, "multiply_cols", 3, False),
    (26, "power_cols", 3, False),
]


def tool_map(spark: SparkSession) -> DataFrame:
    """The ids as a CSV table, which is how they are handed on."""
    path = scratch_path(spark, "tool-map")
    files.write_csv(literal_rows(spark, TOOL_IDS, files.TOOL_MAP_SCHEMA), path)
    return files.read_tool_map(spark, path)


@on("lineitem")
def log_appended(lineitem: DataFrame) -> DataFrame:
    """Two logs appended to one stored table."""
    log = call_log(lineitem)
    path = scratch_path(lineitem.sparkSession, "log")
    L.append_log(log, path)
    L.append_log(log.withColumn("run_id", F.concat(F.lit("again-"), "run_id")), path)
    return L.calls_per_op(lineitem.sparkSession.read.parquet(path))


@on("lineitem")
def log_tool_ids(lineitem: DataFrame) -> DataFrame:
    return L.attach_ids(call_log(lineitem), tool_map(lineitem.sparkSession))


@on("lineitem")
def log_unmatched_ops(lineitem: DataFrame) -> DataFrame:
    return L.unmatched_ops(L.attach_ids(call_log(lineitem), tool_map(lineitem.sparkSession)))


BIG = 9_000_000_000_000_000_000
OVERFLOW_STEPS = [
    step("multiply_cols", first_col="l_orderkey", second_col="large", new_col_name="product"),
    step("sum_cols", first_col="l_orderkey", second_col="l_linenumber", new_col_name="total"),
    step("multiply_value", column="total", value=2),
    step("subtract_value", column="large", value=-BIG),
    step("convert_column_to_int", column="flag"),
    step("rename_column", column="total", new_column="doubled"),
]


def _large_lines(lineitem: DataFrame) -> DataFrame:
    """The product with `large` exceeds 64 bits on some rows only; `flag` is a number on some rows only."""
    large = F.when(F.col("l_linenumber") == 1, F.lit(BIG)).otherwise(F.lit(2).cast("long"))
    flag = F.when(F.col("l_returnflag") == "A", F.col("l_returnflag")).otherwise("7")
    return lineitem.select("l_orderkey", "l_linenumber", large.alias("large"), flag.alias("flag"))


@on("lineitem")
def plan_overflow(lineitem: DataFrame) -> DataFrame:
    """Steps whose results exceed 64 bits are rejected, the others apply."""
    return apply_plan(_large_lines(lineitem), OVERFLOW_STEPS).df


@on("lineitem")
def plan_overflow_log(lineitem: DataFrame) -> DataFrame:
    log = apply_plan(_large_lines(lineitem), OVERFLOW_STEPS, run_id="lines").log
    return log.select("run_id", "step_no", "op", "success")


@on("lineitem")
def plan_lineage_of_kept(lineitem: DataFrame) -> DataFrame:
    """A rename that hangs on the data: the step before it only holds if no return flag is `A`."""
    flags = lineitem.select(F.when(F.col("l_returnflag") == "A", "x").otherwise("7").alias("flag"), "l_linenumber")
    steps = [
        step("convert_column_to_int", column="flag"),
        step("sum_cols", first_col="flag", second_col="l_linenumber", new_col_name="line"),
        step("rename_column", column="line", new_column="number"),
        step("rename_column", column="flag", new_column="returned"),
    ]
    return apply_plan(flags, steps).lineage_table("lines")


QUERIES = {
    "plan_overflow": plan_overflow,
    "plan_overflow_log": plan_overflow_log,
    "plan_lineage_of_kept": plan_lineage_of_kept,
    "plan_orders": plan_orders,
    "plan_orders_log": plan_orders_log,
    "plan_orders_lineage": plan_orders_lineage,
    "log_calls_per_op": log_calls_per_op,
    "log_appended": log_appended,
    "log_totals": log_totals,
    "log_success_rates": log_success_rates,
    "log_history_by_op": log_history_by_op,
    "log_history_by_column": log_history_by_column,
    "log_tool_ids": log_tool_ids,
    "log_unmatched_ops": log_unmatched_ops,
}

_IDS = ", ".join(f"({i}, '{n}')" for i, n, *_ in TOOL_IDS)
_FLAT = f"""
select run_id, step_no, op, success, args, cast(tool_id as int) as tool_id
from ({CALL_LOG}) left join (values {_IDS}) m(tool_id, name) on op = name"""

_FITS = "bool_and(cast(l_orderkey as hugeint) * case when l_linenumber = 1 then 9000000000000000000 else 2 end <= 9223372036854775807)"

SQL = {
    "plan_overflow": """
        select l_orderkey, l_linenumber, case when l_linenumber = 1 then 9000000000000000000 else 2 end as large,
               case when l_returnflag = 'A' then 'A' else '7' end as flag, (l_orderkey + l_linenumber) * 2 as doubled
        from lineitem""",
    "plan_overflow_log": f"""
        select 'lines' as run_id, cast(v.step_no as bigint) as step_no, v.op, v.success
        from (values (1, 'multiply_cols', (select {_FITS} from lineitem)), (2, 'sum_cols', true), (3, 'multiply_value', true),
                     (4, 'subtract_value', (select not bool_or(l_linenumber = 1) from lineitem)),
                     (5, 'convert_column_to_int', (select not bool_or(l_returnflag = 'A') from lineitem)),
                     (6, 'rename_column', true)) v(step_no, op, success)""",
    "plan_lineage_of_kept": """
        select 'lines' as run_id, 'flag' as original, 'returned' as "current"
        union all
        select 'lines', 'line', 'number' from (select bool_or(l_returnflag = 'A') as bad from lineitem) where not bad""",
    "plan_orders": """
        select o_orderkey + 1 as key_text, cast(case o_orderstatus when 'O' then 0 when 'F' then 1 end as bigint)
                 as status_code,
               replace(o_orderpriority, '-', ' ') as o_orderpriority,
               cast(cast(o_orderdate as date) as timestamp) as day,
               case when o_orderstatus = 'P' then 0 else o_totalprice end as price,
               o_orderstatus = 'P' as imputed_price,
               round(case when o_orderstatus = 'P' then 0 else o_totalprice end / greatest(o_orderkey + 1, 1), 6)
                 as price_per_key
        from orders""",
    "plan_orders_log": """
        select 'orders' as run_id, cast(v.step_no as bigint) as step_no, v.op, v.op_type, v."column", v.success,
               case when v.step_no = 5 then (select count(*) from orders where o_orderdate is null) end as n_coerced
        from (values
          (1, 'rename_column', 'create_col', 'o_orderstatus', true),
          (2, 'replace_substring', 'transform_col', 'o_orderpriority', true),
          (3, 'drop_column', 'drop_col', 'no_such_column', false),
          (4, 'convert_column_to_int', 'transform_col', 'day', (select count(o_orderdate) = 0 from orders)),
          (5, 'convert_column_to_datetime', 'transform_col', 'day', true),
          (6, 'convert_column_to_int', 'transform_col', 'key_text', true),
          (7, 'sum_value', 'transform_col', 'key_text', true),
          (8, 'fill_col_na', 'transform_col', 'price', true),
          (9, 'sum_value', 'transform_col', 'imputed_price', false),
          (10, 'divide_cols', 'create_col', 'price_per_key', true),
          (11, 'map_col_values', 'transform_col', 'status', true),
          (12, 'rename_column', 'create_col', 'status', true),
          (13, 'get_n_cols', 'query', null, true)) v(step_no, op, op_type, "column", success)""",
    "plan_orders_lineage": """
        select distinct 'orders' as run_id, 'o_orderstatus' as original, 'status_code' as "current" from orders""",
    "log_calls_per_op": f"select op, count(*) as n_calls from ({CALL_LOG}) group by op",
    "log_appended": f"select op, 2 * count(*) as n_calls from ({CALL_LOG}) group by op",
    "log_totals": f"select count(*) as n_calls, count(distinct op) as n_ops from ({CALL_LOG})",
    "log_success_rates": f"""
        select op, count(*) as n_calls, count(*) filter (where success) as n_success,
               round(avg(cast(success as int)), 6) as success_rate,
               round(count(*) filter (where success) / count(*) * 100, 2) as success_pct
        from ({CALL_LOG}) group by op""",
    "log_history_by_op": f"select op, run_id, step_no, args, success from ({CALL_LOG})",
    "log_history_by_column": f"""
        select "column", run_id, step_no, op, args from ({CALL_LOG})
        where success and op not in ('has_nulls', 'dummy_tool')""",
    "log_tool_ids": _FLAT,
    "log_unmatched_ops": f"select op, count(*) as n_calls from ({_FLAT}) where tool_id is null group by op",
}
assert set(CALLS.values()) - {n for _, n, *_ in TOOL_IDS} == {"dummy_tool"}
