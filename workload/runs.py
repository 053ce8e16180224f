"""Analysis of recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import results as R
from tidemark.operators.contracts import TableContract, check_contract
from tidemark.session import stored
from workload.tables import (
    CALLS_BY_RUN,
    EVAL_RUNS,
    EVALUATION,
    PAIRS,
    TRANSFORM_RUNS,
    TRANSFORMATION,
    USAGE,
    evaluation_results,
    on,
    round6,
    transformation_results,
    usage_log,
)


def _pairs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return R.pair_stages(
        R.run_accuracy(evaluation_results(orders)), R.run_accuracy(transformation_results(lineitem))
    )


def _usage(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return R.usage_by_run(_pairs(orders, lineitem), usage_log(lineitem))


@on("orders")
def run_accuracy(orders: DataFrame) -> DataFrame:
    return R.with_cost_per_accuracy(R.run_accuracy(evaluation_results(orders)))


@on("orders")
def run_check_columns(orders: DataFrame) -> DataFrame:
    """Every check column of the results with the number of runs that meet it."""
    results = evaluation_results(orders)
    names = R.check_columns(results)
    return results.agg(*[F.count_if(n).alias(n) for n in names]).unpivot([], names, "check", "n_met")


@on("orders")
def run_accuracy_interval(orders: DataFrame) -> DataFrame:
    runs = R.run_accuracy(evaluation_results(orders))
    return round6(R.central_interval(runs, "accuracy"), "mean", "low", "high")


@on("orders")
def run_cost_interval(orders: DataFrame) -> DataFrame:
    runs = R.run_accuracy(evaluation_results(orders))
    return round6(R.central_interval(runs, "total_cost"), "mean", "low", "high")


@on("lineitem")
def run_cost_per_acc_interval(lineitem: DataFrame) -> DataFrame:
    runs = stored(R.with_cost_per_accuracy(R.run_accuracy(transformation_results(lineitem))), "runs")
    return round6(R.central_interval(runs, "cost_per_acc"), "mean", "low", "high")


@on("events")
def interval_per_user(events: DataFrame) -> DataFrame:
    """Many groups, by the way taken when they are too many to broadcast."""
    return round6(R.central_interval(events, "value", by=["user_id"], few_groups=False), "mean", "low", "high")


@on("orders", "lineitem")
def run_pairs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return _pairs(orders, lineitem)


@on("orders", "lineitem")
def run_moments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    moments = R.by_moment(_pairs(orders, lineitem), "accuracy_eval", "accuracy_transform", "accuracy")
    return round6(R.moment_means(moments, "accuracy"), "mean", "ci_low", "ci_high")


@on("orders", "lineitem")
def run_moments_long(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return R.by_moment(_pairs(orders, lineitem), "total_cost_eval", "total_cost_transform", "total_cost")


@on("orders", "lineitem")
def run_configs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return R.configurations(_pairs(orders, lineitem))


@on("lineitem")
def tool_calls_by_run(lineitem: DataFrame) -> DataFrame:
    return R.calls_by_run(usage_log(lineitem))


@on("orders", "lineitem")
def tool_success_by_run(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return round6(_usage(orders, lineitem), "success_rate")


@on("orders", "lineitem")
def tool_success_box(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    usage = stored(_usage(orders, lineitem), "usage")  # read twice below
    return round6(R.box_summary(usage), "minimum", "q1", "median", "q3", "maximum")


@on("orders", "lineitem")
def tool_count_regression(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    fit = R.linear_fit(_usage(orders, lineitem), "n_calls", "accuracy_transform")
    return round6(fit, "slope", "intercept", "correlation")


@on("orders", "lineitem")
def tool_rate_regression(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    fit = R.linear_fit(_usage(orders, lineitem), "accuracy_transform", "success_rate")
    return round6(fit, "slope", "intercept", "correlation")


@on("orders", "lineitem")
def runs_combined(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Two stages' results in one table; each lacks the other's checks."""
    both = R.combine_runs(
        {"first": evaluation_results(orders).drop("dataset"), "second": transformation_results(lineitem).drop("dataset")}
    )
    return R.run_accuracy(both).drop("avg_acc")


@on("lineitem", "orders")
def runs_with_metrics(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Checks of a run next to its cost from another table."""
    checks = transformation_results(lineitem).drop("total_cost")
    metrics = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("total_cost"))
    return R.attach_metrics(checks, metrics)


@on("lineitem")
def runs_of_contracts(lineitem: DataFrame) -> DataFrame:
    """Contract checks of a table recorded as two runs, and the share each meets."""
    loose = TableContract(no_nulls=("l_tax",), ranges={"l_quantity": (1, 50), "l_discount": (0, 1)})
    tight = TableContract(cardinality={"l_returnflag": 2}, ranges={"l_quantity": (1, 50), "l_discount": (0, 0.05)})
    records = {
        name: R.run_record(check_contract(lineitem, contract), run, name, {"total_cost": 0.25 * run})
        for run, (name, contract) in enumerate({"loose": loose, "tight": tight}.items(), 1)
    }
    return round6(R.run_accuracy(R.combine_runs(records)), "accuracy")


@on("lineitem")
def repeated_runs(lineitem: DataFrame) -> DataFrame:
    return R.repeated_runs(lineitem, ["l_orderkey", "l_linenumber"])


QUERIES = {
    "run_accuracy": run_accuracy,
    "run_check_columns": run_check_columns,
    "run_accuracy_interval": run_accuracy_interval,
    "run_cost_interval": run_cost_interval,
    "run_cost_per_acc_interval": run_cost_per_acc_interval,
    "interval_per_user": interval_per_user,
    "run_pairs": run_pairs,
    "run_moments": run_moments,
    "run_moments_long": run_moments_long,
    "run_configs": run_configs,
    "tool_calls_by_run": tool_calls_by_run,
    "tool_success_by_run": tool_success_by_run,
    "tool_success_box": tool_success_box,
    "tool_count_regression": tool_count_regression,
    "tool_rate_regression": tool_rate_regression,
    "runs_combined": runs_combined,
    "runs_with_metrics": runs_with_metrics,
    "runs_of_contracts": runs_of_contracts,
    "repeated_runs": repeated_runs,
}


def _interval_sql(source: str, measure: str, by: str = "model, dataset") -> str:
    return f"""
        select {by}, count({measure}) as n, round(avg({measure}), 6) as mean,
               round(quantile_cont({measure}, 0.25), 6) as low, round(quantile_cont({measure}, 0.75), 6) as high
        from ({source}) group by {by}"""


def _moments(measure: str) -> str:
    return f"""
        select dataset, config_name, 'evaluation' as moment, {measure}_eval as {measure} from ({PAIRS})
        union all
        select dataset, config_name, 'transformation', {measure}_transform from ({PAIRS})"""


def _fit_sql(x: str, y: str) -> str:
    # The fit of a constant is NULL in standard SQL; DuckDB would give NaN.
    varies = f"var_pop({x}) > 0"
    return f"""
        select dataset, model_transform, count(*) as n,
               case when {varies} then round(regr_slope({y}, {x}), 6) end as slope,
               case when {varies} then round(regr_intercept({y}, {x}), 6) end as intercept,
               case when {varies} and var_pop({y}) > 0 then round(corr({x}, {y}), 6) end as correlation
        from ({USAGE}) group by dataset, model_transform"""


_COST_PER_ACC = "case when accuracy > 0 then total_cost / accuracy end as cost_per_acc"
_QUARTERS = [("minimum", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1)]

SQL = {
    "run_accuracy": f"""
        select accuracy, model, dataset, total_cost, run_id, round(accuracy, 2) as avg_acc, {_COST_PER_ACC}
        from ({EVAL_RUNS})""",
    "run_check_columns": " union all ".join(
        f"""select '{c}' as "check", count(*) filter (where {c}) as n_met from ({EVALUATION})"""
        for c in ("total_is_high", "total_is_bounded", "date_is_recent", "status_is_known")
    ),
    "run_accuracy_interval": _interval_sql(EVAL_RUNS, "accuracy"),
    "run_cost_interval": _interval_sql(EVAL_RUNS, "total_cost"),
    "run_cost_per_acc_interval": _interval_sql(
        f"select model, dataset, {_COST_PER_ACC} from ({TRANSFORM_RUNS})", "cost_per_acc"
    ),
    "interval_per_user": _interval_sql("select * from events", "value", "user_id"),
    "run_pairs": PAIRS,
    "run_moments": f"""
        select dataset, moment, config_name, n, round(mean, 6) as mean, round(mean - half, 6) as ci_low,
               round(mean + half, 6) as ci_high
        from (select dataset, moment, config_name, count(accuracy) as n, avg(accuracy) as mean,
                     coalesce(1.96 * stddev_samp(accuracy) / sqrt(count(accuracy)), 0) as half
              from ({_moments("accuracy")}) group by all)""",
    "run_moments_long": _moments("total_cost"),
    "run_configs": f"select distinct config_name from ({PAIRS})",
    "tool_calls_by_run": CALLS_BY_RUN,
    "tool_success_by_run": f"select * replace (round(success_rate, 6) as success_rate) from ({USAGE})",
    "tool_success_box": "select model_transform, dataset, count(*) as n, "
    + ", ".join(f"round(quantile_cont(success_rate, {q}), 6) as {n}" for n, q in _QUARTERS)
    + f" from ({USAGE}) group by model_transform, dataset",
    "tool_count_regression": _fit_sql("n_calls", "accuracy_transform"),
    "tool_rate_regression": _fit_sql("accuracy_transform", "success_rate"),
    "runs_combined": f"""
        select accuracy, model, 'first' as dataset, total_cost, run_id from ({EVAL_RUNS})
        union all
        select accuracy, model, 'second', total_cost, run_id from ({TRANSFORM_RUNS})""",
    "runs_with_metrics": f"""
        select t.run_id, quantity_is_bounded, nothing_returned, discount_is_low, tax_is_paid, model,
               t.dataset, o_totalprice as total_cost
        from ({TRANSFORMATION}) t join orders on o_orderkey = run_id""",
    "runs_of_contracts": """
        select round(accuracy, 6) as accuracy, model, model as dataset, total_cost, run_id,
               round(accuracy, 2) as avg_acc
        from (select (cast(count(*) = count(l_tax) as int) + cast(bool_and(l_quantity between 1 and 50) as int)
                      + cast(bool_and(l_discount between 0 and 1) as int)) / 3 as accuracy,
                     'loose' as model, 0.25::double as total_cost, 1::bigint as run_id from lineitem
              union all
              select (cast(count(distinct l_returnflag) = 2 as int) + cast(bool_and(l_quantity between 1 and 50) as int)
                      + cast(bool_and(l_discount between 0 and 0.05) as int)) / 3, 'tight', 0.5, 2 from lineitem)""",
    "repeated_runs": """
        select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1""",
}
