"""The given tables, and the derived inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def on(*names: str) -> Callable:
    """Turn a function of DataFrames into a query on the named tables."""

    def bind(build: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(*[table(spark, sf_dir, n) for n in names])

        query.__name__ = build.__name__
        query.__doc__ = build.__doc__
        return query

    return bind


def round6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their labels; most have none, which gives missing cells."""
    return documents.join(labels, "doc_id", "left")


LABELLED = "select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)"


# A log of recorded calls: an order is a run, its lines are the calls.
CALLS = {
    "AF": "has_nulls",
    "AO": "fill_col_na",
    "NF": "rename_column",
    "NO": "convert_column_to_int",
    "RF": "drop_column",
    "RO": "dummy_tool",
}


def _op() -> Column:
    key = F.concat("l_returnflag", "l_linestatus")
    names = F.create_map(*[F.lit(x) for pair in CALLS.items() for x in pair])
    return F.try_element_at(names, key)


def call_log(lineitem: DataFrame) -> DataFrame:
    column = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.col("l_linenumber").cast("long").alias("step_no"),
        _op().alias("op"),
        column.alias("column"),
        F.create_map(
            F.lit("column"), column, F.lit("value"), F.col("l_quantity").cast("int").cast("string")
        ).alias("args"),
        (F.col("l_discount") > 0.02).alias("success"),
        F.lit(None).cast("string").alias("error"),
    )


_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in CALLS.items())
CALL_LOG = f"""
select cast(l_orderkey as varchar) as run_id, cast(l_linenumber as bigint) as step_no,
       case l_returnflag || l_linestatus {_CASES} end as op,
       'c' || l_linenumber as "column",
       '{{"column":"c' || l_linenumber || '","value":"' || cast(l_quantity as int) || '"}}' as args,
       l_discount > 0.02 as success
from lineitem"""


# Recorded runs: an order is a run in the first stage, its lines make the second, and each
# line is a call. The number of digits of the run's id names its dataset, so the datasets'
# sizes differ by powers of ten.
def _dataset(run_id: str) -> Column:
    return F.concat(F.lit("set-"), F.length(F.col(run_id).cast("string")).cast("string"))


def evaluation_results(orders: DataFrame) -> DataFrame:
    return orders.select(
        (F.col("o_totalprice") > 200000).alias("total_is_high"),
        (F.col("o_totalprice") < 400000).alias("total_is_bounded"),
        (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("date_is_recent"),
        F.col("o_orderstatus").isin("F", "O").alias("status_is_known"),
        (F.col("o_totalprice") / 1000000).alias("total_cost"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderkey").alias("run_id"),
        _dataset("o_orderkey").alias("dataset"),
    )


EVALUATION = """
select o_totalprice > 200000 as total_is_high, o_totalprice < 400000 as total_is_bounded,
       o_orderdate >= timestamp '1997-01-01' as date_is_recent, o_orderstatus in ('F', 'O') as status_is_known,
       o_totalprice / 1000000 as total_cost, o_orderpriority as model, o_orderkey as run_id,
       'set-' || length(cast(o_orderkey as varchar)) as dataset
from orders"""


def transformation_results(lineitem: DataFrame) -> DataFrame:
    checks = lineitem.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        (F.max("l_quantity") < 48).alias("quantity_is_bounded"),
        (~F.bool_or(F.col("l_returnflag") == "R")).alias("nothing_returned"),
        (F.max("l_discount") <= 0.08).alias("discount_is_low"),
        (F.min("l_tax") > 0.005).alias("tax_is_paid"),
        (F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("double") / 1000000).alias("total_cost"),
        F.concat(F.max("l_linestatus"), F.max("l_returnflag")).alias("model"),
    )
    return checks.withColumn("dataset", _dataset("run_id"))


TRANSFORMATION = """
select l_orderkey as run_id, max(l_quantity) < 48 as quantity_is_bounded,
       not bool_or(l_returnflag = 'R') as nothing_returned, max(l_discount) <= 0.08 as discount_is_low,
       min(l_tax) > 0.005 as tax_is_paid,
       cast(sum(cast(l_extendedprice as decimal(12, 2))) as double) / 1000000 as total_cost,
       max(l_linestatus) || max(l_returnflag) as model,
       'set-' || length(cast(l_orderkey as varchar)) as dataset
from lineitem group by l_orderkey"""


def usage_log(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        _dataset("l_orderkey").alias("dataset"),
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_discount") > 0.02).alias("success"),
    )


CALLS_BY_RUN = """
select 'set-' || length(cast(l_orderkey as varchar)) as dataset, l_orderkey as run_id, count(*) as n_calls,
       count(*) filter (where l_discount > 0.02) as n_success
from lineitem group by l_orderkey"""


def accuracy_sql(source: str, checks: Sequence[str]) -> str:
    met = " + ".join(f"cast({c} as int)" for c in checks)
    return f"""select ({met}) / {float(len(checks))} as accuracy, model, dataset, total_cost, run_id from ({source})"""


EVAL_CHECKS = ("total_is_high", "total_is_bounded", "date_is_recent", "status_is_known")
TRANSFORM_CHECKS = ("quantity_is_bounded", "nothing_returned", "discount_is_low", "tax_is_paid")
EVAL_RUNS = accuracy_sql(EVALUATION, EVAL_CHECKS)
TRANSFORM_RUNS = accuracy_sql(TRANSFORMATION, TRANSFORM_CHECKS)
PAIRS = f"""
select e.run_id, e.dataset, e.accuracy as accuracy_eval, e.total_cost as total_cost_eval, e.model as model_eval,
       t.accuracy as accuracy_transform, t.total_cost as total_cost_transform, t.model as model_transform,
       e.model || '/' || t.model as config_name
from ({EVAL_RUNS}) e join ({TRANSFORM_RUNS}) t on e.run_id = t.run_id and e.dataset = t.dataset"""
USAGE = f"""
select p.run_id, p.dataset, accuracy_transform, model_transform, config_name, n_calls, n_success,
       n_success / n_calls as success_rate
from ({PAIRS}) p join ({CALLS_BY_RUN}) u on p.run_id = u.run_id and p.dataset = u.dataset"""
