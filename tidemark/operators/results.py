"""Analysis of recorded runs: check columns, cost, tool calls.

A results table has one row per run: boolean check columns, `total_cost`, `model`, `run_id`
and, once tables are put together, `dataset`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.cells import cell
from tidemark.functions.joins import fits_broadcast, matches
from tidemark.functions.quantiles import exact_quantiles
from tidemark.session import stored

RUN_KEYS = ["run_id", "dataset"]
Z95 = 1.96


def check_columns(results: DataFrame) -> list[str]:
    return [f.name for f in results.schema.fields if isinstance(f.dataType, T.BooleanType)]


def combine_runs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Union of several results tables, each tagged with its dataset; absent columns are NULL."""
    parts = [df.withColumn("dataset", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def run_record(checks: DataFrame, run_id: int, model: str, metrics: Mapping[str, float] | None = None) -> DataFrame:
    """The one-row result of a contract check, tagged with its run, model and figures."""
    tags = {"run_id": F.lit(run_id).cast("long"), "model": F.lit(model)}
    return checks.withColumns({**{k: F.lit(v) for k, v in (metrics or {}).items()}, **tags})


def attach_metrics(checks: DataFrame, metrics: DataFrame, on: Sequence[str] = ("run_id",)) -> DataFrame:
    """Put the cost and token figures next to the checks of the same run."""
    return checks.join(metrics, list(on), "inner")


def repeated_runs(results: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Run keys that occur more than once and would multiply rows in a join."""
    return results.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def run_accuracy(results: DataFrame, checks: Sequence[str] | None = None) -> DataFrame:
    """Per run the share of checks met. A check that a run lacks (NULL) does not count."""
    names = list(checks) if checks is not None else check_columns(results)
    met = sum((F.coalesce(cell(c).cast("int"), F.lit(0)) for c in names), F.lit(0))
    asked = sum((cell(c).isNotNull().cast("int") for c in names), F.lit(0))
    return results.select(
        F.try_divide(met.cast("double"), asked.cast("double")).alias("accuracy"),
        "model",
        "dataset",
        "total_cost",
        "run_id",
    ).withColumn("avg_acc", F.round("accuracy", 2))


def with_cost_per_accuracy(runs: DataFrame) -> DataFrame:
    """Cost over the accuracy as it is, not over its rounded display value `avg_acc`."""
    return runs.withColumn("cost_per_acc", F.try_divide(F.col("total_cost"), F.col("accuracy")))


def central_interval(
    runs: DataFrame,
    measure: str,
    by: Sequence[str] = ("model", "dataset"),
    width: float = 0.5,
    few_groups: bool | None = None,
) -> DataFrame:
    """`by…, n, mean, low, high`: the mean and the central percentile interval per group."""
    edges = [0.5 - width / 2, 0.5 + width / 2]
    spans = exact_quantiles(runs, by, cell(measure), edges, few_groups=few_groups, also={"mean": F.avg})
    low, high = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    return spans.select(*[cell(b) for b in by], "n", "mean", low.alias("low"), high.alias("high"))


def pair_stages(evaluation: DataFrame, transformation: DataFrame, latest: str | None = None) -> DataFrame:
    """The two stages of each run side by side, with `config_name = eval/transform`.

    A run that a stage holds twice would multiply rows. It fails the query, and `repeated_runs` lists such
    runs; or `latest` names a column in whose order the last of them is kept. Either rides on the
    shuffle that the join needs.
    """
    columns = ["accuracy", "total_cost", "model"]

    def stage(runs: DataFrame, suffix: str) -> DataFrame:
        known = runs.where(F.col("run_id").isNotNull() & F.col("dataset").isNotNull())
        if latest is not None:
            last = known.groupBy(*RUN_KEYS).agg(F.max_by(F.struct(*columns), cell(latest)).alias("run"))
            return last.select(*RUN_KEYS, *[F.col(f"run.{c}").alias(f"{c}_{suffix}") for c in columns])
        one = known.groupBy(*RUN_KEYS).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*columns)).alias("run"))
        message = F.concat(F.lit("A run occurs more than once: "), F.col("run_id").cast("string"))
        run = F.when(F.col("n") > 1, F.raise_error(message).cast(one.schema["run"].dataType)).otherwise(F.col("run"))
        return one.select(*RUN_KEYS, run.alias("run")).select(*RUN_KEYS, *[F.col(f"run.{c}").alias(f"{c}_{suffix}") for c in columns])

    pairs = stage(evaluation, "eval").join(stage(transformation, "transform"), RUN_KEYS, "inner")
    return pairs.withColumn("config_name", F.concat_ws("/", "model_eval", "model_transform"))


def by_moment(pairs: DataFrame, before: str, after: str, value_name: str) -> DataFrame:
    """Two rows per run, `dataset, config_name, moment, value`."""
    wide = pairs.select(
        "dataset", "config_name", F.col(before).alias("evaluation"), F.col(after).alias("transformation")
    )
    return wide.unpivot(["dataset", "config_name"], ["evaluation", "transformation"], "moment", value_name)


def moment_means(moments: DataFrame, value_name: str) -> DataFrame:
    """Mean per dataset, moment and configuration with a normal 95% confidence interval."""
    stats = moments.groupBy("dataset", "moment", "config_name").agg(
        F.count(value_name).alias("n"), F.avg(value_name).alias("mean"), F.stddev(value_name).alias("sd")
    )
    half = F.coalesce(F.lit(Z95) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return stats.select(
        "dataset", "moment", "config_name", "n", "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high")
    )


def configurations(pairs: DataFrame) -> DataFrame:
    return pairs.select("config_name").distinct().orderBy("config_name")


def calls_by_run(log: DataFrame) -> DataFrame:
    """`dataset, run_id, n_calls, n_success`."""
    return log.groupBy("dataset", "run_id").agg(
        F.count("*").alias("n_calls"), F.count_if("success").alias("n_success")
    )


def usage_by_run(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Each run with its tool calls and their success rate.

    The log is counted per run before the join, so a run with very many calls is one row.
    """
    columns = ["run_id", "dataset", "accuracy_transform", "model_transform", "config_name"]
    joined = pairs.select(*columns).join(calls_by_run(log), RUN_KEYS, "inner")
    return joined.withColumn("success_rate", F.try_divide(F.col("n_success").cast("double"), F.col("n_calls").cast("double")))


def box_summary(
    usage: DataFrame,
    measure: str = "success_rate",
    by: Sequence[str] = ("model_transform", "dataset"),
    few_groups: bool | None = None,
) -> DataFrame:
    """`by…, n, minimum, q1, median, q3, maximum` per group."""
    ends = {"minimum": F.min, "maximum": F.max}
    summary = exact_quantiles(usage, by, cell(measure), [0.25, 0.5, 0.75], few_groups=few_groups, also=ends)
    inner = [F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return summary.select(*by, "n", "minimum", *inner, "maximum")


WHISKER = 1.5


def _with_fences(usage: DataFrame, measure: str, by: Sequence[str], few_groups: bool | None) -> tuple[DataFrame, DataFrame]:
    """The boxes, and each known value beside its group's quartiles and fences."""
    boxes = box_summary(usage, measure, by, few_groups).withColumn("iqr", F.col("q3") - F.col("q1"))
    boxes = boxes.withColumns({"low_fence": F.col("q1") - WHISKER * F.col("iqr"), "high_fence": F.col("q3") + WHISKER * F.col("iqr")})
    boxes = stored(boxes, "boxes")
    renamed = boxes.select(*[cell(b).alias(f"__{b}") for b in by], "low_fence", "high_fence")
    values = usage.where(cell(measure).isNotNull()).select(*[cell(b) for b in by], cell(measure).cast("double").alias("value"))
    small = fits_broadcast(renamed) if few_groups is None else few_groups
    on = matches([(cell(b), cell(f"__{b}")) for b in by])
    return boxes, values.join(F.broadcast(renamed) if small else renamed, on).drop(*[f"__{b}" for b in by])


def box_whiskers(
    usage: DataFrame,
    measure: str = "success_rate",
    by: Sequence[str] = ("model_transform", "dataset"),
    few_groups: bool | None = None,
) -> DataFrame:
    """`by…, n, q1, median, q3, low_whisker, high_whisker, n_fliers`: whiskers end at the last values within the fences."""
    boxes, values = _with_fences(usage, measure, by, few_groups)
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    ends = values.groupBy(*by).agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.count_if(~inside).alias("n_fliers"),
    )
    ends = ends.withColumnsRenamed({b: f"__{b}" for b in by})
    joined = boxes.join(ends, matches([(cell(b), cell(f"__{b}")) for b in by]))
    return joined.select(*[cell(b) for b in by], "n", "q1", "median", "q3", "low_whisker", "high_whisker", "n_fliers")


def box_fliers(
    usage: DataFrame,
    measure: str = "success_rate",
    by: Sequence[str] = ("model_transform", "dataset"),
    few_groups: bool | None = None,
) -> DataFrame:
    """`by…, value, side`: the values beyond the fences, a row each."""
    _, values = _with_fences(usage, measure, by, few_groups)
    side = F.when(F.col("value") < F.col("low_fence"), "low").when(F.col("value") > F.col("high_fence"), "high")
    return values.select(*[cell(b) for b in by], "value", side.alias("side")).where(F.col("side").isNotNull())


def linear_fit(
    usage: DataFrame, x: str, y: str, by: Sequence[str] = ("dataset", "model_transform")
) -> DataFrame:
    """`by…, n, slope, intercept, correlation` of `y` on `x` per group."""
    both = cell(x).isNotNull() & cell(y).isNotNull()

    def paired(name: str) -> Column:
        return F.when(both, cell(name)).cast("double")

    return usage.groupBy(*by).agg(
        F.count_if(both).alias("n"),
        F.regr_slope(paired(y), paired(x)).alias("slope"),
        F.regr_intercept(paired(y), paired(x)).alias("intercept"),
        # NULL, not an error, where one side never varies.
        F.try_divide(
            F.covar_pop(paired(x), paired(y)), F.stddev_pop(paired(x)) * F.stddev_pop(paired(y))
        ).alias("correlation"),
    )
