import numpy as np
import pandas as pd
import pytest
from conftest import rows

from tidemark.operators import results as R


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(3)

    def stage(n_checks, models):
        frame = pd.DataFrame({f"check_{i}": rng.random(60) < 0.7 for i in range(n_checks)})
        frame["tokens"] = rng.integers(1, 1000, 60)
        frame["total_cost"] = rng.gamma(2, 0.01, 60)
        frame["model"] = rng.choice(models, 60)
        frame["run_id"] = list(range(60))
        return frame

    calls = pd.DataFrame({"run_id": rng.integers(0, 55, 900), "success": rng.random(900) < 0.9})
    return {"eval": stage(5, ["m1", "m2"]), "transform": stage(7, ["t1", "t2"]), "calls": calls}


@pytest.fixture(scope="module")
def tables(spark, frames):
    out = {k: spark.createDataFrame(v) for k, v in frames.items()}
    return {k: R.combine_runs({"d1": v.where("run_id < 40"), "d2": v.where("run_id >= 40")}) for k, v in out.items()}


@pytest.fixture(scope="module")
def merged(frames):
    parts = {}
    for k in ("eval", "transform"):
        f = frames[k]
        checks = f.select_dtypes("boolean")
        parts[k] = f[["total_cost", "model", "run_id"]].assign(accuracy=checks.mean(axis=1))
    out = parts["eval"].merge(parts["transform"], on="run_id", suffixes=("_eval", "_transform"))
    out["dataset"] = np.where(out.run_id < 40, "d1", "d2")
    out["config_name"] = out.model_eval + "/" + out.model_transform
    return out


def test_accuracy(tables, merged):
    out = R.with_cost_per_accuracy(R.run_accuracy(tables["eval"])).toPandas().sort_values("run_id")
    assert out.accuracy.tolist() == pytest.approx(merged.accuracy_eval.tolist())
    assert out.avg_acc.tolist() == pytest.approx(merged.accuracy_eval.round(2).tolist())
    per = merged.total_cost_eval / merged.accuracy_eval.replace(0, np.nan)
    assert out.cost_per_acc.fillna(-1).tolist() == pytest.approx(per.fillna(-1).tolist())
    assert R.check_columns(tables["eval"]) == [f"check_{i}" for i in range(5)]


def test_absent_checks_do_not_count(spark):
    a = spark.createDataFrame([(True, False, 1.0, "m", 1)], "x boolean, y boolean, total_cost double, model string, run_id int")
    b = spark.createDataFrame([(True, 1.0, "m", 1)], "z boolean, total_cost double, model string, run_id int")
    out = R.run_accuracy(R.combine_runs({"a": a, "b": b})).select("dataset", "accuracy")
    assert rows(out) == [("a", 0.5), ("b", 1.0)]


def test_interval(tables, merged):
    out = R.central_interval(R.run_accuracy(tables["eval"]), "total_cost").toPandas()
    for (model, dataset), part in merged.groupby(["model_eval", "dataset"]):
        got = out[(out.model == model) & (out.dataset == dataset)].iloc[0]
        low, high = np.quantile(part.total_cost_eval, [0.25, 0.75])
        assert (got.n, got["mean"], got.low, got.high) == pytest.approx(
            (len(part), part.total_cost_eval.mean(), low, high)
        )


@pytest.fixture(scope="module")
def pairs(tables):
    return R.pair_stages(R.run_accuracy(tables["eval"]), R.run_accuracy(tables["transform"]))


def test_pairs_and_configurations(pairs, merged):
    assert pairs.count() == 60
    assert [r[0] for r in R.configurations(pairs).collect()] == sorted(set(merged.config_name))


def test_moments(pairs, merged):
    long = R.by_moment(pairs, "accuracy_eval", "accuracy_transform", "accuracy")
    assert long.count() == 120
    out = R.moment_means(long, "accuracy").toPandas()
    part = merged[(merged.dataset == "d1") & (merged.config_name == "m1/t1")].accuracy_transform
    got = out[(out.dataset == "d1") & (out.config_name == "m1/t1") & (out.moment == "transformation")].iloc[0]
    half = 1.96 * part.std() / len(part) ** 0.5
    assert (got["mean"], got.ci_low, got.ci_high) == pytest.approx((part.mean(), part.mean() - half, part.mean() + half))


def test_usage(tables, pairs, merged, frames):
    usage = R.usage_by_run(pairs, tables["calls"])
    counts = frames["calls"].groupby("run_id").success.agg(["size", "sum"]).reset_index()
    expected = merged.merge(counts, on="run_id")
    out = usage.toPandas().sort_values("run_id")
    assert out.n_calls.tolist() == expected["size"].tolist()
    assert out.success_rate.tolist() == pytest.approx((expected["sum"] / expected["size"]).tolist())

    expected["rate"] = expected["sum"] / expected["size"]
    box = R.box_summary(usage).toPandas()
    for (model, dataset), part in expected.groupby(["model_transform", "dataset"]):
        got = box[(box.model_transform == model) & (box.dataset == dataset)].iloc[0]
        assert [got.minimum, got.q1, got["median"], got.q3, got.maximum] == pytest.approx(
            list(np.quantile(part.rate, [0, 0.25, 0.5, 0.75, 1]))
        )

    fit = R.linear_fit(usage, "n_calls", "accuracy_transform").toPandas()
    for (dataset, model), part in expected.groupby(["dataset", "model_transform"]):
        got = fit[(fit.dataset == dataset) & (fit.model_transform == model)].iloc[0]
        slope, intercept = np.polyfit(part["size"], part.accuracy_transform, 1)
        assert (got.slope, got.intercept) == pytest.approx((slope, intercept))
        assert got.correlation == pytest.approx(np.corrcoef(part["size"], part.accuracy_transform)[0, 1])


def test_fit_of_a_constant(spark):
    df = spark.createDataFrame([("d", "m", 1.0, 2.0), ("d", "m", 1.0, 3.0), ("d", "m", None, 9.0)], "dataset string, model_transform string, x double, y double")
    assert rows(R.linear_fit(df, "x", "y")) == [("d", "m", 2, None, None, None)]


def test_repeated_runs_and_metrics(spark, tables):
    runs = tables["eval"].select("run_id", "dataset")
    assert R.repeated_runs(runs).count() == 0
    assert rows(R.repeated_runs(runs.union(runs.where("run_id = 3")))) == [(3, "d1", 2)]
    costs = spark.createDataFrame([(1, 0.5)], "run_id long, cost double")
    assert rows(R.attach_metrics(runs, costs)) == [(1, "d1", 0.5)]


def test_repeated_runs_are_refused(spark):
    runs = spark.createDataFrame([(1, "d", 0.5, 1.0, "m"), (1, "d", 0.6, 1.0, "m")], "run_id int, dataset string, accuracy double, total_cost double, model string")
    with pytest.raises(Exception, match="more than once"):
        R.pair_stages(runs, runs.limit(1)).collect()
    assert R.pair_stages(runs.limit(1), runs.limit(1)).count() == 1
