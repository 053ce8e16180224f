"""Affixes, outliers, votes on layouts, bootstrap weights, merged profiles, checked files, recorded logs, whiskers."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import convert
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import bootstrap as B, evidence as E, findings as G, layouts as D, profile as P, quality as Q, results as R, states as S, transforms as T
from tidemark.plans import log as L
from tidemark.plans.runner import LOG_SCHEMA
from tidemark.sources import files as X


def test_json_numbers(spark):
    kinds = {"2.0": "float", "1e3": "float", "-0": "int", "12345678901234567890": "int", "1E400": "float", " 7\n": "int", "01": "str", "+1": "str",
             "null": None, "true": "bool", "[1]": "list", '{"a": 2.0}': "dict", '"2.0"': "str", "": "str", "2.": "str"}
    df = spark.createDataFrame([(k,) for k in kinds] + [(None,)], "v string")
    expected = {}
    for kind in kinds.values():
        if kind:
            expected[kind] = expected.get(kind, 0) + 1
    assert {r.value_type: r.n for r in Q.value_types(df, "v", read="json").collect()} == expected


def test_long_cells_are_tested_whole(spark):
    """Long cells are tested by their core, whatever its length, once for each distinct value."""
    pad = " " * 100
    cells = {
        f"'20/01/2023'{pad}": (1, 0),
        f"{pad}R$ 12,50{pad}": (0, 1),
        "7" * 500: (0, 1),
        "7" * 500 + "x" * 13: (0, 0),
        "'" * 90 + "2'0'/'01/2023": (1, 0),
        "In 2020 it was so " * 20: (0, 0),
        "12 " + "kg" * 50: (0, 0),
        "20/01/2023": (1, 0),
        "5 kg": (0, 1),
        "-" * 70: (0, 0),
    }
    df = spark.createDataFrame([(c,) for c in cells for _ in range(2)] + [(None,)], "v string")
    found = G.column_features(df).first()
    assert (found.n_rows, found.n_nulls, found.n_unique) == (2 * len(cells) + 1, 1, len(cells))
    assert (found.n_dates, found.n_affixed) == tuple(2 * sum(x) for x in zip(*cells.values()))


def test_guards_are_necessary(spark):
    """No text that a test holds for is kept from it."""
    parts = ["R$", "EUR ", "US$ ", "'", '"', " ", "1", "12,5", "+", "-", "%", " kg", "/01/", "2023", ".", ":", "T", "é", "\t"]
    texts = set()
    for k in range(4000):
        h = hashlib.sha256(str(k).encode()).digest()
        texts.add("".join(parts[x % len(parts)] for x in h[1 : 2 + h[0] % 6]))
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", G.plain(F.col("v")).alias("core"))
    hidden = df.where(
        (F.col("core").rlike(G.AFFIXED_NUMBER) & ~F.col("v").rlike(G.MAY_BE_AFFIXED))
        | (convert.fits_date(F.col("core")) & ~F.col("v").rlike(convert.layout_signs(convert.DATE_FORMATS)))
    )
    assert hidden.collect() == []
    assert df.where(F.col("core").rlike(G.AFFIXED_NUMBER)).count() > 100


def test_quantile_rounds_do_not_multiply_rows(spark):
    """Many ranks, several rounds, clustered values and far outliers: exact, each value counted once in a round."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(1e6, 1e-3, 3000), [1e300, -1e300, 0.0, -0.0], np.full(500, 7.0)])
    df = spark.createDataFrame([(int(k % 3), float(v)) for k, v in enumerate(values)], "g int, v double")
    asked = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for few in (True, False):
        for r in exact_quantiles(df, ["g"], F.col("v"), asked, few_groups=few, kept=20).collect():
            own = values[r.g :: 3]
            assert r.n == len(own) and np.allclose(r.quantiles, np.quantile(own, asked), rtol=1e-12)
    one = exact_quantiles(df, [], F.col("v"), asked, kept=20).first()
    assert np.allclose(one.quantiles, np.quantile(values, asked), rtol=1e-12)


def test_evidence(spark):
    data = [(f"R$ {k},50", "7 kg" if k % 20 else "none", float(k if k != 3 else 10_000), "20/01/2023", k) for k in range(40)]
    df = spark.createDataFrame(data, "amount string, weight string, price double, day string, id int")
    found = {r.column: r for r in E.column_evidence(df).collect()}
    assert (found["amount"].before, found["amount"].after, found["amount"].n_affix) == ("R$ ", "", 40)
    assert (found["weight"].before, found["weight"].after, found["weight"].n_affix, found["weight"].n_valid) == ("", " kg", 38, 40)
    assert found["price"].n_outliers == 1 and found["day"].n_affix == 0 and found["id"].n_duplicates == 0
    report = {r.column: r for r in E.with_evidence(G.readiness_findings(df), E.column_evidence(df)).collect()}
    actions = {c: [a.action_type for a in r.suggested_actions] for c, r in report.items()}
    assert actions["amount"] == ["replace_substring", "convert_dtype"] and actions["price"] == ["modify_numeric_col"] and actions["id"] == ["drop_column"]
    assert report["price"].severity == "low" and report["weight"].severity == "high"
    assert E.column_evidence(df.limit(0)).count() == 5
    assert rows(E.text_counts(df, "weight")) == [("", " kg", 38)]


def test_votes(spark):
    df = spark.createDataFrame([("09/16/2021", "16/09/2021"), ("09/09/2021", "x"), ("1/2/2021", None), (None, None)], "us string, eu string")
    assert rows(D.layout_votes(df, ["us", "eu"]), "column") == [
        ("eu", 2, 1, 0, 0, 1, "day_first"),
        ("us", 3, 2, 3, 1, 0, "month_first"),
    ]
    parsed = T.convert_column_to_datetime(df, "us", formats=D.voted_formats(df, "us"))
    assert [str(r.us)[:10] for r in parsed.collect()] == ["2021-09-16", "2021-09-09", "2021-01-02", "None"]


def poisson(key, replicate, seed=0):
    number = int(hashlib.md5(f"{seed}:{key}:{replicate // 4}".encode()).hexdigest()[8 * (replicate % 4) :][:8], 16)
    return next((k for k, b in enumerate(B.BOUNDS) if number < b), B.MOST)


def test_bootstrap(spark):
    data = [("a" if k % 2 else None, k, float(k * k % 17)) for k in range(60)] + [("b", 99, None)]
    df = spark.createDataFrame(data, "g string, k long, x double").repartition(5)
    found = {r.g: r for r in B.bootstrap_means(df, ["g"], "x", ["k"], replicates=30, width=0.8).collect()}
    assert set(found) == {"a", None}
    for g, r in found.items():
        own = [(k, x) for group, k, x in data if group == g and x is not None]
        w = np.array([[poisson(k, j) for j in range(30)] for k, _ in own])
        means = (w * np.array([[x] for _, x in own])).sum(axis=0) / w.sum(axis=0)
        assert np.allclose([r.mean_low, r.mean_high], np.quantile(means, [0.1, 0.9]))
    draws = np.array([poisson(k, j) for k in range(300) for j in range(40)])
    assert abs(draws.mean() - 1) < 0.03 and abs(draws.var() - 1) < 0.06
    fits = B.bootstrap_fits(df.withColumn("y", F.col("x") * 3 + 1), "x", "y", ["g"], ["k"], replicates=10).where("g = 'a'").first()
    assert np.allclose([fits.slope_low, fits.slope_high, fits.intercept_low, fits.intercept_high], [3, 3, 1, 1])


def test_merged_states(spark):
    df = spark.createDataFrame([(k, None if k % 5 else f"t{k % 7}", float("nan") if k == 3 else k / 2) for k in range(500)], "a int, b string, c double")
    parts = [S.profile_state(df.where(f"a % 3 = {k}")) for k in range(3)] + [S.profile_state(df.limit(0))]
    merged, whole = (rows(S.state_profile(x), "position") for x in (S.merge_states(*parts), S.profile_state(df)))
    assert merged == whole
    assert [r[5] for r in merged] == pytest.approx([r.n_unique for r in P.profile(df).orderBy("position").collect()], rel=0.03)
    lacking = {r.column: r for r in S.state_profile(S.merge_states(parts[0], S.profile_state(df.where("a % 3 = 1").drop("b")))).collect()}
    assert lacking["b"].n_rows == lacking["a"].n_rows and lacking["b"].n_nulls >= df.where("a % 3 = 1").count()
    with pytest.raises(Exception, match="several types"):
        S.merge_states(parts[0], S.profile_state(df.select(F.col("a").cast("string").alias("a")))).collect()


def test_recorded_log(spark, tmp_path):
    def log(run, n):
        return spark.createDataFrame([(run, k, "has_nulls", "query", None, None, True, None, None) for k in range(n)], LOG_SCHEMA)

    path = str(tmp_path / "log")
    for run, n in (("1", 3), ("02", 2), ("1", 3), ("02", 1)):
        L.record_log(log(run, n), path)
    assert rows(L.read_log(spark, path).groupBy("run_id").count()) == [("02", 1), ("1", 3)]


def test_checked_csv(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text('a,b,c\n1,x,2.5\n2,"y,z",3\n3,x,4,surplus\n4,x\nfive,x,5\n,,\n')
    good, rejected = X.read_csv_checked(spark, str(path), "a int, b string, c double", on_bad="quarantine")
    assert rows(good) == [(1, "x", 2.5), (2, "y,z", 3.0), (None, None, None)]
    assert rows(rejected) == [("3,x,4,surplus",), ("4,x",), ("five,x,5",)]
    assert rows(X.rejection_counts(rejected, "a int, b string, c double")) == [("missing cells", 1), ("other type", 1), ("surplus cells", 1)]
    with pytest.raises(Exception, match="Malformed line"):
        X.read_csv_checked(spark, str(path), "a int, b string, c double")[0].collect()


def test_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 40.0, -30.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", None), ("i", 5.0)], "g string, v double")
    assert rows(R.box_whiskers(df, "v", ["g"]), "g") == [("g", 10, 2.25, 4.5, 6.75, 1.0, 8.0, 2), ("i", 1, 5.0, 5.0, 5.0, 5.0, 5.0, 0)]
    assert rows(R.box_fliers(df, "v", ["g"])) == [("g", -30.0, "low"), ("g", 40.0, "high")]


def test_last_run_is_kept(spark):
    runs = spark.createDataFrame([(1, "d", 0.5, 1.0, "m", 1), (1, "d", 0.9, 2.0, "m", 2)], "run_id int, dataset string, accuracy double, total_cost double, model string, at int")
    pairs = R.pair_stages(runs.where("at = 1"), runs, latest="at")
    assert [(r.accuracy_eval, r.accuracy_transform, r.config_name) for r in pairs.collect()] == [(0.5, 0.9, "m/m")]
    assert re.search("more than once", str(pytest.raises(Exception, lambda: R.pair_stages(runs, runs).collect()).value))
