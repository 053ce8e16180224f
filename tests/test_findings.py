import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import findings as G


def report(df, **kw):
    out = G.readiness_findings(df, **kw).orderBy("position").collect()
    return {r["column"]: (r["severity"], [a["action_type"] for a in r["suggested_actions"]]) for r in out}


def test_shop_report(shops):
    assert report(shops) == {
        "shop": ("no problem", []),
        "opened": ("medium", ["convert_dtype"]),
        "class": ("medium", ["encode_categorical"]),
        "area": ("medium", ["fill_missing_values"]),
        "sales": ("no problem", []),
        "tables": ("no problem", []),
        "special": ("medium", ["encode_categorical", "fill_missing_values"]),
    }


def test_texts_that_hold_numbers(spark):
    rows_ = [
        (i, f"{i % 7},{i % 100:02d}", f"{i},000 kms", f"{i}.5 Lakh", f"R$ {i}", 1990 + i % 30, f"title {i}", "p" if i % 2 else "q", f"{i % 4}-X")
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows_, "ID int, score string, driven string, price string, cost string, Year int, title string, gear string, code string"
    )
    assert report(df) == {
        "ID": ("low", ["drop_column"]),
        "score": ("high", ["convert_dtype"]),
        "driven": ("high", ["convert_dtype"]),
        "price": ("high", ["convert_dtype"]),
        "cost": ("high", ["convert_dtype"]),
        "Year": ("low", ["create_derived_col"]),
        "title": ("no problem", []),
        "gear": ("medium", ["encode_categorical"]),
        "code": ("medium", ["encode_categorical"]),
    }


def test_empty_table_and_empty_column(spark):
    df = spark.createDataFrame([(1, None)], "id int, t string")
    assert report(df.limit(0)) == {"id": ("no problem", []), "t": ("no problem", [])}
    assert report(df) == {"id": ("low", ["drop_column"]), "t": ("medium", ["fill_missing_values"])}


def test_status(spark, shops):
    features = G.column_features(shops)
    found = G.readiness_findings(shops, features=features)
    assert rows(G.readiness_status(found, features, "special")) == [("ready_with_issues", 4)]
    strict = G.ReportRules(unready_null_share=0.25)
    assert rows(G.readiness_status(found, features, "special", strict)) == [("not_ready", 4)]
    fine = spark.range(3).selectExpr("id as n")
    assert rows(G.readiness_status(G.readiness_findings(fine))) == [("ready", 0)]
    bad = found.withColumn("severity", F.lit("very high"))
    assert rows(G.readiness_status(bad)) == [("not_ready", 7)]
    with pytest.raises(ValueError):
        G.readiness_status(found, target="special")


@pytest.fixture(scope="module")
def findings(spark):
    data = [
        (0, "area", "medium", [("Gaps", "fill_missing_values")]),
        (1, "class", "low", [("Few", "encode_categorical"), ("Odd", "replace_substring")]),
        (2, "class", "high", [("Texts", "convert_dtype")]),  # a second finding on the column
        (3, "sales", "no problem", []),
    ]
    return spark.createDataFrame(data, G.FINDINGS_SCHEMA)


def test_expected_findings(findings):
    contract = G.FindingsContract(
        actions={"area": ["fill_missing_values", "drop_column"], "class": ["convert_dtype"], "gone": ["drop_column"]},
        severities={"area": "medium", "class": "low", "sales": "no problem", "gone": "low"},
    )
    wide = G.check_findings(findings, contract).first().asDict()
    assert wide == {
        "area_expected_action_has_fill_missing_values": True,
        "area_expected_action_has_drop_column": False,
        "class_expected_action_has_convert_dtype": True,
        "gone_expected_action_has_drop_column": False,
        "area_severity_is_medium": True,
        "class_severity_is_low": True,
        "sales_severity_is_no problem": True,
        "gone_severity_is_low": False,
    }
    assert {r["check"]: r["passed"] for r in G.check_findings_rows(findings, contract).collect()} == wide
    none = G.check_findings(findings.limit(0), contract).first().asDict()
    assert not any(none.values())


def test_text(findings):
    assert [r["text"] for r in G.finding_text(findings).orderBy("position").collect()] == [
        "[Medium] area: Gaps Suggested action: Fill_missing_values",
        "[Low] class: Few Suggested action: Encode_categorical. Odd Suggested action: Replace_substring",
        "[High] class: Texts Suggested action: Convert_dtype",
        "[No problem] sales",
    ]


def test_markdown(spark, findings):
    status = G.readiness_status(findings)
    text = G.report_markdown(findings, status, "Short.").first()["markdown"]
    assert text.split("\n")[:7] == [
        "### Status: Ready_With_Issues", "", "### Resumo: ", "Short.", "", "### Problemas encontrados:",
        "- [Medium] area: Gaps Suggested action: Fill_missing_values",
    ]
    assert text.split("\n")[-1] == "- [No problem] sales"


def test_vocabulary(spark, findings):
    assert G.check_vocabulary(findings).count() == 0
    odd = [(0, "a", "awful", []), (1, "b", "low", [("x", "guess")]), (2, "c", None, []), (3, "d", "low", [("x", None)])]
    assert G.check_vocabulary(spark.createDataFrame(odd, G.FINDINGS_SCHEMA)).count() == 4


@pytest.mark.parametrize("width", [20, 63, 64, 65, 80])
def test_cells_of_any_length_are_tested_as_they_stand(spark, width):
    rows = [(f"{1 + k % 28:02d}/{1 + k % 12:02d}/2021".ljust(width), f"{k},50".ljust(width)) for k in range(100)]
    features = {r["column"]: r for r in G.column_features(spark.createDataFrame(rows, "day string, price string")).collect()}
    assert (features["day"]["n_dates"], features["price"]["n_affixed"]) == (100, 100)
    found = {r["column"]: r for r in G.readiness_findings(spark.createDataFrame(rows, "day string, price string")).collect()}
    assert (found["day"]["severity"], found["price"]["severity"]) == ("medium", "high")
