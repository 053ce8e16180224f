"""Findings on a table's columns: the rule-based report, its checks and its text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import convert
from tidemark.operators.profile import TextTest, column_counts, column_dictionary
from tidemark.session import stored

# The vocabulary of findings.
STATUSES = ("ready", "ready_with_issues", "not_ready")
SEVERITIES = ("very high", "high", "medium", "low", "no problem")  # worst first
ACTIONS = (
    "fill_missing_values",
    "drop_column",
    "convert_dtype",
    "encode_categorical",
    "replace_substring",
    "modify_numeric_col",
    "create_derived_col",
)

FINDINGS_SCHEMA = (
    "position int, column string, severity string, "
    "suggested_actions array<struct<explanation:string, action_type:string>>"
)


@dataclass(frozen=True)
class ReportRules:
    """Thresholds of the readiness report."""

    key_names: str = r"(?i)^(id|unnamed: ?[0-9]+)$"
    year_names: str = r"(?i)^(year|ano)$"
    years: tuple[int, int] = (1900, 2100)
    parse_share: float = 0.95
    max_categories: int = 50
    max_category_share: float = 0.6
    unready_null_share: float = 0.5
    date_formats: tuple[str, ...] = convert.DATE_FORMATS


def check_vocabulary(findings: DataFrame) -> DataFrame:
    """Rows whose severity or an action lies outside the vocabulary."""
    known_action = F.forall("suggested_actions", lambda a: F.coalesce(a["action_type"].isin(*ACTIONS), F.lit(False)))
    return findings.where(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)) | ~known_action)


# A number, with a currency sign before it or a unit after it; comma or point decimals.
AFFIXED_NUMBER = r"^([A-Za-z]{0,3}\p{Sc})?\s*[+-]?[0-9][0-9.,]*\s*[\p{L}%]{0,12}$"


# What every such cell begins with, quotes anywhere: at most three letters before the sign or the first digit.
MAY_BE_AFFIXED = r"""^[\s'"]*(?:[A-Za-z]['"]*){0,3}[\p{Sc}\s'"+-]*[0-9]"""


def plain(value: Column) -> Column:
    """A text without quotes and outer blanks."""
    return F.trim(F.translate(value, "'\"", ""))


def column_features(df: DataFrame, rules: ReportRules = ReportRules()) -> DataFrame:
    """What the rules look at: profile counts and how many cells read as dates, numbers, years.

    Tests ride on the counts that the profile needs anyway; cells of any length are tested whole, once for each distinct value.
    """
    dates = convert.layout_signs(rules.date_formats)
    counts = column_counts(
        df,
        text={
            "n_dates": TextTest(lambda v: v.rlike(dates), plain, lambda v: convert.fits_date(v, rules.date_formats)),
            "n_affixed": TextTest(lambda v: v.rlike(MAY_BE_AFFIXED), plain, lambda v: v.rlike(AFFIXED_NUMBER)),
        },
        whole={"n_years": lambda v: v.between(*rules.years)},
    )
    figures = ["n_rows", "n_nulls", "n_unique", "n_dates", "n_affixed", "n_years"]
    # One row per table column, so the broadcast is bounded by the schema.
    return column_dictionary(df).join(F.broadcast(counts), "column", "left").fillna(0, figures)


def readiness_findings(
    df: DataFrame, rules: ReportRules = ReportRules(), features: DataFrame | None = None
) -> DataFrame:
    """One finding per column by the rules, `no problem` where none applies."""
    f = column_features(df, rules) if features is None else features
    is_text = F.col("dtype") == "string"
    is_whole = F.col("dtype").isin("tinyint", "smallint", "int", "bigint")
    n_valid = F.col("n_rows") - F.col("n_nulls")
    enough = F.lit(rules.parse_share) * n_valid
    has_values = n_valid > 0

    key = is_whole & has_values & (F.col("n_unique") == F.col("n_rows")) & F.col("column").rlike(rules.key_names)
    date = is_text & has_values & (F.col("n_dates") >= enough)
    number = is_text & has_values & ~date & (F.col("n_affixed") >= enough)
    few = F.least(F.lit(float(rules.max_categories)), F.lit(rules.max_category_share) * n_valid)
    category = is_text & has_values & ~date & ~number & (F.col("n_unique") <= few)
    gaps = F.col("n_nulls") > 0
    year = is_whole & has_values & F.col("column").rlike(rules.year_names) & (F.col("n_years") == n_valid)

    # rule, action, severity, explanation
    table = [
        (key, "drop_column", "low", F.lit("Every row has its own value, so the column only numbers the rows.")),
        (date, "convert_dtype", "medium", F.lit("The text holds dates.")),
        (number, "convert_dtype", "high", F.lit("The text holds numbers.")),
        (
            category,
            "encode_categorical",
            "medium",
            F.concat(F.lit("The text takes only "), F.col("n_unique").cast("string"), F.lit(" values.")),
        ),
        (
            gaps,
            "fill_missing_values",
            "medium",
            F.concat(
                F.col("n_nulls").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" values are missing.")
            ),
        ),
        (year, "create_derived_col", "low", F.lit("The column holds years, from which an age can be derived.")),
    ]
    actions = F.array(
        *[
            F.when(test, F.struct(why.alias("explanation"), F.lit(action).alias("action_type")))
            for test, action, _, why in table
        ]
    )
    severity = F.lit("no problem")
    for level in reversed(SEVERITIES[:-1]):
        tests = [t for t, _, s, _ in table if s == level]
        if tests:
            hit = tests[0]
            for t in tests[1:]:
                hit = hit | t
            severity = F.when(hit, level).otherwise(severity)
    return f.select(
        "position",
        "column",
        severity.alias("severity"),
        F.filter(actions, lambda a: a.isNotNull()).alias("suggested_actions"),
    )


def readiness_status(
    findings: DataFrame, features: DataFrame | None = None, target: str | None = None, rules: ReportRules = ReportRules()
) -> DataFrame:
    """One row, `readiness_status, n_findings`.

    A `very high` finding, or a target column with too many missing cells, makes the table
    not ready; any other finding leaves it ready with issues.
    """
    worst = F.coalesce(F.bool_or(F.col("severity") == "very high"), F.lit(False))
    n = F.count_if(F.col("severity") != "no problem")
    found = findings.agg(worst.alias("worst"), n.alias("n_findings"))
    if target is not None:
        if features is None:
            raise ValueError("The features are needed to judge the target column.")
        empty = features.where(F.col("column") == target).agg(
            F.coalesce(
                F.max(F.col("n_nulls") > F.lit(rules.unready_null_share) * F.col("n_rows")), F.lit(False)
            ).alias("empty")
        )
        found = found.withColumn("worst", F.col("worst") | empty.scalar())
    return found.select(
        F.when(F.col("worst"), "not_ready")
        .when(F.col("n_findings") > 0, "ready_with_issues")
        .otherwise("ready")
        .alias("readiness_status"),
        "n_findings",
    )


def readiness_report(
    df: DataFrame, summary: str = "", target: str | None = None, rules: ReportRules = ReportRules()
) -> DataFrame:
    """One row, `readiness_status, summary, findings, markdown`; a finding per column of the table.

    The features are stored once, as the findings, the status and the text all rest on them.
    """
    features = stored(column_features(df, rules), "features")
    found = readiness_findings(df, rules, features)
    status = readiness_status(found, features, target, rules)
    one = F.struct("position", "column", "severity", "suggested_actions")
    listed = found.agg(F.sort_array(F.collect_list(one)).alias("findings"))
    return listed.select(
        status.select("readiness_status").scalar().alias("readiness_status"),
        F.lit(summary).alias("summary"),
        F.transform("findings", lambda x: x.dropFields("position")).alias("findings"),
        report_markdown(found, status, summary).scalar().alias("markdown"),
    )


@dataclass(frozen=True)
class FindingsContract:
    """Which actions and which severity a report should name per column."""

    actions: Mapping[str, Sequence[str]]
    severities: Mapping[str, str]


def _finding_checks(contract: FindingsContract) -> list[tuple[str, str, str, str, Column]]:
    def found(column: str, test: Column) -> Column:
        return F.coalesce(F.bool_or((F.col("column") == column) & test), F.lit(False))

    checks = []
    named = F.transform("suggested_actions", lambda a: a["action_type"])
    for column, actions in contract.actions.items():
        for action in actions:
            name = f"{column}_expected_action_has_{action}"
            checks.append((name, "action", column, action, found(column, F.array_contains(named, action))))
    for column, severity in contract.severities.items():
        name = f"{column}_severity_is_{severity}"
        checks.append((name, "severity", column, severity, found(column, F.col("severity") == severity)))
    return checks


def check_findings(findings: DataFrame, contract: FindingsContract) -> DataFrame:
    """One row with one boolean column per check; one aggregation over the findings."""
    return findings.agg(*[holds.alias(name) for name, *_, holds in _finding_checks(contract)])


def check_findings_rows(findings: DataFrame, contract: FindingsContract) -> DataFrame:
    """The same as rows `check, kind, column, expected, passed`."""
    checks = _finding_checks(contract)
    wide = findings.agg(*[c[-1].alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in zip(("check", "kind", "column", "expected"), c[:4])],
            F.col(f"c{i}").alias("passed"),
        )
        for i, c in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*rows)))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def finding_text(findings: DataFrame) -> DataFrame:
    """Add `text`: `[Severity] column: explanation Suggested action: Action. …`."""
    sentences = F.transform(
        "suggested_actions",
        lambda a: F.concat(a["explanation"], F.lit(" Suggested action: "), _capital(a["action_type"])),
    )
    head = F.concat(F.lit("["), _capital(F.col("severity")), F.lit("] "), F.col("column"))
    tail = F.when(F.size("suggested_actions") > 0, F.concat(F.lit(": "), F.array_join(sentences, ". "))).otherwise("")
    return findings.withColumn("text", F.concat(head, tail))


# The headings of the Markdown report.
STATUS_HEADING = "### Status: "
SUMMARY_HEADING = "### Resumo: "
FINDINGS_HEADING = "### Problemas encontrados:"


def report_markdown(findings: DataFrame, status: DataFrame, summary: str) -> DataFrame:
    """One row, `markdown`: the report on one table. It has one line per column of that table."""
    lines = F.sort_array(F.collect_list(F.struct("position", F.concat(F.lit("- "), F.col("text")).alias("line"))))
    body = finding_text(findings).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body")
    )
    title = F.array_join(F.transform(F.split("readiness_status", "_"), F.initcap), "_")
    headed = status.select(F.concat(F.lit(STATUS_HEADING), title))
    return body.select(
        F.concat_ws(
            "\n",
            headed.scalar(),
            F.lit(""),
            F.lit(f"{SUMMARY_HEADING}\n{summary}"),
            F.lit(""),
            F.lit(FINDINGS_HEADING),
            F.col("body"),
        ).alias("markdown")
    )
