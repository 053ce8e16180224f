"""Contracts and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import contracts as C, findings as G
from tidemark.session import stored
from workload.tables import LABELLED, labelled, on

LINE_CONTRACT = C.TableContract(
    dtypes={"l_orderkey": "numeric", "l_returnflag": "string", "l_shipdate": "datetime", "l_tax": "string", "gone": "numeric"},
    not_all_null=("l_quantity", "gone"),
    no_nulls=("l_discount",),
    cardinality={"l_returnflag": 3, "l_linestatus": 3, "l_linenumber": 7},
    ranges={"l_quantity": (1, 50), "l_discount": (0, 0.05), "l_returnflag": (0, 1)},
)

LABEL_CONTRACT = C.TableContract(
    dtypes={"old_quality": "numeric"},
    not_all_null=("old_quality", "toxic"),
    no_nulls=("old_quality", "lang"),
    cardinality={"old_quality": 2, "lang": 4},
    ranges={"old_quality": (0, 1), "n_chars": (0, 1000000)},
)


@on("lineitem")
def contract_lineitem(lineitem: DataFrame) -> DataFrame:
    return C.check_contract_rows(lineitem, LINE_CONTRACT)


@on("lineitem")
def contract_lineitem_wide(lineitem: DataFrame) -> DataFrame:
    return C.check_contract(lineitem, LINE_CONTRACT)


@on("documents", "labels")
def contract_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expectations by the original name of a column that was renamed."""
    return C.check_contract_rows(labelled(documents, labels), LABEL_CONTRACT, {"old_quality": "quality"})


@on("lineitem")
def contract_lineitem_met(lineitem: DataFrame) -> DataFrame:
    return C.contract_met(lineitem, LINE_CONTRACT)


RULES = G.ReportRules(key_names=r"(?i)^(id|doc_id)$")

DOCS_CONTRACT = G.FindingsContract(
    actions={
        "quality": ["fill_missing_values"],
        "lang": ["encode_categorical", "drop_column"],
        "doc_id": ["drop_column"],
        "gone": ["drop_column"],
    },
    severities={"quality": "medium", "lang": "high", "text": "no problem", "doc_id": "low", "gone": "low"},
)


def _findings(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return G.readiness_findings(labelled(documents, labels), RULES)


@on("documents", "labels")
def readiness_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = _findings(documents, labels)
    return found.select(
        "position",
        "column",
        "severity",
        F.array_join(F.transform("suggested_actions", lambda a: a["action_type"]), ",").alias("actions"),
    )


@on("orders")
def readiness_order_texts(orders: DataFrame) -> DataFrame:
    """Dates and amounts written as text."""
    texts = orders.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy").cast("int").alias("Year"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.concat(F.lit("R$ "), F.col("o_totalprice").cast("int").cast("string"), F.lit(",50")).alias("price"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" units")).alias("units"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
    )
    found = G.readiness_findings(texts)
    return found.select(
        "column",
        "severity",
        F.array_join(F.transform("suggested_actions", lambda a: a["action_type"]), ",").alias("actions"),
    )


@on("orders")
def readiness_padded(orders: DataFrame) -> DataFrame:
    """Cells of a file of fixed width: dates and amounts padded to 80 characters, and long plain texts."""
    day = F.when(F.col("o_orderkey") % 100 == 7, F.lit("not known")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    price = F.concat(F.lit("R$ "), F.col("o_totalprice").cast("int").cast("string"), F.lit(",50"))
    padded = orders.select(
        F.rpad(day, 80, " ").alias("day"),
        F.rpad(price, 80, " ").alias("price"),
        F.rpad("o_orderpriority", 80, ".").alias("priority"),
        F.rpad(F.concat("o_orderstatus", F.col("o_orderkey").cast("string")), 80, "x").alias("code"),
    )
    features = G.column_features(padded)
    return features.select("column", "n_rows", "n_nulls", "n_unique", "n_dates", "n_affixed")


@on("orders")
def readiness_padded_findings(orders: DataFrame) -> DataFrame:
    """What the rules make of them."""
    padded = orders.select(
        F.rpad(F.date_format("o_orderdate", "dd/MM/yyyy"), 80, " ").alias("day"),
        F.rpad(F.concat(F.col("o_totalprice").cast("int").cast("string"), F.lit(",50")), 80, " ").alias("price"),
    )
    found = G.readiness_findings(padded)
    return found.select(
        "column", "severity", F.array_join(F.transform("suggested_actions", lambda a: a["action_type"]), ",").alias("actions")
    )


@on("documents", "labels")
def readiness_status_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    features = stored(G.column_features(labelled(documents, labels), RULES), "features")
    found = G.readiness_findings(labelled(documents, labels), RULES, features)
    return G.readiness_status(found, features, target="quality", rules=RULES)


@on("documents", "labels")
def readiness_report_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Status, findings and text in one row."""
    report = G.readiness_report(labelled(documents, labels), "Documents with labels.", "quality", RULES)
    return report.select(
        "readiness_status",
        "summary",
        F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["column"], x["severity"])), ";").alias("findings"),
        F.size("findings").alias("n_columns"),
        "markdown",
    )


@on("documents", "labels")
def findings_contract(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return G.check_findings_rows(_findings(documents, labels), DOCS_CONTRACT)


@on("documents", "labels")
def findings_contract_wide(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return G.check_findings(_findings(documents, labels), DOCS_CONTRACT)


@on("documents", "labels")
def findings_text(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return G.finding_text(_findings(documents, labels)).select("column", "text")


@on("documents", "labels")
def findings_markdown(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = _findings(documents, labels)
    return G.report_markdown(found, G.readiness_status(found), "Documents with labels.")


QUERIES = {
    "contract_lineitem": contract_lineitem,
    "contract_lineitem_wide": contract_lineitem_wide,
    "contract_labels": contract_labels,
    "contract_lineitem_met": contract_lineitem_met,
    "readiness_docs": readiness_docs,
    "readiness_order_texts": readiness_order_texts,
    "readiness_padded": readiness_padded,
    "readiness_padded_findings": readiness_padded_findings,
    "readiness_status_docs": readiness_status_docs,
    "readiness_report_docs": readiness_report_docs,
    "findings_contract": findings_contract,
    "findings_contract_wide": findings_contract_wide,
    "findings_text": findings_text,
    "findings_markdown": findings_markdown,
}

# check name, kind, column, expected, test
_LINE_CHECKS = [
    ("l_orderkey_dtype_is_numeric", "dtype", "l_orderkey", "numeric", "count(*) >= 0"),
    ("l_returnflag_dtype_is_string", "dtype", "l_returnflag", "string", "count(*) >= 0"),
    ("l_shipdate_dtype_is_datetime", "dtype", "l_shipdate", "datetime", "count(*) >= 0"),
    ("l_tax_dtype_is_string", "dtype", "l_tax", "string", "count(*) < 0"),
    ("gone_dtype_is_numeric", "dtype", "gone", "numeric", "count(*) < 0"),
    ("l_quantity_doesnt_has_nulls", "not_all_null", "l_quantity", "", "count(l_quantity) > 0"),
    ("gone_doesnt_has_nulls", "not_all_null", "gone", "", "count(*) < 0"),
    ("l_discount_has_no_nulls", "no_nulls", "l_discount", "", "count(*) filter (where l_discount is null) = 0"),
    ("l_returnflag_cardinality_is_3", "cardinality", "l_returnflag", "3", "count(distinct l_returnflag) = 3"),
    ("l_linestatus_cardinality_is_3", "cardinality", "l_linestatus", "3", "count(distinct l_linestatus) = 3"),
    ("l_linenumber_cardinality_is_7", "cardinality", "l_linenumber", "7", "count(distinct l_linenumber) = 7"),
    ("l_quantity_is_between_1_and_50", "range", "l_quantity", "1..50", "bool_and(l_quantity between 1 and 50)"),
    ("l_discount_is_between_0_and_0.05", "range", "l_discount", "0..0.05", "bool_and(l_discount between 0 and 0.05)"),
    ("l_returnflag_is_between_0_and_1", "range", "l_returnflag", "0..1", "count(*) < 0"),
]
_LABEL_CHECKS = [
    ("old_quality_dtype_is_numeric", "dtype", "old_quality", "numeric", "count(*) >= 0"),
    ("old_quality_doesnt_has_nulls", "not_all_null", "old_quality", "", "count(quality) > 0"),
    ("toxic_doesnt_has_nulls", "not_all_null", "toxic", "", "count(toxic) > 0"),
    ("old_quality_has_no_nulls", "no_nulls", "old_quality", "", "count(quality) = count(*)"),
    ("lang_has_no_nulls", "no_nulls", "lang", "", "count(lang) = count(*)"),
    ("old_quality_cardinality_is_2", "cardinality", "old_quality", "2", "count(distinct quality) = 2"),
    ("lang_cardinality_is_4", "cardinality", "lang", "4", "count(distinct lang) = 4"),
    (
        "old_quality_is_between_0_and_1", "range", "old_quality", "0..1",
        "bool_and(coalesce(quality between 0 and 1, false))",
    ),
    (
        "n_chars_is_between_0_and_1000000", "range", "n_chars", "0..1000000",
        "bool_and(n_chars between 0 and 1000000)",
    ),
]


def _check_rows(source: str, checks: list[tuple]) -> str:
    rows = [
        f"""select '{name}' as "check", '{kind}' as kind, '{column}' as "column", '{expected}' as expected,
            {test} as passed from {source}"""
        for name, kind, column, expected, test in checks
    ]
    return " union all ".join(rows)


_COUNTS = f"select count(*) as n, count(quality) as nq, count(toxic) as nt from ({LABELLED})"


def _gaps(count: str) -> tuple[str, str]:
    why = f"(n - {count}) || ' of ' || n || ' values are missing.'"
    return f"case when {count} < n then 'medium' else 'no problem' end", f"case when {count} < n then {why} end"


def _findings_sql() -> str:
    """The findings on the labelled documents: position, column, severity, actions, explanation."""
    rows = [
        (0, "doc_id", "'low'", "'drop_column'", "'Every row has its own value, so the column only numbers the rows.'"),
        (1, "text", "'no problem'", "''", "null"),
        (2, "lang", "'medium'", "'encode_categorical'", "'The text takes only ' || nl || ' values.'"),
        (3, "source", "'medium'", "'encode_categorical'", "'The text takes only ' || ns || ' values.'"),
        (4, "n_chars", "'no problem'", "''", "null"),
    ]
    for position, column, count in ((5, "quality", "nq"), (6, "toxic", "nt")):
        severity, why = _gaps(count)
        rows.append((position, column, severity, f"case when {count} < n then 'fill_missing_values' else '' end", why))
    counts = f"""(select count(*) as n, count(quality) as nq, count(toxic) as nt, count(distinct lang) as nl,
                  count(distinct source) as ns from ({LABELLED}))"""
    return " union all ".join(
        f"""select {p} as position, '{c}' as "column", {s} as severity, {a} as actions, {w} as why from {counts}"""
        for p, c, s, a, w in rows
    )


_FOUND = _findings_sql()
_TEXT = f"""
select position, "column",
       '[' || upper(severity[1]) || severity[2:] || '] ' || "column" ||
       case when actions = '' then '' else ': ' || why || ' Suggested action: ' || upper(actions[1]) || actions[2:] end
         as text
from ({_FOUND})"""
_FINDING_CHECKS = [
    ("quality_expected_action_has_fill_missing_values", "action", "quality", "fill_missing_values"),
    ("lang_expected_action_has_encode_categorical", "action", "lang", "encode_categorical"),
    ("lang_expected_action_has_drop_column", "action", "lang", "drop_column"),
    ("doc_id_expected_action_has_drop_column", "action", "doc_id", "drop_column"),
    ("gone_expected_action_has_drop_column", "action", "gone", "drop_column"),
    ("quality_severity_is_medium", "severity", "quality", "medium"),
    ("lang_severity_is_high", "severity", "lang", "high"),
    ("text_severity_is_no problem", "severity", "text", "no problem"),
    ("doc_id_severity_is_low", "severity", "doc_id", "low"),
    ("gone_severity_is_low", "severity", "gone", "low"),
]


def _finding_test(kind: str, column: str, expected: str) -> str:
    field = "actions" if kind == "action" else "severity"
    return f"""coalesce(bool_or("column" = '{column}' and {field} = '{expected}'), false)"""


def _markdown(title: str) -> str:
    return f"""
        '### Status: {title}' || chr(10) || chr(10) || '### Resumo: ' || chr(10) || 'Documents with labels.'
        || chr(10) || chr(10) || '### Problemas encontrados:' || chr(10)
        || string_agg('- ' || text, chr(10) order by position)"""


SQL = {
    "contract_lineitem": _check_rows("lineitem", _LINE_CHECKS),
    "contract_lineitem_wide": "select "
    + ", ".join(f'{t} as "{n}"' for n, *_, t in _LINE_CHECKS)
    + " from lineitem",
    "contract_labels": _check_rows(f"({LABELLED})", _LABEL_CHECKS),
    "contract_lineitem_met": "select " + " and ".join(t for *_, t in _LINE_CHECKS) + " as passed from lineitem",
    "readiness_docs": f"""select position, "column", severity, actions from ({_FOUND})""",
    "readiness_order_texts": """
        select v."column", v.severity, v.actions
        from (values ('id', 'low', 'drop_column'), ('Year', 'low', 'create_derived_col'),
                     ('day', 'medium', 'convert_dtype'), ('price', 'high', 'convert_dtype'),
                     ('units', 'high', 'convert_dtype'),
                     ('priority', 'medium', (select case when count(distinct o_orderpriority) - 1 <= 50
                        then 'encode_categorical,fill_missing_values' end from orders)))
             v("column", severity, actions)""",
    "readiness_padded": """
        with padded as (
          select rpad(case when o_orderkey % 100 = 7 then 'not known' else strftime(o_orderdate, '%d/%m/%Y') end, 80, ' ') as day,
                 rpad('R$ ' || cast(trunc(o_totalprice) as int) || ',50', 80, ' ') as price,
                 rpad(o_orderpriority, 80, '.') as priority, rpad(o_orderstatus || o_orderkey, 80, 'x') as code
          from orders),
        cells as (unpivot padded on day, price, priority, code into name "column" value v)
        select "column", count(*) as n_rows, cast(count(*) - count(v) as bigint) as n_nulls, count(distinct v) as n_unique,
               count(try_strptime(trim(v), '%d/%m/%Y')) as n_dates,
               count(*) filter (where regexp_matches(trim(v), '^([A-Za-z]{0,3}\\$)?\\s*[+-]?[0-9][0-9.,]*\\s*[a-zA-Z%]{0,12}$')) as n_affixed
        from cells group by 1""",
    "readiness_padded_findings": """
        select 'day' as "column",
               case when count(try_strptime(trim(rpad(strftime(o_orderdate, '%d/%m/%Y'), 80, ' ')), '%d/%m/%Y')) >= 0.95 * count(*)
                 then 'medium' else 'no problem' end as severity,
               case when count(o_orderdate) >= 0.95 * count(*) then 'convert_dtype' else '' end as actions
        from orders
        union all
        select 'price', case when count(o_totalprice) >= 0.95 * count(*) then 'high' else 'no problem' end,
               case when count(o_totalprice) >= 0.95 * count(*) then 'convert_dtype' else '' end
        from orders""",
    "readiness_status_docs": f"""
        select case when nq < 0.5 * n then 'not_ready' else 'ready_with_issues' end as readiness_status,
               cast(3 + case when nq < n then 1 else 0 end + case when nt < n then 1 else 0 end as bigint) as n_findings
        from ({_COUNTS})""",
    "findings_contract": " union all ".join(
        f"""select '{n}' as "check", '{k}' as kind, '{c}' as "column", '{e}' as expected,
            {_finding_test(k, c, e)} as passed from ({_FOUND})"""
        for n, k, c, e in _FINDING_CHECKS
    ),
    "findings_contract_wide": "select "
    + ", ".join(f'{_finding_test(k, c, e)} as "{n}"' for n, k, c, e in _FINDING_CHECKS)
    + f" from ({_FOUND})",
    "findings_text": f"""select "column", text from ({_TEXT})""",
    "findings_markdown": f"select {_markdown('Ready_With_Issues')} as markdown from ({_TEXT})",
    "readiness_report_docs": f"""
        select case when nq < 0.5 * n then 'not_ready' else 'ready_with_issues' end as readiness_status,
               'Documents with labels.' as summary, findings, n_columns,
               case when nq < 0.5 * n then bad else good end as markdown
        from ({_COUNTS}),
             (select string_agg("column" || ':' || severity, ';' order by position) as findings,
                     cast(count(*) as int) as n_columns from ({_FOUND})),
             (select {_markdown('Not_Ready')} as bad, {_markdown('Ready_With_Issues')} as good from ({_TEXT}))""",
}
