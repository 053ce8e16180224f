"""Quality diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import quality as Q
from workload.profiling import LINEITEM, PART
from workload.tables import LABELLED, labelled, on, round6


@on("lineitem")
def dup_rows_lineitem(lineitem: DataFrame) -> DataFrame:
    return Q.duplicate_rows(lineitem, ["l_orderkey", "l_linenumber", "l_orderkey", "no_such_column"])


@on("orders")
def dup_rows_all_cols(orders: DataFrame) -> DataFrame:
    """Rows that are equal throughout; every third row is there twice, every ninth three times."""
    again = orders.where(F.col("o_orderkey") % 3 == 0).unionByName(orders.where(F.col("o_orderkey") % 9 == 0))
    return Q.duplicate_rows(orders.unionByName(again))


@on("documents")
def dup_texts(documents: DataFrame) -> DataFrame:
    """Documents with the text, language and length of another one."""
    return Q.duplicate_rows(documents, ["text", "lang", "n_chars"])


@on("conversations")
def dup_turns(conversations: DataFrame) -> DataFrame:
    return Q.duplicate_rows(conversations, ["conv_id", "role", "text"])


@on("documents", "labels")
def dup_rows_with_nulls(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return Q.duplicate_rows(labelled(documents, labels), ["lang", "quality", "toxic"])


def _mixed(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mixed = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "view", F.col("value").cast("string"))
        .when(kind == "error", F.col("event_id").cast("string"))
        .when(kind == "signup", F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit('"'), kind, F.lit('"')))
    )
    return events.select(mixed.alias("mixed"))


@on("events")
def type_mix_wide(events: DataFrame) -> DataFrame:
    """Whole numbers beyond 64 bits beside decimals."""
    wide = F.concat(F.lit("123456789012345678"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    mixed = F.when(F.col("event_id") % 3 == 0, F.concat(wide, F.lit(".5"))).otherwise(wide)
    return Q.value_types(events.select(mixed.alias("mixed")), "mixed", read="json")


@on("events")
def type_mix_props(events: DataFrame) -> DataFrame:
    return Q.value_types(_mixed(events), "mixed", read="json")


@on("events")
def type_mix_literal(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.col("user_id").cast("string"))
        .when(kind == "view", F.col("value").cast("string"))
        .when(kind == "error", (F.col("value") > 50).cast("string"))
        .when(kind == "signup", F.col("ts").cast("string"))
        .otherwise(F.col("props"))
    )
    return Q.value_types(events.select(text.alias("text")), "text", read="literal")


@on("documents", "labels")
def type_mix_typed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return Q.value_types(labelled(documents, labels), "quality")


@on("part")
def top_values_brand(part: DataFrame) -> DataFrame:
    return Q.top_values(part, "p_brand")


@on("lineitem")
def top_values_shipdate(lineitem: DataFrame) -> DataFrame:
    return Q.top_values(lineitem, "l_shipdate")


@on("documents", "labels")
def top_values_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return Q.top_values(labelled(documents, labels), "quality")


@on("part")
def top_values_all_cols(part: DataFrame) -> DataFrame:
    return Q.top_values_all(part)


@on("lineitem")
def top_values_lineitem(lineitem: DataFrame) -> DataFrame:
    return Q.top_values_all(lineitem)


@on("documents", "labels")
def missingness_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = Q.missing_patterns(labelled(documents, labels), "quality", by=["lang", "source"])
    return round6(out, "missing_share")


@on("documents", "labels")
def missingness_all_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return round6(Q.missing_patterns(labelled(documents, labels), "toxic"), "missing_share")


@on("documents")
def missingness_none(documents: DataFrame) -> DataFrame:
    return Q.missing_patterns(documents, "n_chars")


FIGURES = ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_percentage"]


@on("events")
def outliers_events(events: DataFrame) -> DataFrame:
    return round6(Q.iqr_outliers(events, ["value"]), *FIGURES)


@on("lineitem")
def outliers_unit_price(lineitem: DataFrame) -> DataFrame:
    unit = lineitem.select((F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    return round6(Q.iqr_outliers(unit), *FIGURES)


@on("documents", "labels")
def outliers_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every numeric column at once, and one that is not numeric."""
    docs = labelled(documents, labels)
    return round6(Q.iqr_outliers(docs, ["doc_id", "n_chars", "quality", "toxic", "lang"]), *FIGURES)


def _outliers_sql(source: str, column: str) -> str:
    return f"""
        select '{column}' as "column", round(q1, 6) as q1, round(q3, 6) as q3, round(iqr, 6) as iqr,
               round(lo, 6) as lower_bound, round(hi, 6) as upper_bound, n_lower, n_upper, n_valid,
               round((n_lower + n_upper) * 100.0 / n_valid, 6) as outlier_percentage,
               cast(null as varchar) as message
        from (
          select any_value(q1) as q1, any_value(q3) as q3, any_value(iqr) as iqr, any_value(lo) as lo,
                 any_value(hi) as hi, count(*) filter (where v < lo) as n_lower,
                 count(*) filter (where v > hi) as n_upper, count(v) as n_valid
          from (select cast({column} as double) as v from {source} where {column} is not null), (
            select q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
            from (select quantile_cont(cast({column} as double), 0.25) as q1,
                         quantile_cont(cast({column} as double), 0.75) as q3 from {source})))"""


def _missing_sql(target: str, by: list[str]) -> str:
    rows = [
        f"""select '{c}' as by_column, {c} as category, count(*) as n_rows,
            round(avg(cast({target} is null as int)), 6) as missing_share
            from ({LABELLED}) where {c} is not null group by {c}"""
        for c in by
    ]
    return " union all ".join(rows)


def _top_sql(source: str, columns: list[str], limit: int) -> str:
    counts = " union all ".join(
        f"""select '{c}' as "column", cast({c} as varchar) as value, count(*) as n from {source} group by {c}"""
        for c in columns
    )
    return f"""
        select "column", value, n, cast(rank as int) as rank
        from (select *, row_number() over (partition by "column" order by n desc, value asc nulls last) as rank
              from ({counts})) where rank <= {limit}"""


QUERIES = {
    "dup_rows_lineitem": dup_rows_lineitem,
    "dup_rows_all_cols": dup_rows_all_cols,
    "dup_texts": dup_texts,
    "dup_turns": dup_turns,
    "dup_rows_with_nulls": dup_rows_with_nulls,
    "type_mix_props": type_mix_props,
    "type_mix_wide": type_mix_wide,
    "type_mix_literal": type_mix_literal,
    "type_mix_typed": type_mix_typed,
    "top_values_brand": top_values_brand,
    "top_values_shipdate": top_values_shipdate,
    "top_values_quality": top_values_quality,
    "top_values_all_cols": top_values_all_cols,
    "top_values_lineitem": top_values_lineitem,
    "missingness_quality": missingness_quality,
    "missingness_all_texts": missingness_all_texts,
    "missingness_none": missingness_none,
    "outliers_events": outliers_events,
    "outliers_unit_price": outliers_unit_price,
    "outliers_docs": outliers_docs,
}


def _duplicates_sql(source: str, columns: str) -> str:
    return f"""select cast(coalesce(sum(n - 1), 0) as bigint) as n_duplicates
               from (select count(*) as n from {source} group by {columns})"""


SQL = {
    "dup_rows_lineitem": _duplicates_sql("lineitem", "l_orderkey, l_linenumber"),
    "dup_rows_all_cols": _duplicates_sql(
        """(select * from orders union all select * from orders where o_orderkey % 3 = 0
            union all select * from orders where o_orderkey % 9 = 0)""",
        "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    ),
    "dup_texts": _duplicates_sql("documents", "text, lang, n_chars"),
    "dup_turns": _duplicates_sql("conversations", "conv_id, role, text"),
    "dup_rows_with_nulls": _duplicates_sql(f"({LABELLED})", "lang, quality, toxic"),
    "type_mix_props": """
        select case json_type(mixed) when 'OBJECT' then 'dict' when 'ARRAY' then 'list' when 'DOUBLE' then 'float'
                 when 'BIGINT' then 'int' when 'UBIGINT' then 'int' when 'VARCHAR' then 'str' end as value_type,
               count(*) as n
        from (select case event_type when 'click' then props when 'view' then cast(value as varchar)
                when 'error' then cast(event_id as varchar) when 'signup' then '[' || user_id || ']'
                else '"' || event_type || '"' end as mixed from events)
        group by 1""",
    "type_mix_wide": """
        select case when event_id % 3 = 0 then 'float' else 'int' end as value_type, count(*) as n
        from events group by 1""",
    "type_mix_literal": """
        select case event_type when 'click' then 'int' when 'view' then 'float' when 'error' then 'bool'
                 when 'signup' then 'datetime' else 'str' end as value_type, count(*) as n
        from events group by 1""",
    "type_mix_typed": f"select 'int' as value_type, count(quality) as n from ({LABELLED})",
    "top_values_brand": """
        select p_brand as value, count(*) as n from part group by 1 order by n desc, value asc nulls last limit 50""",
    "top_values_shipdate": """
        select l_shipdate as value, count(*) as n from lineitem group by 1
        order by n desc, value asc nulls last limit 50""",
    "top_values_quality": f"select quality as value, count(*) as n from ({LABELLED}) group by 1",
    "top_values_all_cols": _top_sql("part", PART, 50),
    "top_values_lineitem": _top_sql("lineitem", LINEITEM, 50),
    "missingness_quality": _missing_sql("quality", ["lang", "source"]),
    "missingness_all_texts": _missing_sql("toxic", ["text", "lang", "source"]),
    "missingness_none": """
        select cast(null as varchar) as by_column, cast(null as varchar) as category, cast(null as bigint) as n_rows,
               cast(null as double) as missing_share
        from documents where n_chars is null""",
    "outliers_events": _outliers_sql("events", "value"),
    "outliers_unit_price": _outliers_sql(
        "(select l_extendedprice / l_quantity as unit_price from lineitem)", "unit_price"
    ),
    "outliers_docs": " union all ".join(
        _outliers_sql(f"({LABELLED})", c) for c in ["doc_id", "n_chars", "quality", "toxic"]
    )
    + """ union all select 'lang', null, null, null, null, null, null, null, null, null,
          'not numeric: quartiles do not apply'""",
}
