"""Profile and single-column questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import profile as P
from workload.tables import LABELLED, labelled, on


@on("orders")
def profile_orders(orders: DataFrame) -> DataFrame:
    out = P.profile(orders, order_by=["o_orderkey"])
    return out.withColumn("sample", F.array_join("sample", " | "))


@on("lineitem")
def profile_lineitem(lineitem: DataFrame) -> DataFrame:
    return P.column_counts(lineitem)


@on("documents")
def profile_documents(documents: DataFrame) -> DataFrame:
    return P.column_counts(documents)


@on("events")
def profile_events(events: DataFrame) -> DataFrame:
    return P.column_counts(events)


@on("embeddings")
def profile_embeddings(embeddings: DataFrame) -> DataFrame:
    """A column of arrays is counted by its JSON text."""
    return P.column_counts(embeddings)


@on("pages")
def profile_pages(pages: DataFrame) -> DataFrame:
    return P.column_counts(pages)


@on("conversations")
def profile_conversations(conversations: DataFrame) -> DataFrame:
    return P.column_counts(conversations)


@on("documents", "labels")
def profile_nulls_docs(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return P.null_counts(labelled(documents, labels))


@on("documents", "labels")
def has_nulls_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return P.has_nulls(labelled(documents, labels), "quality")


@on("lineitem")
def row_count_lineitem(lineitem: DataFrame) -> DataFrame:
    return P.row_count(lineitem)


@on("part")
def unique_counts_part(part: DataFrame) -> DataFrame:
    return P.unique_counts(part)


@on("part")
def sample_parts(part: DataFrame) -> DataFrame:
    return P.samples(part, order_by=["p_partkey"]).withColumn("sample", F.array_join("sample", " | "))


@on("part")
def sample_part_names(part: DataFrame) -> DataFrame:
    return P.column_sample(part, "p_name", order_by=["p_partkey"])


@on("orders")
def preview_orders(orders: DataFrame) -> DataFrame:
    return P.preview(orders, order_by=["o_orderkey"])


@on("customer")
def unique_segments(customer: DataFrame) -> DataFrame:
    return P.unique_values(customer, "c_mktsegment")


@on("documents", "labels")
def unique_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return P.unique_values(labelled(documents, labels), "quality")


def _counts_sql(source: str, columns: list[str]) -> str:
    rows = [
        f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_nulls,
            count(distinct {c}) as n_unique from {source}"""
        for c in columns
    ]
    return " union all ".join(rows)


def _samples_sql(source: str, columns: list[str], order: str) -> str:
    head = f"(select * from {source} order by {order} limit 5)"
    rows = [
        f"""select '{c}' as "column", string_agg(cast({c} as varchar), ' | ' order by {order}) as sample from {head}"""
        for c in columns
    ]
    return " union all ".join(rows)


ORDERS = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]

_DICTIONARY = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(ORDERS.items()))

QUERIES = {
    "profile_orders": profile_orders,
    "profile_lineitem": profile_lineitem,
    "profile_documents": profile_documents,
    "profile_events": profile_events,
    "profile_embeddings": profile_embeddings,
    "profile_pages": profile_pages,
    "profile_conversations": profile_conversations,
    "profile_nulls_docs": profile_nulls_docs,
    "has_nulls_quality": has_nulls_quality,
    "row_count_lineitem": row_count_lineitem,
    "unique_counts_part": unique_counts_part,
    "sample_parts": sample_parts,
    "sample_part_names": sample_part_names,
    "preview_orders": preview_orders,
    "unique_segments": unique_segments,
    "unique_quality": unique_quality,
}

SQL = {
    "profile_orders": f"""
        select cast(d.position as int) as position, d."column", d.dtype, c.n_rows, {len(ORDERS)} as n_columns,
               c.n_nulls, c.n_unique, s.sample
        from (values {_DICTIONARY}) d(position, "column", dtype)
        join ({_counts_sql("orders", list(ORDERS))}) c on c."column" = d."column"
        join ({_samples_sql("orders", list(ORDERS), "o_orderkey")}) s on s."column" = d."column" """,
    "profile_lineitem": _counts_sql("lineitem", LINEITEM),
    "profile_documents": _counts_sql("documents", DOCUMENTS),
    "profile_events": _counts_sql("events", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "profile_embeddings": _counts_sql("embeddings", ["vec_id", "embedding", "label"]),
    "profile_pages": _counts_sql("pages", ["page_id", "url", "html"]),
    "profile_conversations": _counts_sql("conversations", ["conv_id", "turn", "role", "text"]),
    "profile_nulls_docs": " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where {c} is null) as n_nulls from ({LABELLED})"""
        for c in [*DOCUMENTS, "quality", "toxic"]
    ),
    "has_nulls_quality": f"select bool_or(quality is null) as has_nulls from ({LABELLED})",
    "row_count_lineitem": "select count(*) as n_rows from lineitem",
    "unique_counts_part": " union all ".join(
        f"""select '{c}' as "column", count(distinct {c}) as n_unique from part""" for c in PART
    ),
    "sample_parts": _samples_sql("part", PART, "p_partkey"),
    "sample_part_names": "select p_name from part order by p_partkey limit 5",
    "preview_orders": "select * from orders order by o_orderkey limit 10",
    "unique_segments": "select distinct c_mktsegment from customer",
    "unique_quality": f"select distinct quality from ({LABELLED})",
}
