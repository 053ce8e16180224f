"""Column transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import transforms as X
from workload.tables import LABELLED, labelled, on, round6


@on("customer")
def rename_drop(customer: DataFrame) -> DataFrame:
    renamed = X.rename_column(customer, "c_mktsegment", "segment")
    return X.drop_column(renamed, "c_nationkey")


@on("orders")
def replace_substr(orders: DataFrame) -> DataFrame:
    return X.replace_substring(orders, "o_orderpriority", "-", ": ")


@on("part")
def replace_in_number(part: DataFrame) -> DataFrame:
    """The replacement works on the number's text."""
    return X.replace_substring(part, "p_retailprice", ".", ",")


@on("documents", "labels")
def fill_na_flag(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = labelled(documents, labels).select("doc_id", "lang", "quality", "toxic")
    filled = X.fill_col_na(docs, "quality", 0)
    return X.fill_col_na(filled, "toxic", -1)


@on("documents", "labels")
def fill_twice(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Zeros become missing between two fills; the flag covers both."""
    docs = labelled(documents, labels).select("doc_id", "quality")
    once = X.fill_col_na(docs, "quality", 1)
    gaps = once.withColumn("quality", F.nullif("quality", F.lit(0)))
    return X.fill_col_na(gaps, "quality", 7, frozen={"imputed_quality"})


@on("orders")
def to_datetime(orders: DataFrame) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy")))
    )
    return X.convert_column_to_datetime(orders.select("o_orderkey", text.alias("day")), "day")


@on("lineitem")
def to_int(lineitem: DataFrame) -> DataFrame:
    """All or nothing: text with blanks or a sign, and floats, which lose their fraction."""
    text = F.col("l_linenumber").cast("string")
    rows = lineitem.select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("+"), text)).otherwise(F.concat(F.lit(" "), text, F.lit(" "))).alias("line"),
        (F.col("l_quantity") + F.lit(0.25)).alias("quantity"),
    )
    return X.convert_column_to_int(X.convert_column_to_int(rows, "line"), "quantity")


@on("lineitem")
def to_float(lineitem: DataFrame) -> DataFrame:
    rows = lineitem.select(
        "l_orderkey",
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice").cast("string")).otherwise("nan").alias("price"),
        F.col("l_linenumber").alias("line"),
    )
    return X.convert_column_to_float(X.convert_column_to_float(rows, "price"), "line")


@on("lineitem")
def col_col_ops(lineitem: DataFrame) -> DataFrame:
    df = lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    df = X.subtract_cols(df, "l_quantity", "l_linenumber", "difference")
    df = X.sum_cols(df, "l_orderkey", "l_linenumber", "total")
    df = X.multiply_cols(df, "l_quantity", "l_tax", "product")
    df = X.power_cols(df, "l_quantity", "l_discount", "power")
    return round6(df, "difference", "product", "power")


@on("lineitem")
def safe_divide(lineitem: DataFrame) -> DataFrame:
    """Denominators that are missing, zero, fractions, or above one."""
    df = lineitem.select(
        "l_orderkey",
        "l_extendedprice",
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity") * F.col("l_tax") - 0.5).alias("part"),
    )
    return round6(X.divide_cols(df, "l_extendedprice", "part", "ratio"), "part", "ratio")


@on("part")
def col_const_ops(part: DataFrame) -> DataFrame:
    df = part.select(
        "p_partkey",
        F.col("p_size").alias("minus"),
        F.col("p_size").alias("plus"),
        F.col("p_retailprice").alias("times"),
        F.col("p_size").alias("over"),
        F.col("p_size").alias("over_zero"),
        F.col("p_size").alias("squared"),
    )
    df = X.subtract_value(df, "minus", 100)
    df = X.sum_value(df, "plus", 0.25)
    df = X.multiply_value(df, "times", 1.5)
    df = X.divide_value(df, "over", 8)
    df = X.divide_value(df, "over_zero", 0)
    df = X.power_value(df, "squared", 2)
    return round6(df, "plus", "times", "over", "squared")


@on("orders")
def map_priority(orders: DataFrame) -> DataFrame:
    ranks = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}
    return X.map_col_values(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ranks)


@on("part")
def map_sizes(part: DataFrame) -> DataFrame:
    """Keys as they come from JSON, on a whole-number column."""
    sizes = {"1": "tiny", "2": "tiny", "50": "huge"}
    return X.map_col_values(part.select("p_partkey", "p_size"), "p_size", sizes)


@on("customer", "nation")
def map_nation(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return X.map_from_table(customer, "c_nationkey", nation, "n_nationkey", "n_name")


@on("lineitem", "part")
def map_part_salted(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The way taken when the mapping table is too large to broadcast."""
    rows = lineitem.select("l_orderkey", "l_partkey")
    return X.map_from_table(rows, "l_partkey", part, "p_partkey", "p_brand", small=False)


QUERIES = {
    "rename_drop": rename_drop,
    "replace_substr": replace_substr,
    "replace_in_number": replace_in_number,
    "fill_na_flag": fill_na_flag,
    "fill_twice": fill_twice,
    "to_datetime": to_datetime,
    "to_int": to_int,
    "to_float": to_float,
    "col_col_ops": col_col_ops,
    "safe_divide": safe_divide,
    "col_const_ops": col_const_ops,
    "map_priority": map_priority,
    "map_sizes": map_sizes,
    "map_nation": map_nation,
    "map_part_salted": map_part_salted,
}

SQL = {
    "rename_drop": "select c_custkey, c_name, c_acctbal, c_mktsegment as segment from customer",
    "replace_substr": "select * replace (replace(o_orderpriority, '-', ': ') as o_orderpriority) from orders",
    "replace_in_number": """
        select * replace (replace(cast(p_retailprice as varchar), '.', ',') as p_retailprice) from part""",
    "fill_na_flag": f"""
        select doc_id, lang, cast(coalesce(quality, 0) as bigint) as quality,
               cast(coalesce(toxic, -1) as bigint) as toxic,
               quality is null as imputed_quality, toxic is null as imputed_toxic
        from ({LABELLED})""",
    "fill_twice": f"""
        select doc_id, cast(case when quality is null then 1 when quality = 0 then 7 else quality end as bigint)
                 as quality,
               quality is null or quality = 0 as imputed_quality
        from ({LABELLED})""",
    "to_datetime": """
        select o_orderkey,
               case o_orderstatus when 'O' then cast(cast(o_orderdate as date) as timestamp)
                 when 'F' then date_trunc('second', o_orderdate) end as day
        from orders""",
    "to_int": """
        select l_orderkey, cast(l_linenumber as bigint) as line,
               cast(trunc(l_quantity) as bigint) as quantity
        from lineitem""",
    "to_float": """
        select l_orderkey, case when l_linestatus = 'F' then l_extendedprice end as price,
               cast(l_linenumber as double) as line
        from lineitem""",
    "col_col_ops": """
        select l_orderkey, l_linenumber, l_quantity, l_tax, l_discount,
               round(l_quantity - l_linenumber, 6) as difference, l_orderkey + l_linenumber as total,
               round(l_quantity * l_tax, 6) as product, round(power(l_quantity, l_discount), 6) as power
        from lineitem""",
    "safe_divide": """
        select l_orderkey, l_extendedprice, round(part, 6) as part,
               round(case when part is not null then l_extendedprice / greatest(part, 1) end, 6) as ratio
        from (select *, case when l_returnflag <> 'A' then l_quantity * l_tax - 0.5::double end as part from lineitem)""",
    "col_const_ops": """
        select p_partkey, cast(p_size as bigint) - 100 as minus, round(p_size + 0.25::double, 6) as plus,
               round(p_retailprice * 1.5, 6) as times, round(p_size / 8, 6) as over,
               cast(null as double) as over_zero, round(power(p_size, 2), 6) as squared
        from part""",
    "map_priority": """
        select o_orderkey, cast(case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2
                 when '3-MEDIUM' then 3 when '5-LOW' then 5 end as bigint) as o_orderpriority
        from orders""",
    "map_sizes": """
        select p_partkey, case p_size when 1 then 'tiny' when 2 then 'tiny' when 50 then 'huge' end as p_size
        from part""",
    "map_nation": """
        select c_custkey, c_name, n_name as c_nationkey, c_acctbal, c_mktsegment
        from customer left join nation on c_nationkey = n_nationkey""",
    "map_part_salted": """
        select l_orderkey, p_brand as l_partkey from lineitem left join part on l_partkey = p_partkey""",
}
