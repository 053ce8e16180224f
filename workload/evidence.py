"""Evidence for readiness, votes on date layouts, bootstrap intervals, merged profiles, checked files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import bootstrap as B, evidence as E, findings as G, layouts as D, profile as P, results as R, states as S, transforms as T
from tidemark.plans import log as L
from tidemark.session import scratch_path
from tidemark.sources import files as X
from workload.tables import CALL_LOG, call_log, on, round6


def _planted(orders: DataFrame) -> DataFrame:
    """Amounts with a currency before them and units behind, and prices of which some are far too high."""
    price = F.col("o_totalprice").cast("double")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("R$ "), price.cast("int").cast("string"), F.lit(",50")).alias("amount"),
        F.concat((F.col("o_custkey") % 90 + 10).cast("string"), F.lit(" kg")).alias("weight"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("note"),
        F.when(F.col("o_orderkey") % 50 == 7, price * 1000).otherwise(price).alias("price"),
        (F.col("o_orderkey") % 10).alias("digit"),
    )


@on("orders")
def readiness_evidence(orders: DataFrame) -> DataFrame:
    """Findings with the actions that affixes and outliers ask for."""
    planted = _planted(orders)
    found = E.with_evidence(G.readiness_findings(planted), E.column_evidence(planted))
    return found.select(
        "column",
        "severity",
        F.array_join(F.transform("suggested_actions", lambda a: a["action_type"]), ",").alias("actions"),
        F.array_join(
            F.transform(
                F.filter("suggested_actions", lambda a: a["action_type"].isin("replace_substring", "modify_numeric_col")), lambda a: a["explanation"]
            ),
            " ",
        ).alias("evidence"),
    )


@on("orders")
def readiness_affixes(orders: DataFrame) -> DataFrame:
    return E.affixes(_planted(orders))


def _month_first(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate")
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 40 == 3, F.lit(None)).otherwise(F.date_format(day, "MM/dd/yyyy")).alias("us"),
        F.date_format(day, "dd/MM/yyyy").alias("eu"),
        F.when(F.col("o_orderkey") % 30 == 5, F.lit("soon")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("iso"),
    )


@on("orders")
def datetime_votes(orders: DataFrame) -> DataFrame:
    return D.layout_votes(_month_first(orders), ["us", "eu", "iso"])


@on("orders")
def datetime_month_first(orders: DataFrame) -> DataFrame:
    """Month-first dates, which day by day would be read wrongly or not at all."""
    texts = _month_first(orders)
    return T.convert_column_to_datetime(texts, "us", formats=D.voted_formats(texts, "us")).select("o_orderkey", "us")


REPLICATES = 24


@on("events")
def bootstrap_event_values(events: DataFrame) -> DataFrame:
    found = B.bootstrap_means(events, ["event_type"], "value", ["event_id"], REPLICATES, 0.9)
    return round6(found, "mean", "mean_low", "mean_high")


@on("events")
def bootstrap_event_fits(events: DataFrame) -> DataFrame:
    found = B.bootstrap_fits(events, "user_id", "value", ["event_type"], ["event_id"], REPLICATES, 0.9)
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("slope_low", "slope_high", "intercept_low", "intercept_high")])


@on("lineitem")
def profile_merged(lineitem: DataFrame) -> DataFrame:
    """Two halves profiled apart and merged; distinct counts only by whether the estimate is within 3 %."""
    halves = [lineitem.where(F.col("l_linenumber") % 2 == k) for k in (0, 1)]
    merged = S.state_profile(S.merge_states(*[S.profile_state(h) for h in halves]))
    exact = P.unique_counts(lineitem).withColumnRenamed("n_unique", "n_exact")
    joined = merged.join(F.broadcast(exact), "column")
    close = F.abs(F.col("n_unique") - F.col("n_exact")) <= 0.03 * F.col("n_exact")
    return joined.select("column", "n_rows", "n_nulls", "low", "high", F.round("mean", 4).alias("mean"), close.alias("close"))


@on("lineitem")
def log_recorded_twice(lineitem: DataFrame) -> DataFrame:
    """Runs recorded, some of them again: each counts once."""
    log = L.with_op_types(call_log(lineitem.where("l_orderkey % 100 < 3")))
    bucket = F.concat(F.lit("0"), (F.col("run_id").cast("long") % 5).cast("string"))
    log = log.withColumns({"run_id": bucket, "error": F.lit(None).cast("string"), "n_coerced": F.lit(None).cast("long")})
    path = scratch_path(lineitem.sparkSession, "log")
    L.record_log(log, path)
    L.record_log(log.where("run_id in ('01', '03')"), path)
    stored_log = L.read_log(lineitem.sparkSession, path)
    return stored_log.groupBy("run_id", "op").agg(F.count("*").alias("n_calls"))


ORDER_SCHEMA = "o_orderkey long, o_custkey long, o_totalprice double, o_comment string"


def _broken(orders: DataFrame) -> str:
    """A CSV file of orders, some lines with a cell too many, one too few, or a price that is no number."""
    key = F.col("o_orderkey")
    cells = [key.cast("string"), F.col("o_custkey").cast("string"), F.format_string("%.2f", F.col("o_totalprice").cast("double"))]
    text = F.lit('"a, b"')
    line = (
        F.when(key % 50 == 7, F.concat_ws(",", *cells, text, F.lit("more")))
        .when(key % 50 == 13, F.concat_ws(",", *cells))
        .when(key % 50 == 21, F.concat_ws(",", *cells[:2], F.lit("dear"), text))
        .otherwise(F.concat_ws(",", *cells, text))
    )
    path = scratch_path(orders.sparkSession, "broken-csv")
    orders.select(line.alias("o_orderkey,o_custkey,o_totalprice,o_comment")).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return path


@on("orders")
def csv_quarantine_rows(orders: DataFrame) -> DataFrame:
    rows, _ = X.read_csv_checked(orders.sparkSession, _broken(orders), ORDER_SCHEMA, on_bad="quarantine")
    return rows


@on("orders")
def csv_quarantine_counts(orders: DataFrame) -> DataFrame:
    _, rejected = X.read_csv_checked(orders.sparkSession, _broken(orders), ORDER_SCHEMA, on_bad="quarantine")
    return X.rejection_counts(rejected, ORDER_SCHEMA)


def _skewed(orders: DataFrame) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    return orders.select("o_orderpriority", F.when(F.col("o_orderkey") % 40 == 3, price * 10).otherwise(price).alias("price"))


@on("orders")
def box_whiskers_orders(orders: DataFrame) -> DataFrame:
    found = R.box_whiskers(_skewed(orders), "price", ["o_orderpriority"])
    return round6(found, "q1", "median", "q3", "low_whisker", "high_whisker")


@on("orders")
def box_fliers_orders(orders: DataFrame) -> DataFrame:
    return round6(R.box_fliers(_skewed(orders), "price", ["o_orderpriority"]), "value")


QUERIES = {
    f.__name__: f
    for f in (
        readiness_evidence, readiness_affixes, datetime_votes, datetime_month_first, bootstrap_event_values, bootstrap_event_fits,
        profile_merged, log_recorded_twice, csv_quarantine_rows, csv_quarantine_counts, box_whiskers_orders, box_fliers_orders,
    )
}

_PLANTED = """
select o_orderkey as id, 'R$ ' || cast(trunc(o_totalprice) as int) || ',50' as amount, (o_custkey % 90 + 10) || ' kg' as weight,
       case when o_orderkey % 4 = 0 then o_orderpriority else 'N' || o_custkey end as note,
       cast(o_totalprice as double) * case when o_orderkey % 50 = 7 then 1000 else 1 end as price, o_orderkey % 10 as digit
from orders"""
_AFFIXES = f"""
with cells as (unpivot (select amount, weight, note from ({_PLANTED})) on amount, weight, note into name "column" value v),
pairs as (
  select "column", regexp_extract(v, '^([^0-9\\n.,+-]{{0,16}})([+-]?[0-9][0-9.,]*)([^0-9\\n]{{0,16}})$', 1) as "before",
         regexp_extract(v, '^([^0-9\\n.,+-]{{0,16}})([+-]?[0-9][0-9.,]*)([^0-9\\n]{{0,16}})$', 3) as "after", count(*) as n_affix
  from cells where regexp_matches(v, '^[^0-9\\n.,+-]{{0,16}}[+-]?[0-9][0-9.,]*[^0-9\\n]{{0,16}}$') group by all)
select "column", "before", "after", n_affix, cast(n_split as bigint) as n_split
from (select *, sum(n_affix) over (partition by "column") as n_split,
             row_number() over (partition by "column" order by n_affix desc, "before", "after") as place from pairs) where place = 1"""
_DRAWN = f"""
weights as (
  select *, case {" ".join(f"when number < {b} then {k}" for k, b in enumerate(B.BOUNDS))} else {B.MOST} end as w
  from (select e.*, g * 4 + q as replicate, ('0x' || substr(md5('0:' || event_id || ':' || g), cast(q * 8 + 1 as int), 8))::bigint as number
        from events e, range({REPLICATES // 4}) a(g), range(4) b(q)) where value is not null)"""
_BOXES = """
with skewed as (select o_orderpriority, cast(o_totalprice as double) * case when o_orderkey % 40 = 3 then 10 else 1 end as price from orders),
boxes as (select o_orderpriority, count(price) as n, quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.5) as median,
                 quantile_cont(price, 0.75) as q3 from skewed group by 1),
fenced as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from skewed join boxes using (o_orderpriority) where price is not null)"""

SQL = {
    "readiness_affixes": _AFFIXES,
    "readiness_evidence": f"""
        with planted as ({_PLANTED}), affixes as ({_AFFIXES}),
        odd as (select count(*) as n, count(*) filter (where price < q1 - 1.5 * (q3 - q1) or price > q3 + 1.5 * (q3 - q1)) as k
                from planted, (select quantile_cont(price, 0.25) as q1, quantile_cont(price, 0.75) as q3 from planted)),
        notes as (select count(distinct note) <= least(50.0, 0.6 * count(note)) as few from planted)
        select 'id' as "column", 'low' as severity, 'drop_column' as actions, '' as evidence from odd
        union all select 'amount', 'high', 'replace_substring,convert_dtype', '''R$ '' stands around the numbers of ' || n || ' values.' from odd
        union all select 'weight', 'high', 'replace_substring,convert_dtype', ''' kg'' stands around the numbers of ' || n || ' values.' from odd
        union all select 'note', case when few then 'medium' else 'no problem' end, case when few then 'encode_categorical' else '' end, '' from notes
        union all select 'price', case when k >= 0.05 * n then 'medium' when k > 0 then 'low' else 'no problem' end,
                         case when k > 0 then 'modify_numeric_col' else '' end,
                         case when k > 0 then k || ' of ' || n || ' values lie beyond 1.5 interquartile ranges.' else '' end from odd
        union all select 'digit', 'no problem', '', '' from odd""",
    "datetime_votes": """
        with t as (select day(o_orderdate) <= 12 as low, day(o_orderdate) <> month(o_orderdate) as differs,
                          o_orderkey % 40 <> 3 as has, o_orderkey % 30 = 5 as soon from orders)
        select 'us' as "column", count(*) filter (where has) as n_cells, count(*) filter (where has and low) as n_day_first,
               count(*) filter (where has) as n_month_first, count(*) filter (where has and low and differs) as n_ambiguous,
               cast(0 as bigint) as n_neither, case when bool_and(low or not has) then 'day_first' else 'month_first' end as chosen from t
        union all
        select 'eu', count(*), count(*), count(*) filter (where low), count(*) filter (where low and differs), 0, 'day_first' from t
        union all
        select 'iso', count(*), count(*) filter (where not soon), count(*) filter (where not soon), 0, count(*) filter (where soon), 'day_first' from t""",
    "datetime_month_first": "select o_orderkey, case when o_orderkey % 40 <> 3 then cast(o_orderdate as timestamp) end as us from orders",
    "bootstrap_event_values": f"""
        with {_DRAWN}, replicas as (select event_type, replicate, sum(value * w) / sum(w) as m from weights where w > 0 group by 1, 2)
        select e.event_type, n, round(mean, 6) as mean, round(quantile_cont(m, 0.05), 6) as mean_low, round(quantile_cont(m, 0.95), 6) as mean_high
        from (select event_type, count(value) as n, avg(value) as mean from events where value is not null group by 1) e join replicas using (event_type)
        group by all""",
    "bootstrap_event_fits": f"""
        with {_DRAWN}, sums as (
          select event_type, replicate, sum(w) as w, sum(w * user_id::double) as wx, sum(w * value) as wy, sum(w * user_id::double * user_id) as wxx,
                 sum(w * user_id::double * value) as wxy from weights where w > 0 and user_id is not null group by 1, 2),
        fits as (select *, (w * wxy - wx * wy) / nullif(w * wxx - wx * wx, 0) as slope from sums)
        select event_type, n, round(quantile_cont(slope, 0.05), 6) as slope_low, round(quantile_cont(slope, 0.95), 6) as slope_high,
               round(quantile_cont((wy - slope * wx) / w, 0.05), 6) as intercept_low, round(quantile_cont((wy - slope * wx) / w, 0.95), 6) as intercept_high
        from fits join (select event_type, count(*) as n from events where value is not null and user_id is not null group by 1) using (event_type)
        group by all""",
    "profile_merged": " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as n_nulls, {f"min({c})::double" if n else "null::double"} as low,
            {f"max({c})::double" if n else "null::double"} as high, {f"round(sum({c}::double) / count({c}), 4)" if n else "null::double"} as mean,
            true as "close" from lineitem"""
        for c, n in (
            ("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True), ("l_linenumber", True), ("l_quantity", True), ("l_extendedprice", True),
            ("l_discount", True), ("l_tax", True), ("l_returnflag", False), ("l_linestatus", False), ("l_shipdate", False),
        )
    ),
    "log_recorded_twice": f"""
        select '0' || (run_id::bigint % 5) as run_id, op, count(*) as n_calls from ({CALL_LOG}) where run_id::bigint % 100 < 3 group by all""",
    "csv_quarantine_rows": """
        select o_orderkey, o_custkey, round(cast(o_totalprice as double), 2) as o_totalprice, 'a, b' as o_comment
        from orders where o_orderkey % 50 not in (7, 13, 21)""",
    "csv_quarantine_counts": """
        select case o_orderkey % 50 when 7 then 'surplus cells' when 13 then 'missing cells' else 'other type' end as reason, count(*) as n
        from orders where o_orderkey % 50 in (7, 13, 21) group by 1""",
    "box_whiskers_orders": f"""{_BOXES}
        select o_orderpriority, n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
               round(min(price) filter (where price between lo and hi), 6) as low_whisker,
               round(max(price) filter (where price between lo and hi), 6) as high_whisker,
               count(*) filter (where price < lo or price > hi) as n_fliers from fenced group by all""",
    "box_fliers_orders": f"""{_BOXES}
        select o_orderpriority, round(price, 6) as value, case when price < lo then 'low' else 'high' end as side from fenced where price < lo or price > hi""",
}
