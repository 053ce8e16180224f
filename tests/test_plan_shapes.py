"""What the plans must and must not contain, as these decide how they scale."""

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.joins import lookup_join
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import contracts as C, profile as P, quality as Q, screening as S
from workload import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not there")


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def tree_of(df):
    return plan_of(df).split("\n\n\n")[0]


def read_columns(df):
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*)>", plan_of(df)))))


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_and_no_cross_join(spark, name):
    tree = tree_of(all_queries()[name](spark, SF_DIR))
    assert not re.search(r"Python|Pandas|Cartesian|BroadcastNestedLoop", tree), tree


def test_scans_read_only_what_is_asked(lineitem):
    assert read_columns(Q.duplicate_rows(lineitem, ["l_orderkey", "l_linenumber"])) == {"l_orderkey", "l_linenumber"}
    assert read_columns(Q.top_values(lineitem, "l_returnflag")) == {"l_returnflag"}
    own = {c for c in read_columns(Q.iqr_outliers(lineitem, ["l_tax"])) if not c.startswith("__")}  # not stored brackets
    assert own == {"l_tax"}
    assert read_columns(P.has_nulls(lineitem, "l_partkey")) == {"l_partkey"}
    contract = C.TableContract(dtypes={"l_tax": "numeric"}, ranges={"l_quantity": (0, 1)})
    assert read_columns(C.check_contract(lineitem, contract)) == {"l_quantity"}


def test_families_read_every_column_once(lineitem):
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan_of(P.column_counts(lineitem)))
    read = [c for s in schemas for c in re.findall(r"(\w+):", s)]
    assert sorted(read) == sorted(lineitem.columns)


def test_filters_reach_the_files(lineitem):
    assert "PushedFilters: [IsNull(l_partkey)]" in plan_of(P.has_nulls(lineitem, "l_partkey"))


def test_rows_are_counted_before_the_shuffle(lineitem):
    tree = tree_of(P.column_counts(lineitem, ["l_returnflag", "l_linestatus"]))
    assert tree.count("Exchange") == 2 and tree.count("HashAggregate") == 4 and "Expand" in tree


def test_top_values_keep_few_rows_per_task(lineitem):
    assert "TakeOrderedAndProject" in tree_of(Q.top_values(lineitem, "l_shipdate"))
    assert tree_of(Q.top_values_all(lineitem)).count("WindowGroupLimit") >= 2


def test_screening_and_steps_shuffle_nothing(spark, documents):
    assert "Exchange" not in tree_of(S.screen_table(documents, "text"))
    for name in ("to_datetime", "to_int", "col_col_ops", "map_priority", "sanitize_docs", "run_accuracy"):
        assert "Exchange" not in tree_of(all_queries()[name](spark, SF_DIR))


def test_quantiles_do_not_shuffle_the_table(lineitem):
    """Every exchange lies above a partial aggregation, and no sketch is merged in one task."""
    df = exact_quantiles(lineitem, ["l_returnflag"], F.col("l_extendedprice"), [0.5], few_groups=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for before, after in zip(plan.splitlines(), plan.splitlines()[1:]):
        if " Exchange hash" in before:
            assert re.search(r"HashAggregate|ObjectHashAggregate|Project|Window", after), after
    assert "percentile" not in plan


def test_cardinalities_are_counted_without_copying_rows(lineitem):
    contract = C.TableContract(cardinality={"l_returnflag": 3, "l_linestatus": 2}, ranges={"l_quantity": (0, 1)})
    plan = plan_of(C.check_contract(lineitem, contract))
    direct = [s for s in re.findall(r"ReadSchema: struct<(.*)>", plan) if "l_quantity" in s]
    assert direct == ["l_quantity:double"]
    assert "count(distinct" not in plan.replace("DISTINCT", "distinct")


def test_texts_are_ranked_by_digest(documents):
    """No exchange carries the text itself but for the few that rank."""
    plan = Q.top_values(documents, "text", 5)._jdf.queryExecution().executedPlan().toString()
    before = [after for line, after in zip(plan.splitlines(), plan.splitlines()[1:]) if "Exchange hash" in line]
    assert before and all("sha2" not in x or "key" in x for x in before)
    top = Q.top_values(documents, "text", 5).collect()
    counts = documents.groupBy("text").count().orderBy(F.desc("count"), "text").limit(5).collect()
    assert [(r.value, r.n) for r in top] == [tuple(r) for r in counts]


def test_large_lookup_is_not_broadcast(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    assert "BroadcastHashJoin" in tree_of(lookup_join(left, right, ["k"]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in tree_of(lookup_join(left, right, ["k"], small=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
