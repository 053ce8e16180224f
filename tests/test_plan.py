import pytest
from conftest import rows

from tidemark.operators import contracts as C
from tidemark.plans import log as L
from tidemark.plans.runner import OPERATIONS, apply_plan, fold_steps, step

SHOP_PLAN = [
    *[step("replace_substring", column=c, old_substring="'", new_substring="") for c in ("shop", "opened", "class", "special")],
    step("convert_column_to_datetime", column="opened"),
    step("map_col_values", column="class", mapping={"plain": 0, "fine": 1, "mixed": 2, "other": 3}),
    step("fill_col_na", column="area", fill_value=45),
    step("fill_col_na", column="special", fill_value="unknown"),
    step("map_col_values", column="special", mapping={"yes": 1, "no": 0, "unknown": 2}),
    step("rename_column", column="area", new_column="floor_area"),
]

SHOP_CONTRACT = C.TableContract(
    dtypes={
        "area": "numeric", "class": "numeric", "special": "numeric", "opened": "datetime",
        "sales": "numeric", "tables": "numeric", "shop": "string",
    },
    not_all_null=("area", "special"),
    no_nulls=("area", "special"),
    cardinality={"special": 3, "class": 4},
    ranges={"area": (43, 62), "tables": (4, 7)},
)


def test_shop_plan_meets_its_contract(shops):
    before = C.check_contract(shops, SHOP_CONTRACT).first().asDict()
    assert not before["opened_dtype_is_datetime"] and not before["area_has_no_nulls"]
    done = apply_plan(shops, SHOP_PLAN)
    assert done.df.columns == [
        "shop", "opened", "class", "floor_area", "sales", "tables", "special", "imputed_area", "imputed_special",
    ]
    assert done.frozen == {"imputed_area", "imputed_special"}
    assert done.lineage == {"area": "floor_area"}
    after = C.check_contract(done.df, SHOP_CONTRACT, done.lineage).first().asDict()
    assert all(after.values()), after
    assert rows(C.contract_met(done.df, SHOP_CONTRACT, done.lineage)) == [(True,)]
    assert [r["success"] for r in done.log.collect()] == [True] * len(SHOP_PLAN)


def test_failures_leave_the_table_and_are_logged(shops):
    steps = [
        step("drop_column", column="nope"),
        step("convert_column_to_int", column="shop"),
        step("sum_value", column="shop", value=1),
        step("no_such_operation", column="shop"),
        step("fill_col_na", column="area"),  # an argument is absent
        step("fill_col_na", column="area", fill_value=1),
        step("drop_column", column="imputed_area"),
        step("rename_column", column="sales", new_column="SHOP"),
    ]
    done = apply_plan(shops, steps, run_id="r1")
    log = {r["step_no"]: r for r in done.log.collect()}
    assert [log[i]["success"] for i in range(1, 9)] == [False] * 5 + [True] + [False] * 2
    assert "7 cells" in log[2]["error"] and log[4]["op_type"] is None
    assert log[2]["column"] == "shop" and log[6]["args"] == {"column": "area", "fill_value": "1"}
    assert done.df.columns == [*shops.columns, "imputed_area"]
    assert rows(done.df.drop("imputed_area", "area")) == rows(shops.drop("area"))


def test_conversions_that_rest_on_a_failed_one(spark):
    df = spark.createDataFrame([("1", "x", "3"), ("2", "y", "4")], "a string, b string, c string")
    steps = [
        step("convert_column_to_int", column="b"),  # fails
        step("convert_column_to_int", column="a"),
        step("sum_cols", first_col="a", second_col="b", new_col_name="s"),  # fails with it
        step("rename_column", column="c", new_column="s"),  # so this name is free
        step("convert_column_to_int", column="s"),
        step("sum_cols", first_col="a", second_col="s", new_col_name="total"),
    ]
    done = apply_plan(df, steps)
    assert [r["success"] for r in done.log.orderBy("step_no").collect()] == [False, True, False, True, True, True]
    assert rows(done.df.select("a", "b", "s", "total")) == [(1, "x", 3, 4), (2, "y", 4, 6)]


def test_chained_conversions(spark):
    df = spark.createDataFrame([("1.5",), ("2.0",), (None,)], "t string")
    plan = [
        step("convert_column_to_int", column="t"),  # "1.5" is no whole number
        step("convert_column_to_float", column="t"),
        step("convert_column_to_int", column="t"),
    ]
    done = apply_plan(df, plan)
    assert [r["success"] for r in done.log.orderBy("step_no").collect()] == [False, True, True]
    assert rows(done.df) == [(1,), (2,), (None,)]
    strict = apply_plan(df, plan, strict=True)
    assert [r["success"] for r in strict.log.orderBy("step_no").collect()] == [False, True, False]


def test_coerced_dates_are_counted(spark):
    df = spark.createDataFrame([("01/02/2024",), ("soon",), (None,)], "d string")
    done = apply_plan(df, [step("convert_column_to_datetime", column="d")])
    assert done.log.first()["n_coerced"] == 1 and done.log.first()["success"]
    iso = apply_plan(df, [step("convert_column_to_datetime", column="d", formats=["yyyy-MM-dd"])])
    assert iso.log.first()["n_coerced"] == 2


def test_lineage_of_chains(shops):
    steps = [
        step("rename_column", column="shop", new_column="b"),
        step("rename_column", column="b", new_column="sales"),  # taken, so it fails
        step("rename_column", column="b", new_column="c"),
        step("rename_column", column="sales", new_column="b"),
    ]
    done = apply_plan(shops, steps)
    assert done.lineage == {"shop": "c", "sales": "b"}
    assert rows(done.lineage_table("r")) == [("r", "sales", "b"), ("r", "shop", "c")]


def test_queries_in_a_plan(shops):
    steps = [
        step("get_n_cols"),
        step("get_cols_names"),
        step("has_nulls", column="area"),
        step("get_unique_counts", column="class"),
        step("get_column_type", column="sales"),
        step("get_col_unique", column="special"),
        step("has_nulls", column="nope"),
        step("convert_column_to_int", column="sales"),
        step("get_n_cols"),
    ]
    done = apply_plan(shops, steps)
    assert done.answers[1] == 7 and done.answers[9] == 7
    assert done.answers[2] == shops.columns and done.answers[5] == "int"
    assert rows(done.answers[3]) == [(True,)] and rows(done.answers[4]) == [("class", 4)]
    assert len(rows(done.answers[6])) == 3
    assert [r["success"] for r in done.log.orderBy("step_no").collect()] == [True] * 6 + [False] + [True] * 2


def test_second_fill_in_a_plan(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    steps = [
        step("fill_col_na", column="v", fill_value=5),
        step("map_col_values", column="v", mapping={5: 6}),  # 1 becomes missing
        step("fill_col_na", column="v", fill_value=0),
    ]
    done = apply_plan(df, steps)
    assert rows(done.df) == [(0, True), (6, True)]


def test_plan_is_one_projection(spark):
    df = spark.range(10).selectExpr("id as a", "id as b")
    steps = [step("sum_value", column="a", value=1) for _ in range(20)]
    text = fold_steps(df, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Project") == 1
    with pytest.raises(ValueError, match="Step 1"):
        fold_steps(df, [step("drop_column", column="nope")])


@pytest.fixture(scope="module")
def log(spark):
    data = [
        ("r1", 1, "has_nulls", "query", None, {"column": "a"}, True, None, None),
        ("r1", 2, "drop_column", "drop_col", "a", {"column": "a"}, False, "no", None),
        ("r1", 3, "drop_column", "drop_col", "b", {"column": "b"}, True, None, None),
        ("r2", 1, "drop_column", "drop_col", "b", {"column": "b"}, True, None, None),
        ("r2", 2, "dummy_tool", "query", None, {}, True, None, None),
    ]
    from tidemark.plans.runner import LOG_SCHEMA

    return spark.createDataFrame(data, LOG_SCHEMA)


def test_log_counts(log):
    assert rows(L.calls_per_op(log)) == [("drop_column", 3), ("dummy_tool", 1), ("has_nulls", 1)]
    assert rows(L.call_totals(log)) == [(5, 3)]
    assert rows(L.call_totals(log.limit(0))) == [(0, 0)]
    rates = {r["op"]: (r["n_success"], r["success_pct"]) for r in L.success_rates(log).collect()}
    assert rates == {"drop_column": (2, 66.67), "dummy_tool": (1, 100.0), "has_nulls": (1, 100.0)}


def test_log_histories(log):
    by_op = [(r["op"], r["run_id"], r["step_no"]) for r in L.history_by_op(log).collect()]
    assert by_op == sorted(by_op) and len(by_op) == 5
    by_column = [(r["column"], r["run_id"], r["op"]) for r in L.history_by_column(log).collect()]
    assert by_column == [("b", "r1", "drop_column"), ("b", "r2", "drop_column")]


def test_log_ids(spark, log, tmp_path):
    from tidemark.sources.files import read_tool_map

    path = tmp_path / "tools.csv"
    path.write_text("tool_id,name,n_args,is_query\n1,dummy,0,TRUE\n4,has_nulls,1,TRUE\n9,drop_column,1,FALSE\n")
    flat = L.attach_ids(log, read_tool_map(spark, str(path)))
    assert flat.count() == 5
    assert rows(flat.where("op = 'drop_column'").select("tool_id").distinct()) == [(9,)]
    assert rows(L.unmatched_ops(flat)) == [("dummy_tool", 1)]


def test_log_is_appended(spark, log, tmp_path):
    L.append_log(log, str(tmp_path / "log"))
    L.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10


def test_operation_types(log):
    kinds = {o.op_type for o in OPERATIONS.values()}
    assert kinds == {"query", "create_col", "drop_col", "transform_col"}
    typed = L.with_op_types(log.select("op"))
    assert rows(typed.distinct()) == [("drop_column", "drop_col"), ("dummy_tool", None), ("has_nulls", "query")]


def test_overflow_is_contained(spark):
    df = spark.createDataFrame([(2**63 - 1, 2), (5, 3)], "a long, b long")
    steps = [
        step("sum_value", column="a", value=1),
        step("multiply_cols", first_col="a", second_col="b", new_col_name="c"),
        step("sum_cols", first_col="b", second_col="b", new_col_name="d"),
        step("sum_value", column="d", value=2**63 - 10),
    ]
    done = apply_plan(df, steps)
    log = {r["step_no"]: r for r in done.log.collect()}
    assert [log[i]["success"] for i in range(1, 5)] == [False, False, True, True]
    assert "exceeds" in log[1]["error"]
    assert set(rows(done.df)) == {(5, 3, 2**63 - 4), (2**63 - 1, 2, 2**63 - 6)}
