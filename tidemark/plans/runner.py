"""Run a declared list of column steps as one lazy plan.

Each step works on the table the step before it left. A step that fails its checks leaves
the table unchanged, is logged, and the later steps go on. Whether a conversion holds for all
rows, or whole-number arithmetic stays within its type, is only known from the data: all such
steps are assumed to hold, their failing cells are counted in one aggregation that reads only
the columns involved, and the plan is folded again without the steps that failed. A plan without
conversions and whole-number arithmetic runs no job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.cells import cell, literal_rows
from tidemark.operators import profile, transforms

QUERY, CREATE_COL, DROP_COL, TRANSFORM_COL = "query", "create_col", "drop_col", "transform_col"

LOG_SCHEMA = (
    "run_id string, step_no long, op string, op_type string, column string, "
    "args map<string,string>, success boolean, error string, n_coerced long"
)
LINEAGE_SCHEMA = "run_id string, original string, current string"

_FLAG = "__bad_"  # hidden columns that mark failing cells of a conversion


@dataclass(frozen=True)
class Operation:
    """What the runner must know of a step's operation.

    `column` names the argument that holds the touched column, `reads` those with the input
    columns, `writes` the one with the output column.
    """

    run: Callable[..., Any]
    op_type: str
    column: str | None = None
    reads: tuple[str, ...] = ("column",)
    writes: str | None = "column"
    converts_to: str | None = None
    takes_frozen: bool = True
    computes: str | None = None  # kind of arithmetic that may exceed its type


def _edit(run: Callable[..., DataFrame], converts_to: str | None = None, computes: str | None = None) -> Operation:
    # What fails is counted here, so the steps themselves make such cells missing.
    if converts_to in ("int", "float"):
        run = partial(run, on_error="null")
    if computes:
        run = partial(run, on_overflow="null")
    return Operation(run, TRANSFORM_COL, "column", converts_to=converts_to, computes=computes)


def _combine(run: Callable[..., DataFrame], computes: str | None = None) -> Operation:
    run = partial(run, on_overflow="null") if computes else run
    reads = ("first_col", "second_col")
    return Operation(run, CREATE_COL, "new_col_name", reads, "new_col_name", takes_frozen=False, computes=computes)


def _ask(run: Callable[..., Any], reads: tuple[str, ...] = ("column",)) -> Operation:
    return Operation(run, QUERY, None, reads, None, takes_frozen=False)


# The operation names that plans and logs use.
OPERATIONS: dict[str, Operation] = {
    "get_n_cols": _ask(profile.column_count, ()),
    "get_cols_names": _ask(profile.column_names, ()),
    "has_nulls": _ask(profile.has_nulls),
    "get_unique_counts": _ask(lambda df, column: profile.unique_counts(df, [column])),
    "get_column_type": _ask(profile.column_type),
    "get_col_unique": _ask(profile.unique_values),
    "replace_substring": _edit(transforms.replace_substring),
    "drop_column": Operation(transforms.drop_column, DROP_COL, "column", writes=None),
    "map_col_values": _edit(transforms.map_col_values),
    "convert_column_to_datetime": _edit(transforms.convert_column_to_datetime, "datetime"),
    "convert_column_to_float": _edit(transforms.convert_column_to_float, "float"),
    "convert_column_to_int": _edit(transforms.convert_column_to_int, "int"),
    "fill_col_na": _edit(transforms.fill_col_na),
    "rename_column": Operation(transforms.rename_column, CREATE_COL, "column", writes="new_column"),
    "subtract_value": _edit(transforms.subtract_value, computes="subtract"),
    "sum_value": _edit(transforms.sum_value, computes="sum"),
    "divide_value": _edit(transforms.divide_value),
    "multiply_value": _edit(transforms.multiply_value, computes="multiply"),
    "power_value": _edit(transforms.power_value),
    "subtract_cols": _combine(transforms.subtract_cols, "subtract"),
    "sum_cols": _combine(transforms.sum_cols, "sum"),
    "divide_cols": _combine(transforms.divide_cols),
    "multiply_cols": _combine(transforms.multiply_cols, "multiply"),
    "power_cols": _combine(transforms.power_cols),
}


@dataclass(frozen=True)
class Step:
    op: str
    args: Mapping[str, Any] = field(default_factory=dict)


def step(op: str, **args: Any) -> Step:
    return Step(op, args)


@dataclass
class PlanResult:
    df: DataFrame
    log: DataFrame
    lineage: dict[str, str]
    frozen: frozenset[str]
    answers: dict[int, Any]  # step number -> what a query step returned

    def lineage_table(self, run_id: str = "run") -> DataFrame:
        rows = [(run_id, a, b) for a, b in self.lineage.items()]
        return literal_rows(self.df.sparkSession, rows, LINEAGE_SCHEMA)


@dataclass
class _Fold:
    """The state after the steps, under the verdicts known so far."""

    work: DataFrame  # the table plus hidden flags
    frozen: set[str]
    lineage: dict[str, str] = field(default_factory=dict)
    answers: dict[int, Any] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)
    flags: dict[int, str] = field(default_factory=dict)
    # Conversions and computations not yet judged on which a column's present value rests.
    rests_on: dict[str, set[int]] = field(default_factory=dict)
    judged_on: dict[int, set[int]] = field(default_factory=dict)

    @property
    def table(self) -> DataFrame:
        return self.work.select(*[cell(c) for c in self.work.columns if not c.startswith(_FLAG)])


def _rename_in(lineage: dict[str, str], old: str, new: str) -> None:
    origin = next((o for o, current in lineage.items() if current == old), old)
    lineage[origin] = new


def _take(fold: _Fold, no: int, one: Step, verdicts: Mapping[int, int], count_cells: bool, strict: bool) -> None:
    """Apply one step to the fold, or raise."""
    operation = OPERATIONS.get(one.op)
    if operation is None:
        raise ValueError(f"There is no operation '{one.op}'.")
    args = dict(one.args)
    if operation.op_type == QUERY:
        fold.answers[no] = operation.run(fold.table, **args)
        return
    named = {**args, "frozen": frozenset(fold.frozen)} if operation.takes_frozen else args
    after = operation.run(fold.work, **named)

    target = operation.converts_to
    inputs = [args[a] for a in operation.reads]
    rests = set().union(*[fold.rests_on.get(c, set()) for c in inputs])
    if (target or operation.computes) and count_cells and no not in verdicts:
        if target:
            formats = {"formats": args["formats"]} if "formats" in args else {}
            bad = transforms.conversion_failures(fold.work, args["column"], target, strict=strict, **formats)
        else:
            second = args["second_col"] if "second_col" in args else args["value"]
            bad = transforms.overflows(fold.work, operation.computes, inputs[0], second, args.get("safe", False))
        if bad is not None:
            flag = f"{_FLAG}{no}"
            after = operation.run(fold.work.select("*", bad.alias(flag)), **named)
            fold.flags[no] = flag
            fold.judged_on[no] = set(rests)
            if target != "datetime":  # a datetime step never fails, so nothing hangs on it
                rests.add(no)
    elif target in ("int", "float") and verdicts.get(no, 0) > 0:
        raise ValueError(
            f"Column '{args['column']}' does not convert to {target}: {verdicts[no]} cells have no such value."
        )
    elif operation.computes and verdicts.get(no, 0) > 0:
        raise ValueError(f"The result of {one.op} exceeds its type in {verdicts[no]} rows.")

    if one.op == "fill_col_na":
        flag_name = transforms.imputed_flag(args["column"])
        fold.frozen.add(flag_name)
        fold.rests_on[flag_name] = fold.rests_on.get(flag_name, set()) | rests
    if one.op == "rename_column":
        _rename_in(fold.lineage, args["column"], args["new_column"])
        fold.rests_on.pop(args["column"], None)
    if operation.writes:
        fold.rests_on[args[operation.writes]] = rests
    fold.work = after


def _fold(
    df: DataFrame, steps: Sequence[Step], frozen: Iterable[str], verdicts: Mapping[int, int], count: bool, strict: bool
) -> _Fold:
    fold = _Fold(df, set(frozen))
    for no, one in enumerate(steps, 1):
        try:
            _take(fold, no, one, verdicts, count, strict)
        except (ValueError, TypeError, KeyError, PySparkException) as problem:
            fold.errors[no] = str(problem) or type(problem).__name__
    return fold


def fold_steps(df: DataFrame, steps: Sequence[Step], frozen: Iterable[str] = ()) -> DataFrame:
    """The steps as a plain projection, without jobs: any step that cannot be built raises."""
    fold = _fold(df, steps, frozen, {}, count=False, strict=False)
    if fold.errors:
        no, message = next(iter(fold.errors.items()))
        raise ValueError(f"Step {no} ({steps[no - 1].op}): {message}")
    return fold.work


def apply_plan(
    df: DataFrame,
    steps: Sequence[Step],
    run_id: str = "run",
    frozen: Iterable[str] = (),
    strict: bool = False,
) -> PlanResult:
    """Run the steps in order and log each of them.

    `strict` rejects a conversion to whole numbers of a column with missing cells.
    """
    verdicts: dict[int, int] = {}  # step number -> number of failing cells
    while True:
        fold = _fold(df, steps, frozen, verdicts, count=True, strict=strict)
        if not fold.flags:
            break
        counts = fold.work.agg(*[F.count_if(cell(f)).alias(f) for f in fold.flags.values()]).first()
        failed = {
            no for no, flag in fold.flags.items() if counts[flag] and OPERATIONS[steps[no - 1].op].converts_to != "datetime"
        }
        for no, flag in fold.flags.items():
            if not fold.judged_on[no] & failed:
                verdicts[no] = counts[flag]
    log = [
        _log_row(run_id, no, one, no not in fold.errors, fold.errors.get(no), verdicts.get(no))
        for no, one in enumerate(steps, 1)
    ]
    log_table = literal_rows(df.sparkSession, log, LOG_SCHEMA)
    return PlanResult(fold.work, log_table, fold.lineage, frozenset(fold.frozen), fold.answers)


def _text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False)


def _log_row(run_id: str, no: int, one: Step, success: bool, error: str | None, bad: int | None) -> tuple:
    operation = OPERATIONS.get(one.op)
    column = one.args.get(operation.column) if operation and operation.column else None
    is_date = bool(operation) and operation.converts_to == "datetime"
    return (
        run_id,
        no,
        one.op,
        operation.op_type if operation else None,
        column,
        {k: _text(v) for k, v in one.args.items()},
        success,
        error,
        bad if is_date and success else None,
    )
