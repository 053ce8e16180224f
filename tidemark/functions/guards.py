"""Checks on the schema, made before any plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidemark.functions.cells import is_numeric, type_of


def require_column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"Column '{name}' is not in the table.")


def require_new(df: DataFrame, name: str, besides: Iterable[str] = ()) -> None:
    """Spark resolves names without case, so `a` is taken when the table has `A`."""
    taken = {c.lower() for c in df.columns} - {c.lower() for c in besides}
    if name.lower() in taken:
        raise ValueError(f"Column '{name}' already exists in the table.")


def require_unfrozen(name: str, frozen: Iterable[str]) -> None:
    if name in frozen:
        raise ValueError(f"Column '{name}' is frozen and must not change.")


def require_numeric(df: DataFrame, *names: str) -> None:
    for name in names:
        if not is_numeric(type_of(df, name)):
            raise ValueError(f"Column '{name}' is {type_of(df, name).simpleString()}, not numeric.")


def require_editable(df: DataFrame, name: str, frozen: Iterable[str]) -> None:
    require_column(df, name)
    require_unfrozen(name, frozen)
