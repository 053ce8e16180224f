"""Column steps on a stream.

Steps are row-wise projections, so a stream takes them as a table does. Only the check of a
whole column before a conversion is impossible: a stream's conversion to a number yields
NULL where a cell does not convert, and `conversion_failures` marks such cells. Whole-number
arithmetic likewise yields NULL beyond its type, and `overflows` marks those.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from tidemark.plans.runner import QUERY, OPERATIONS, Step, fold_steps


def transform_stream(stream: DataFrame, steps: Sequence[Step], frozen: Iterable[str] = ()) -> DataFrame:
    """The stream after the steps; a step that cannot be built raises before the query starts."""
    for one in steps:
        if one.op in OPERATIONS and OPERATIONS[one.op].op_type == QUERY:
            raise ValueError(f"'{one.op}' asks about a whole table and has no answer on a stream.")
    return fold_steps(stream, steps, frozen)
