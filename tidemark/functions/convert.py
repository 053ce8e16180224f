"""Conversions of cells to whole numbers, floats and timestamps that yield NULL when impossible."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

from tidemark.functions.cells import is_float

# Accepted date layouts, day first. The first layout that fits a cell wins.
DATE_FORMATS = (
    "d/M/yyyy",
    "d/M/yyyy HH:mm",
    "d/M/yyyy HH:mm:ss",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy-M-d HH:mm",
    "yyyy-M-d HH:mm:ss",
    "yyyy-M-d HH:mm:ss.SSSSSS",
    "yyyy-M-d'T'HH:mm:ss",
    "yyyy-M-d'T'HH:mm:ss.SSSSSS",
)

INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"


def _ungrouped(text: Column) -> Column:
    """Lower case, outer blanks and digit-group underscores (`1_000`) removed."""
    return F.regexp_replace(F.lower(F.trim(text)), "(?<=[0-9])_(?=[0-9])", "")


def to_int(value: Column, dtype: T.DataType) -> Column:
    """Whole number or NULL. Text such as `5.0` is no whole number; a float loses its fraction."""
    if not isinstance(dtype, T.StringType):
        return value.try_cast("long")
    # The pattern comes first: a failing cast raises and catches an error for every such cell.
    digits = F.when(F.contains(value, F.lit("_")), _ungrouped(value)).otherwise(value)
    return F.when(value.rlike(INT_TEXT), digits.try_cast("long"))


def to_float(value: Column, dtype: T.DataType) -> Column:
    """Float or NULL; `nan` reads as missing."""
    number = value.try_cast("double")
    if isinstance(dtype, T.StringType):
        # A cast would also take the suffixes d and f and hexadecimal digits.
        text = _ungrouped(value)
        checked = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
        number = F.when(value.rlike("[_dDfFxX]"), checked).otherwise(number)
    return F.nanvl(number, F.lit(None).cast("double"))


def spells_nan(value: Column, dtype: T.DataType) -> Column:
    """Cells that hold a missing number in some spelling and so convert to NULL rightly."""
    if isinstance(dtype, T.StringType):
        return F.lower(F.trim(value)).rlike("^[+-]?nan$")
    if is_float(dtype):
        return F.isnan(value)
    return F.lit(False)


def _digits(letters: re.Match) -> str:
    count = len(letters.group())
    return "[0-9]{1,2}" if count == 1 else f"[0-9]{{{count}}}"


def _layout(fmt: str) -> str:
    """A pattern for the cells a date layout can fit, so that others are never parsed."""
    plain_and_quoted = [re.escape(part) for part in fmt.split("'")]
    plain_and_quoted[::2] = [re.sub(r"([A-Za-z])\1*", _digits, part) for part in plain_and_quoted[::2]]
    return "^" + "".join(plain_and_quoted) + "$"


def layout_signs(formats: Sequence[str]) -> str:
    """A pattern that every text fits which one of the layouts fits, quotes and blanks apart. It fails at the first other sign."""
    signs = set()
    for fmt in formats:
        parts = fmt.split("'")
        signs.update(re.sub("[A-Za-z]", "", "".join(parts[::2])), "".join(parts[1::2]))
    listed = "".join(re.escape(c) for c in sorted(signs - {" "}))
    return f"""^[0-9 '"{listed}]*$"""


def _parse(text: Column, fmt: str) -> Column:
    """A wall-clock time. Parsing at offset zero keeps it free of the session's time zone."""
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.lit(fmt + " XXX"))
    since_epoch = F.expr("interval '0.000001' second") * F.unix_micros(instant)
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since_epoch


def to_datetime(value: Column, dtype: T.DataType, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp without zone, or NULL where no layout fits."""
    if not isinstance(dtype, T.StringType):
        return value.cast("timestamp_ntz")
    text = F.trim(value)
    return F.coalesce(*[F.when(text.rlike(_layout(f)), _parse(text, f)) for f in formats])


def fits_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The cell reads as a date in one of the layouts."""
    return to_datetime(text, T.StringType(), formats).isNotNull()
