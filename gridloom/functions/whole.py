"""Exact arithmetic of whole numbers.

The operands meet in the widest of their types, int at least. A result that its type
does not hold, and a division by zero, are errors, whatever the session's
settings. Quotients are floored, and remainders have the divisor's sign.
"""

from __future__ import annotations

import numbers
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From narrow to wide.
TYPES = ("tinyint", "smallint", "int", "bigint")
_NAMES = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}


def type_of(name: str) -> str | None:
    """The usual name of a whole type; None for others."""
    name = _NAMES.get(name, name)
    return name if name in TYPES else None


def literal_type(value: object) -> str | None:
    """int or bigint for a whole number that it holds; None for other values."""
    if isinstance(value, bool) or not isinstance(value, numbers.Integral):
        return None
    return "int" if -(2**31) <= value < 2**31 else "bigint" if -(2**63) <= value < 2**63 else None


def promoted(*types: str | None) -> str | None:
    """The type that operands of these types meet in; None if one is not whole."""
    if any(t is None for t in types):
        return None
    return TYPES[max(2, *map(TYPES.index, types))]


def _checked(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"a {what} is beyond its type")))


def _divisor(b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division of a whole number by zero"))).otherwise(b)


def modulo(a: Column, b: Column) -> Column:
    rest = F.when(b == -1, F.lit(0)).otherwise(a % _divisor(b))
    return rest + F.when((rest != 0) & ((rest < 0) != (b < 0)), b).otherwise(F.lit(0))


def integer_divide(a: Column, b: Column) -> Column:
    by = _divisor(b)
    floored = F.call_function("div", a, by) - F.when((a % by != 0) & ((a < 0) != (b < 0)), F.lit(1)).otherwise(F.lit(0))
    return F.when(b == -1, _checked(F.try_subtract(F.lit(0), a), "quotient")).otherwise(floored)


EXACT: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: _checked(F.try_add(a, b), "sum"),
    "subtract": lambda a, b: _checked(F.try_subtract(a, b), "difference"),
    "multiply": lambda a, b: _checked(F.try_multiply(a, b), "product"),
    "modulo": modulo,
    "integer_divide": integer_divide,
}
