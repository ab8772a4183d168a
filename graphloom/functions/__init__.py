"""Column expressions; all of them stay on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: Column | str) -> Column:
    """NULL for missing, empty or whitespace-only text."""
    value = as_column(value)
    return F.when(F.length(F.regexp_replace(value, r"\s", "")) > 0, value)


def first_by(*order: Column | str, **values: Column | str) -> Column:
    """Aggregate: the values of the row that sorts first.

    A grouped minimum over a struct combines map-side, so a hot key never has to be
    gathered and sorted in one task the way a row_number window would.
    """
    keys = [as_column(c).alias(f"_o{i}") for i, c in enumerate(order)]
    picked = [as_column(c).alias(n) for n, c in values.items()]
    return F.min(F.struct(*keys, *picked))
