"""Small expression helpers shared by every family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    A column that is referenced once, inside a higher-order function's lambda,
    gets inlined into that lambda by the optimiser and is then rebuilt on every
    element. Binding it through a one-element ``transform`` keeps it a single
    evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(kernel):
    """An Arrow function that runs once per row, however many columns read its result.

    The optimiser inlines a deterministic one into each reader of a field of its struct (rows then carry its arguments
    as often) and below filters on its result (it runs twice)."""
    return kernel.asNondeterministic()


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0.0 when ``den`` is 0 (ANSI mode raises otherwise)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def empty_array(elem: str = "string") -> Column:
    return F.array().cast(f"array<{elem}>")


def ints(c: Column) -> Column:
    return c.cast("int")
