"""Naming a value inside an expression, so that what uses it twice computes it once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value bound to a lambda variable; trees stay small and it is computed once a row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def let_all(body: Callable[..., Column], **values: Column) -> Column:
    """The same for several values: the body gets a struct's fields by name."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: body(**{k: s[k] for k in values}))
