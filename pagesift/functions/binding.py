"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it.

    Inside array functions Spark evaluates an expression where it stands, so a value
    that is used five times is computed five times. A one-element array gives it a name.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
