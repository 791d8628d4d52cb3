"""Binding a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row.

    Without it the optimizer may copy the value's expression into each use, even
    into the body of a higher-order function, where it would run for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
