"""A value that an expression names many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value); value is computed once a row, also where f names it often or within functions of arrays and maps."""
    return F.element_at(F.transform(F.array(value), f), 1)
