"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Union[str, Column]


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]
