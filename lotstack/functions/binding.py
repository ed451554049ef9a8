"""A value that is worked out once in a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value, which is worked out once however often the body uses it, inside lambdas too.

    Column expressions are trees: what is used twice stands twice, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
