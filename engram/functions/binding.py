"""Evaluate an expression once: inside one row, or before filters on its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable.

    An outer expression named inside a higher-order function is evaluated again for every element, and a
    preceding projection does not help, because the optimizer inlines it. A bound variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as column ``name`` that is evaluated here and nowhere else.

    A filter on a plain alias is pushed below the projection and evaluates the expression a second time, even below a repartition.
    A generated column stops it. (``explode`` itself infers such a filter, so lists made from costly expressions
    are opened with ``explode_outer``, too.)
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
