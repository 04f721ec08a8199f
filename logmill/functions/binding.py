"""Evaluate a sub-expression once and use it many times inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body(*values)`` with every value computed once per row.

    Expressions inside lambdas are evaluated anew for every element; a bound value is not.
    """
    names = [f"v{i}" for i in range(len(values))]
    bound = F.array(F.struct(*(v.alias(n) for v, n in zip(values, names))))
    return F.get(F.transform(bound, lambda s: body(*(s.getField(n) for n in names))), F.lit(0))
