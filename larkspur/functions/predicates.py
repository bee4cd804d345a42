"""Predicates and orders as Spark expressions."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def condition(p) -> Column:
    """A bound predicate; a comparison with NULL on either side is never true."""
    c = F.col(p.column.name)
    if p.op == "is null":
        return c.isNull()
    if p.op == "is not null":
        return c.isNotNull()
    if p.literal is None:
        return F.lit(False)
    return _OPS[p.op](c, F.lit(p.literal))


def nulls_last(c: Column, descending: bool = False) -> Column:
    return c.desc_nulls_last() if descending else c.asc_nulls_last()
