"""From a bound plan to a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import condition, nulls_last
from ..operators.ranking import MOST, first_rows
from .planner import BoundPlan


def lower(plan: BoundPlan, base: DataFrame, index: DataFrame | None, ties: list[str], in_order: bool = False, most: int = MOST,
          hidden: bool = False) -> DataFrame:
    """Filters, order, output columns, limit.

    base: the table with its hidden columns; index: the index's sorted copy of it, if there is one. `ties` are hidden
    columns that give the rows' own order. Ties of an ordered result, and rows under a LIMIT alone, come in it:
    by `ties` for scans and lookups, by key and `ties` for ranges. in_order asks for it without either. hidden: with the
    hidden columns, for an order that is still to come.
    """
    a = plan.access
    if plan.empty:
        return base.limit(0) if hidden else _shown(plan, base.limit(0))
    df = index if index is not None and a is not None else base
    if a is not None:
        key = F.col(a.column)
        if a.lookup:
            df = df.where(key == a.key)
        else:
            if a.lower is not None:
                df = df.where(key >= a.lower)
            if a.upper is not None:
                df = df.where(key <= a.upper)
    for p in plan.predicates:
        df = df.where(condition(p))
    order = order_of(plan, ties)
    if plan.limit is not None:
        df = first_rows(df, order, plan.limit, most)
    elif plan.order is not None or in_order:
        df = df.orderBy(*order)
    return df if hidden else _shown(plan, df)


def order_of(plan: BoundPlan, ties: list[str], by: Sequence[str] = ()) -> list[Column]:
    """The whole order of a plan's rows, without ties; rows that its own leaves tied go by the columns `by` first."""
    rest = [F.col(t) for t in ties]
    if plan.access is not None and not plan.access.lookup:
        rest = [F.col(plan.access.column)] + rest
    rest = [nulls_last(F.col(c)) for c in by if plan.order is None or c != plan.order.name] + rest
    if plan.order is None:
        return rest
    first = nulls_last(F.col(plan.order.name), plan.descending)
    return [first, *[c for c in rest if str(c) != str(F.col(plan.order.name))]]


def _shown(plan: BoundPlan, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c.name) for c in plan.output])
