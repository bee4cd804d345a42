"""A pipeline whose operators apply in call order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import nulls_last
from ..types import RID, Schema, check_row, spark_schema
from .ranking import MOST, first_rows


class Query:
    """Each call gives a new query. Columns are known by place, so that a projection may repeat them; hidden columns
    keep the order of rows, in which ties of a sort and the rows under a limit come.
    """

    def __init__(self, df: DataFrame, names: Sequence[str], ties: Sequence[str], leading: Callable[[int], DataFrame] | None = None):
        """leading: gives a part of df that holds its first n rows, so that a limit at once reads no more."""
        self._names, self._leading = list(names), leading
        #: (hidden column, whether falling), the first leads
        self._order = [(t, False) for t in ties]
        self._df = self._laid_out(df)

    def _laid_out(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(self._names)], *[h for h, _ in self._order])

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[Sequence], schema: Schema) -> Query:
        """Rows from memory, in their order; ValueError for a row that does not fit."""
        checked = [(*check_row(schema, r), k) for k, r in enumerate(rows)]
        return cls(spark.createDataFrame(checked, spark_schema(schema, rid=True)), [c.name for c in schema], [RID])

    @property
    def column_count(self) -> int:
        return len(self._names)

    def column(self, place: int) -> Column:
        """The column at a place, for filters and sorts."""
        if not 0 <= place < len(self._names):
            raise IndexError(f"no column {place}")
        return F.col(f"c{place}")

    def _with(self, df: DataFrame, names=None, order=None) -> Query:
        new = object.__new__(Query)
        new._df, new._names, new._order, new._leading = df, self._names if names is None else names, order or self._order, None
        return new

    def filter(self, test: Column | Callable[[tuple], bool]) -> Query:
        """Keeps rows where `test` is true. A Python callable gets the row as a tuple and runs outside the JVM."""
        if test is None:
            raise ValueError("a filter needs a test")
        if not isinstance(test, Column):
            run = F.udf(lambda row, f=test: bool(f(tuple(row))), T.BooleanType())
            test = run(F.struct(*[F.col(f"c{i}") for i in range(len(self._names))]))
        return self._with(self._df.where(test))

    def sort(self, *keys: Column, descending: bool | Sequence[bool] = False) -> Query:
        """Orders by the keys, nulls last; ties stay in the order they had. The keys outlive projections as hidden columns."""
        if not keys:
            raise ValueError("a sort needs a key")
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise ValueError("one direction per key")
        held = [f"_s{len(self._order) + i}" for i in range(len(keys))]
        df = self._df.select("*", *[k.alias(h) for k, h in zip(keys, held)])
        return self._with(df, order=[*zip(held, down), *self._order])

    def project(self, places: Sequence[int]) -> Query:
        """The columns at these places: in any order, repeated, or none."""
        kept = [self.column(p).alias(f"c{i}") for i, p in enumerate(places)]
        return self._with(self._df.select(*kept, *[h for h, _ in self._order]), names=[self._names[p] for p in places])

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("a limit is not negative")
        df = self._df if self._leading is None else self._laid_out(self._leading(n))
        return self._with(first_rows(df, self._keys(), n, MOST))

    def _keys(self) -> list[Column]:
        return [nulls_last(F.col(h), down) for h, down in self._order]

    def _ordered(self) -> DataFrame:
        return self._df.orderBy(*self._keys())

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self._names)])

    @property
    def df(self) -> DataFrame:
        """The result under its own names, of which some may be equal; sorted only if a sort was asked for."""
        return self._shown(self._ordered() if any(h.startswith("_s") for h, _ in self._order) else self._df)

    def rows(self) -> Iterator[Row]:
        return self._shown(self._ordered()).toLocalIterator()

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.rows()]
