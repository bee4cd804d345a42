"""The place of rows in a total order, and limits beyond Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark's limit takes 32 bits.
MOST = 2**31 - 1
#: Rows under a limit up to which one task numbers them.
FEW = 100_000
_SPOT = "_spot"


def dealt(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows dealt out by ranges of an order, unsorted, in the same partitions however often and whatever of them is read.

    A frame that is sorted anew on each read is not: Spark merges a shuffle's partitions by how much the columns read hold, and
    takes its bounds from a sample that differs from run to run. So the shuffle is made once here, and its files are
    read; those that get lost are made again with the same bounds. They go once nothing holds the frame.
    """
    spark, ranged = df.sparkSession, df.repartitionByRange(*order)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(ranged.queryExecution().toRdd(), ranged.schema(), False), spark)


def placed(df: DataFrame, order: Sequence[Column], name: str, n: int | None = None) -> DataFrame:
    """The rows, or the first n of them, with their place from 1 in an order without ties.

    Partitions of the dealt rows are counted, so one number of each reaches the driver and no task sees all rows. Of few rows
    under a limit each task keeps as many, so that no other is shuffled, and one task numbers them.
    """
    if n is not None and n <= FEW:
        return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    at = dealt(df, order)
    counts = {r["p"]: r["n"] for r in at.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    at = at.sortWithinPartitions(*order).withColumn(_SPOT, F.monotonically_increasing_id())
    before = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (F.shiftright(F.col(_SPOT), 33) + 1).cast("int"))
    at = at.withColumn(name, before + F.col(_SPOT).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(_SPOT)
    return at if n is None else at.where(F.col(name) <= n)


def first_rows(df: DataFrame, order: Sequence[Column], n: int, most: int = MOST) -> DataFrame:
    """The first n rows in an order without ties; beyond `most` by their place, which takes a count of the rows first."""
    if n <= most:
        return df.orderBy(*order).limit(n)
    return placed(df, order, "_place").where(F.col("_place") <= n).drop("_place")
