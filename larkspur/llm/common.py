"""What the operators share: words, cut lineage, global ranks, guarded broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that part words: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
_PARTED = r"[\x20\x09-\x0D]+"
#: Rows up to which a side of known count may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 50_000
#: Edges up to which the driver finds components (some 2 MB); beyond it rounds of star contraction do.
DRIVER_EDGES = 100_000


def trimmed(text: Column | str) -> Column:
    """The text without blanks at both ends; null becomes empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))


def words(text: Column | str) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+`; empty for null and blank texts."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _PARTED))


def n_words(text: Column | str) -> Column:
    """How many words, as long."""
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, _PARTED))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; unset only in local tests, where a folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="larkspur-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
        at_exit(spark, spark.sparkContext.getCheckpointDir())
    return found.rstrip("/")


def at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame by way of checkpoint(): lineage ends, and later passes read the same rows in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, each: int = 20_000) -> DataFrame:
    """cut() for rows that may be few: they are counted on the way, as `_rows`, and read again in no more partitions than hold
    `each` of them, since a task for each partition of a shuffle costs more than a few rows do. Partitions lose their order.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count("*").alias("n")).checkpoint(eager=True)
    n = seen.get["n"]
    out = out.coalesce(max(1, -(-n // each)))
    out._rows = n
    return out


def stored(df: DataFrame) -> DataFrame:
    """The frame by way of a compressed Parquet table in the shared folder, for rows too wide for a checkpoint.

    Its shuffle files are let go at once. The folder is deleted by let_go(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(tidy, before)
    at_exit(spark, path)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def let_go(df: DataFrame) -> None:
    """Deletes what stored() has written, once nothing that is still to be computed reads it."""
    deleted(df.sparkSession, df._stored_at)


def tidy(spark: SparkSession) -> None:
    """Lets go of the shuffle files and checkpoints of frames that nothing holds any more.

    Spark deletes them once the driver's garbage is collected, which many small jobs of a loop may not bring about for
    long, while each leaves files on every machine.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def joined_small(left: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """A join whose right side is broadcast only if its rows, counted here, are at most `limit`.

    `small` should be cut, so that counting is cheap, or gathered, so that it is counted. Beyond the limit the join shuffles
    both sides.
    """
    n = vars(small).get("_rows")
    few = (small.limit(limit + 1).count() if n is None else n) <= limit
    return left.join(F.broadcast(small) if few else small, on, how)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> tuple[DataFrame, int]:
    """The rows with their rank from 0 in `order`, and their count.

    Range partitions are sorted, checkpointed and counted; a rank is the place in its partition plus the counts
    before. No task sees all rows. Only one count per partition reaches the driver. `df` should be cut if it is
    dear, since the range exchange samples it first. Rows that tie on every column of `order` get ranks in no
    set order among themselves.
    """
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    spot = "_spot"
    at = at.withColumn(spot, F.monotonically_increasing_id())
    part = F.shiftright(F.col(spot), 33)
    counts = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    starts = F.lit(before or [0]).cast("array<bigint>")
    rank = F.col(spot).bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(starts, (part + 1).cast("int"))
    return at.withColumn(name, rank).drop(spot), total


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name of `sums`, the sum of its whole numbers over all rows before in `order`.

    As with numbered(), only one row per range partition reaches the driver, and no task sees all rows.
    """
    at = df.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    at = cut(at.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_spot", F.monotonically_increasing_id())
    at = at.withColumn("_p", F.shiftright(F.col("_spot"), 33).cast("int"))
    held = {r["_p"]: r for r in at.groupBy("_p").agg(*[F.sum(f"_v{i}").alias(f"s{i}") for i in range(len(sums))]).collect()}
    here = Window.partitionBy("_p").orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for i, name in enumerate(sums):
        starts, total = [], 0
        for p in range(max(held, default=-1) + 1):
            starts.append(total)
            total += held[p][f"s{i}"] if p in held else 0
        before = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), F.col("_p") + 1)
        out[name] = before + F.coalesce(F.sum(f"_v{i}").over(here), F.lit(0))
    return at.withColumns(out).drop("_spot", "_p", *[f"_v{i}" for i in range(len(sums))])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of the component.

    Up to DRIVER_EDGES edges, counted here, go to the driver, since each round costs as many small tasks however few
    edges there are. More alternate the two star contractions of Kiveris et al. 2014 until the edges stay as they are. Both
    need only partial minima and joins, and each result is checkpointed. Loops and repeated edges do no harm.
    """
    e = gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(x: DataFrame):
        r = x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    if 0 < e._rows <= DRIVER_EDGES:
        return _least_nodes(e)
    old = mark(e)
    while old[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        big = cut(big)
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        pairs = big.join(low, "a")
        e = cut(pairs.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
                .select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
        new = mark(e)
        if new == old:
            break
        old = new
    tidy(e.sparkSession)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _least_nodes(edges: DataFrame) -> DataFrame:
    """components() of a few edges (a, b), on the driver: a greater root always goes below a smaller one."""
    got, up = edges.select("a", "b").toArrow(), {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    of = [got.schema.field("a").type] * 2
    table = pa.table([pa.array(x, t) for x, t in zip((list(up), [root(x) for x in up]), of)], names=["node", "root"])
    return edges.sparkSession.createDataFrame(table)


def latest(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group in `order`, with the rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
