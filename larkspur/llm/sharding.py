"""Shards along a Hilbert curve over metadata, cut into runs of equal row counts, and the bounds by which readers pass shards over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined_small, numbered, running


def curve(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve as a finite automaton: for state * 2^dims + cell, the digit along the curve and the next state.

    A state is an entry corner e and a direction d (Hamilton 2006): a cell is reflected by e, rotated by d + 1, and
    its digit is the Gray code rank; the child cell's entry and direction make the next state.
    """
    size = 1 << dims

    def rotate(v: int, by: int) -> int:
        by %= dims
        return ((v << by) | (v >> (dims - by))) & (size - 1)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}
    ones = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    digit, after = [], []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for cell in range(size):
            w = rank[rotate(cell ^ e, dims - (d + 1) % dims)]
            entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
            digit.append(w)
            after.append((e ^ rotate(entry, d + 1)) * dims + (d + turn + 1) % dims)
    return digit, after


def hilbert(cells: Sequence[Column], bits: int) -> Column:
    """The index along the curve of a point whose coordinates are whole numbers below 2^bits."""
    dims = len(cells)
    digit, after = curve(dims)
    digits, states = (F.lit(x).cast("array<int>") for x in (digit, after))

    def cell(level: Column) -> Column:
        out = F.lit(0)
        for i, c in enumerate(cells):
            one = F.call_function("shiftright", c, level).bitwiseAND(F.lit(1))
            out = out + one * F.lit(1 << i)
        return out

    def step(a: Column, level: Column) -> Column:
        at = a["s"] * F.lit(1 << dims) + cell(level)
        return F.struct(F.get(states, at).alias("s"), (a["h"] * F.lit(1 << dims) + F.get(digits, at)).alias("h"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda a: a["h"])


def cells(rows: DataFrame, dim: str, n: int, bits: int) -> DataFrame:
    """(value, cell) of each distinct whole value of a column: of the rows with a smaller value, those in 2^bits parts of all.

    So steps hold equally many rows, as far as single values allow, and no two values trade places. Nulls come first, NaN
    counts as null.
    """
    kinds = running(rows.groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("_n")), ["value"], {"_before": F.col("_n")})
    return cut(kinds.select("value", F.expr(f"_before * {1 << bits}L div {max(n, 1)}L").cast("int").alias("cell")))


def sharded(docs: DataFrame, dims: Sequence[str], shards: int = 40, bits: int = 8, id_col: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot, dims): every row in a run of the curve, run lengths at most one apart.

    `dims` are columns that can be ordered; each whole value lies on one of 2^bits steps, see cells(). Rows go by curve
    index, then by text_crc32 (equal texts of a cell stay together), id and size; dims returns their values as a struct
    (d0, d1, ...), for bounds(). A null text has 0 bytes and checksum 0; very long ones count by their bytes. Repeated rows are placed one by one.
    Further columns play no part, whatever their names. Fewer rows than shards leave shards empty.
    """
    if not 1 <= len(dims) <= 4 or bits * len(dims) > 62:
        raise ValueError("the curve takes 1 to 4 dimensions and 62 bits in all")
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = {d: docs.schema[d].dataType.typeName() for d in dims}
    held = [F.when(~F.isnan(d), F.col(d)) if kinds[d] in ("float", "double") else F.col(d) for d in dims]
    at = docs.select(F.col(id_col).alias("_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
                     *[c.alias(f"_d{i}") for i, c in enumerate(held)])
    at = cut(at)
    n = at.count()
    for i in range(len(dims)):
        steps = cells(at, f"_d{i}", n, bits)
        at = joined_small(at, steps, at[f"_d{i}"].eqNullSafe(steps["value"])).drop("value").withColumnRenamed("cell", f"_c{i}")
    curve_at = hilbert([F.col(f"_c{i}") for i in range(len(dims))], bits).alias("curve")
    at = at.select("_id", "size", "text_crc32", curve_at, F.struct(*[F.col(f"_d{i}").alias(f"d{i}") for i in range(len(dims))]).alias("dims"))
    ranked, _ = numbered(at, ["curve", "text_crc32", "_id", "size"], "_rank")
    ranked = ranked.withColumn("shard", F.expr(f"_rank * {shards}L div {max(n, 1)}L").cast("int"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "curve", "shard", (F.col("_rank") - first).alias("slot"), "dims")


def bounds(placed: DataFrame) -> DataFrame:
    """(shard, n, and of every dimension low_i, high_i, nulls_i): what a reader needs to pass shards over."""
    dims = [f.name for f in placed.schema["dims"].dataType.fields]
    return placed.groupBy("shard").agg(F.count("*").alias("n"), *[c for d in dims for c in (
        F.min(f"dims.{d}").alias(f"low_{d[1:]}"), F.max(f"dims.{d}").alias(f"high_{d[1:]}"), F.count_if(F.col(f"dims.{d}").isNull()).alias(f"nulls_{d[1:]}"))])


def touched(limits: DataFrame, box: dict[int, tuple]) -> DataFrame:
    """The shards of bounds() that can hold rows of a box: for some dimensions, values from low to high, both included."""
    for i, (low, high) in box.items():
        limits = limits.where((F.col(f"high_{i}") >= F.lit(low)) & (F.col(f"low_{i}") <= F.lit(high)))
    return limits


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents along the curve of source, lang and n_chars, in 40 shards by the law `rows`; see sharded()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharded(docs, ["source", "lang", "n_chars"])
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


def _sql(dims: Sequence[str] = ("source", "lang", "n_chars"), bits: int = 8, shards: int = 40) -> str:
    size = 1 << len(dims)
    digit, after = curve(len(dims))
    steps = ",\n".join(f"s{i} AS (SELECT value, coalesce(sum(n) OVER (ORDER BY value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * {1 << bits} // (SELECT count(*) FROM documents) AS c"
                       f" FROM (SELECT {d} AS value, count(*) AS n FROM documents GROUP BY {d}))" for i, d in enumerate(dims))
    joins = " ".join(f"JOIN s{i} ON s{i}.value IS NOT DISTINCT FROM b.{d}" for i, d in enumerate(dims))
    cell = " + ".join(f"((s{i}.c >> l) & 1) * {1 << i}" for i in range(len(dims)))
    states = size * len(dims)
    # an accumulator holds the index so far, times the number of states, plus the state
    at = f"(a % {states}) * {size} + {cell} + 1"
    reduce = f"list_reduce({list(range(bits - 1, -1, -1))}::BIGINT[], lambda a, l: ((a // {states}) * {size} + {digit}[{at}]) * {states} + {after}[{at}], 0::BIGINT) // {states}"
    crc = "xor(list_reduce(bytes, lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295)"
    table = "list_transform(range(256), lambda x: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x))"
    return f"""
WITH {steps},
b AS (SELECT doc_id, {', '.join(dims)}, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 + 16 AS size, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS bytes, {reduce} AS curve FROM b {joins}),
t AS (SELECT {table} AS crcs),
c AS (SELECT doc_id, size, {crc} AS text_crc32, curve FROM p CROSS JOIN t),
r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () AS n FROM c),
s AS (SELECT *, rank * {shards} // n AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, rank - (shard * n + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard, curve FROM s
"""


SQL = _sql()
