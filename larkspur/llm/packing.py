"""Length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, n_words, numbered

def _layer(best: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: for the first i lengths the least padding and the place of the last cut.

    The cost is Monge, so the best last cut moves one way; the halves of a range search the cuts on their side of its
    middle's. All ranges of one depth are searched in one pass of arrays.
    """
    m = len(lengths)
    new, at = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
    new[0] = 0.0
    lo, hi, a, b = (np.array([x], dtype=np.int64) for x in (1, m, 0, m - 1))
    while len(lo):
        mid = (lo + hi) // 2
        held = np.minimum(b, mid - 1) - a + 1
        off = np.concatenate(([0], np.cumsum(held)[:-1]))
        which = np.repeat(np.arange(len(mid)), held)
        j = np.arange(held.sum()) - off[which] + a[which]
        cost = best[j] + lengths[mid - 1].astype(float)[which] * (n[mid][which] - n[j])
        least = np.minimum.reduceat(cost, off)
        hit = np.flatnonzero(cost == least[which])
        _, first = np.unique(which[hit], return_index=True)
        cut_at = j[hit[first]]
        new[mid], at[mid] = least, cut_at
        lo, hi, a, b = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (a, cut_at), (cut_at, b)))
        some = lo <= hi
        lo, hi, a, b = lo[some], hi[some], a[some], b[some]
    return new, at


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` upper bounds that minimise the sum of bound minus length over all texts, exactly.

    Dynamic programming over the ascending lengths, in O(buckets * lengths * log lengths) steps; see _layer(). Of equal
    sums the earliest cuts win.
    """
    m = len(lengths)
    if not m:
        return []
    n = np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    best = np.concatenate(([0.0], np.full(m, np.inf)))
    cuts = []
    for _ in range(min(buckets, m)):
        best, at = _layer(best, np.asarray(lengths), n)
        cuts.append(at)
    out, at = [], m
    for c in reversed(cuts):
        if at:
            out.append(int(lengths[at - 1]))
            at = int(c[at])
    return sorted(out)


def packed(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, bucket, bound, batch, slot, padding): where every text goes.

    A text of more than `budget` tokens is cut into pieces of `budget` (piece 0, 1, ...; start is the first token).
    Pieces of a bucket, dealt by a hash of the id, form batches of budget // bound slots, so that a padded batch
    never exceeds the budget. Batches count from 0 in each bucket. Null and empty texts have length 0 and take a
    slot in the lowest bucket. Repeated rows are packed one by one, and rows without an id like any other. Further
    columns play no part. An empty table gives no rows. The histogram is exact, so the bounds are optimal at any size.
    """
    whole = docs.select(F.col(id_col), F.coalesce(length, F.lit(0)).cast("long").alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / budget).cast("long") - 1, F.lit(0))
    pieces = whole.select(id_col, "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        id_col, "piece", (F.col("piece") * budget).alias("start"),
        F.least(F.col("_n") - F.col("piece") * budget, F.lit(budget)).alias("length"))
    pieces = cut(pieces)
    bins = sorted((r[0], r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect())  # budget + 1 rows at most
    bounds = boundaries(np.array([b for b, _ in bins]), np.array([c for _, c in bins]), buckets)
    if not bounds:
        bounds = [budget]
    at = np.searchsorted(bounds, [b for b, _ in bins]) if bins else np.array([], dtype=int)
    held = np.bincount(at, weights=[c for _, c in bins], minlength=len(bounds)).astype(np.int64) if bins else np.zeros(len(bounds), dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(held)[:-1]))
    pick = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        pick = F.when(F.col("length") <= bounds[i], i).otherwise(pick)
    ranked, _ = numbered(pieces.withColumn("bucket", pick), ["bucket", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("piece").cast("string"))), id_col, "piece", "length"], "_rank")

    def of(values) -> Column:
        return F.element_at(F.lit([int(v) for v in values]).cast("array<bigint>"), F.col("bucket") + 1)

    room = of([max(1, budget // max(1, b)) for b in bounds])
    k = F.col("_rank") - of(first)
    return ranked.select(id_col, "piece", "start", "length", "bucket", of(bounds).alias("bound"),
                         F.floor(k / room).cast("long").alias("batch"), (k % room).alias("slot"),
                         (of(bounds) - F.col("length")).alias("padding"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their words, in 16 buckets and batches of 65,536 words; see packed()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, n_words("text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every row's words go; see packed(). This last stage returns places, not documents."""
    return packed(docs, n_words("text"))


def _sql(buckets: int = 16, budget: int = 65_536) -> str:
    """The same by the plain program: every cut of every length is tried for each bucket."""
    layers = "".join(f"""
b{k} AS MATERIALIZED (SELECT i, s.c AS best, s.j AS cut_at FROM (SELECT p.i, min({{'c': b.best + p.length * (p.n - q.n), 'j': q.i}}) AS s
      FROM pts p JOIN pts q ON q.i < p.i JOIN b{k - 1} b ON b.i = q.i GROUP BY p.i) UNION ALL SELECT 0, 0, 0),""" for k in range(1, buckets + 1))
    back = "".join(f"\nx{k - 1} AS (SELECT cut_at AS i FROM b{k} JOIN x{k} USING (i))," for k in range(buckets, 1, -1))
    ends = " UNION ".join(f"SELECT i FROM x{k}" for k in range(1, buckets + 1))
    return rf"""
WITH whole AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
pieces AS (SELECT doc_id, n, unnest(range(greatest(ceil(n / {budget})::BIGINT, 1))) AS piece FROM whole),
cuts AS (SELECT doc_id, piece, piece * {budget} AS start, least(n - piece * {budget}, {budget}) AS length FROM pieces),
bins AS (SELECT length, count(*) AS c FROM cuts GROUP BY length),
pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY length) AS i, length, (sum(c) OVER (ORDER BY length))::DOUBLE AS n FROM bins UNION ALL SELECT 0, 0, 0),
b0 AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE 'inf'::DOUBLE END AS best FROM pts),{layers}
x{buckets} AS (SELECT max(i) AS i FROM pts),{back}
bounds AS (SELECT length AS bound, row_number() OVER (ORDER BY length) - 1 AS bucket FROM pts WHERE i > 0 AND i IN ({ends})),
placed AS (SELECT c.*, min({{'bound': bound, 'bucket': bucket}}) AS b FROM cuts c JOIN bounds ON bound >= length GROUP BY ALL),
-- repeated rows are rows of their own
every AS (SELECT c.*, p.b.bound AS bound, p.b.bucket AS bucket, greatest(1, {budget} // greatest(1, p.b.bound)) AS room
          FROM cuts c JOIN placed p ON c.doc_id IS NOT DISTINCT FROM p.doc_id AND c.piece = p.piece AND c.length = p.length),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat_ws(':', doc_id::VARCHAR, piece::VARCHAR)), doc_id NULLS FIRST, piece, length) - 1 AS k FROM every)
SELECT doc_id, piece, start, length, bucket::INT AS bucket, bound, k // room AS batch, k % room AS slot, bound - length AS padding FROM ranked
"""


SQL = _sql()
