"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, latest

#: Pivots at least and at most, in between an eighth of the square root of the rows; rings around each. The table of the pivots'
#: products with a batch of vectors is all that is sent, so the most bounds it.
PIVOTS, RINGS = (24, 1024), 16
#: Queries and rows that meet in one task's product at most.
BLOCK = 4096
#: By how much more rows each round opens than the one before.
WIDER = 16
#: Rows the pivots are fitted on, those with the smallest hash of their id.
SAMPLE = 4096
#: Steps of the vectors' whole numbers.
SCALE = 1024
#: Rounding of a bound; distances are doubles of whole-number vectors.
_SLACK = 1e-6


def whole(vectors: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component as a double; rows that are null, or hold null, NaN or infinity, are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # an empty vector has no components to multiply
    return vectors.where(fine & (F.size(vector) > 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _stack(rows: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, width))


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With one more component, all rows have norm sqrt(top): then a greater inner product is a smaller distance."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def _fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Pivots by Lloyd's rounds from evenly spaced rows; the same sample gives the same pivots."""
    at = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        near = _distances(sample, at).argmin(1)
        at = np.stack([sample[near == j].mean(0) if (near == j).any() else at[j] for j in range(len(at))])
    return at


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, rings: int = RINGS, sample: int = SAMPLE,
          block: int = BLOCK, log: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of (id, v) of greatest inner product with each query (id, v), exactly.

    Scores are whole numbers; ties go to the smaller id; a query is no candidate of its own. Fewer rows give fewer
    results; empty tables none. Rows that repeat an id count each. Vectors, and queries, of another length than most
    (of lengths as frequent, the greatest) take no part, since they have no product with the others. ValueError if a square of
    a vector's length passes 2^53, beyond which scores would be inexact.

    Every row is keyed by its nearest pivot and its ring of distance. A query opens the annuli by falling bound: those that
    hold its first 4 k rows, then in each round WIDER times as many, as long as the triangle inequality does not rule them
    out against its k-th score so far. Rows and queries of an annulus are dealt by hashes of their ids into blocks of at
    most about `block`, so that no task holds more, however many share an annulus. log: gets the pairs scored, those there are, and the rounds.
    """
    spark = vectors.sparkSession
    nothing = "query_id long, rank int, vec_id long, score long"
    width = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return spark.createDataFrame([], nothing)
    width = width["w"]
    vectors, queries = cut(vectors.where(F.size("v") == width)), cut(queries.where(F.size("v") == width).select("id", "v"))
    top, n = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), F.count("*")).first()
    asked_of = queries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), F.count("*")).first()
    if max(top, asked_of[0] or 0.0) > 2.0**53:
        raise ValueError("scores of such long vectors pass 2^53 and would be inexact")
    pivots = pivots or int(min(PIVOTS[1], max(PIVOTS[0], n**0.5 / 8)))
    rows = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    at = _fit(_lifted(np.array(rows, dtype=np.float64), top), pivots)
    span = 2 * np.sqrt(top) / rings + 1e-9

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_lifted(_stack(b["v"], width), top), at)
            p = d.argmin(1)
            far = d[np.arange(len(b)), p]
            yield pd.DataFrame({"id": b["id"], "v": b["v"], "cell": p * rings + np.minimum(far / span, rings - 1).astype(int), "far": far})

    placed = cut(vectors.mapInPandas(keyed, "id long, v array<double>, cell int, far double"))
    # at most pivots * rings rows reach the driver
    held = {r["cell"]: (r["n"], r["lo"], r["hi"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()}
    cells = sorted(held)
    counts, low, high = (np.array([held[c][i] for c in cells]) for i in range(3))
    owner = np.array(cells) // rings
    per = int(min(block, max(64, n // 2048)))

    def parts(sizes: dict[int, int], most: int) -> Column:
        """In how many blocks an annulus of these sizes is dealt."""
        return F.element_at(F.lit([max(1, -(-sizes.get(c, 0) // most)) for c in range(pivots * rings)]).cast("array<int>"), F.col("cell") + 1)

    row_parts = parts({c: h[0] for c, h in held.items()}, per)

    def bounds(v: pd.Series) -> np.ndarray:
        """The greatest score that a row of each cell could have with each query."""
        x = _stack(v, width)
        norm = (x * x).sum(1)
        d = _distances(np.hstack([x, np.zeros((len(x), 1))]), at)[:, owner]
        least = np.maximum(0.0, np.maximum(low[None] - d, d - high[None]) - _SLACK * (1 + d))
        return (norm[:, None] + top - least * least) / 2 + _SLACK * (1 + np.abs(norm[:, None] + top))

    def opening(first: int, last: int):
        """The annuli that hold the rows from `first` to `last` of a query's order, but for those its bar rules out."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                hold = bounds(b["v"])
                best = np.argsort(-hold, axis=1, kind="stable")
                before = np.cumsum(counts[best], axis=1) - counts[best]
                bar = b["bar"].to_numpy(dtype=float)
                bar = np.where(np.isnan(bar), -np.inf, bar)
                some = (before >= first) & (before < last) & (np.take_along_axis(hold, best, 1) >= bar[:, None])
                who, place = np.nonzero(some)
                yield pd.DataFrame({"query_id": b["id"].to_numpy()[who], "q": pd.Series([b["v"].iloc[i] for i in who], dtype=object), "bar": bar[who],
                                    "cell": np.array(cells, dtype=np.int32)[best[who, place]]})

        return run

    def scored(rows_: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows_) and len(asked):
            ids = rows_["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _stack(rows_["v"], width)[order]
            for at_ in range(0, len(asked), 512):
                some = asked.iloc[at_:at_ + 512]
                s = _stack(some["q"], width) @ x.T
                for qid, bar, line in zip(some["query_id"], some["bar"], s):
                    mine = np.flatnonzero((ids != qid) & (line >= bar))  # below the k-th score so far nothing counts
                    mine = mine[np.argsort(-line[mine], kind="stable")[:k]]
                    out["query_id"] += [qid] * len(mine)
                    out["vec_id"] += ids[mine].tolist()
                    out["score"] += line[mine].astype(np.int64).tolist()
        return pd.DataFrame(out).astype("int64")

    best = [F.col("score").desc(), F.col("vec_id")]
    bars, found, first, last, pairs, turns = queries.withColumn("bar", F.lit(None).cast("double")), None, 0, 4 * k, 0, 0
    while first < n:
        asked = cut(bars.mapInPandas(opening(first, last), "query_id long, q array<double>, bar double, cell int"))
        opened = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        pairs, turns = pairs + sum(m * held[c][0] for c, m in opened.items()), turns + 1
        if opened:
            asks = parts(opened, block)
            left = placed.select("id", "v", "cell", F.pmod(F.xxhash64("id"), row_parts).cast("int").alias("part"),
                                 F.explode(F.sequence(F.lit(0), asks - 1)).alias("ask"))
            right = asked.select("*", F.pmod(F.xxhash64("query_id"), asks).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), row_parts - 1)).alias("part"))
            keys = ["cell", "part", "ask"]
            got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, "query_id long, vec_id long, score long")
            found = cut(latest(got if found is None else got.union(found.drop("rank")), ["query_id"], best, k))
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("bar"))
            bars = queries.join(kth, queries["id"] == kth["_q"], "left").select("id", "v", "bar")
        first, last = last, last * WIDER
    if log is not None:
        log.update(scored=pairs, pairs=n * asked_of[1], rounds=turns)
    if found is None:
        return spark.createDataFrame([], nothing)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all embeddings for each whose id is divisible by 100; see whole() and top_k()."""
    v = whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(v, v.where(F.col("id") % 100 == 0), 10)


SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
      FROM x AS q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
