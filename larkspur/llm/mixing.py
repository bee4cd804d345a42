"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined_small, n_words, numbered, running, tidy

#: Newton steps at most; steps stop once every source's expected words are within TOLERANCE of its target, or its bracket is empty.
STEPS, TOLERANCE = 100, 1e-7
#: Rates count in whole parts of this, so that sums are exact and reruns agree whatever the order of rows.
PARTS = 1 << 24


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take `weights` in turn and share the sum of all sizes. A target stops at `most`
    times its source's size; the excess goes to the others by weight until none is above. Only two sums per round
    reach the driver.
    """
    at, _ = numbered(sizes, [F.col("source").asc_nulls_last()], "_at")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    at = cut(at.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most)))
    level, capped = 0.0, -1
    while True:
        over = (F.col("_w") * level > F.col("_cap")) if capped >= 0 else F.lit(False)
        r = at.agg(F.sum("source_size").cast("double"), F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_w"))),
                   F.count(F.when(over, 1))).first()
        if r[3] == capped or not r[2]:
            break
        capped, level = r[3], ((r[0] or 0.0) - (r[1] or 0.0)) / r[2]
    target = F.least(F.col("_cap"), F.col("_w") * level)
    return at.select("source", "source_size", target.alias("target"))


def _parts(tilt: Column, size: Column, most: int) -> Column:
    """The rate min(most, exp(tilt * size)) in whole PARTS; a null tilt stands for a source that is wanted `most` times whole."""
    rate = F.least(F.exp(F.least(tilt * size, F.lit(700.0))), F.lit(float(most)))
    return F.when(tilt.isNull(), F.lit(most * PARTS)).otherwise(F.floor(rate * PARTS)).cast("long")


def balanced(lengths: DataFrame, goals: DataFrame, most: int, log: list[float] | None = None) -> DataFrame:
    """goals (source, source_size, target) with `tilt`, the multiplier of each source's token constraint.

    Rates r of documents that keep as close to 1 as they can, in the sum of r log r - r + 1, under one constraint
    per source, sum of size * r = target, and r <= most, are min(most, exp(tilt * size)). The dual in the tilts is
    convex and its Hessian diagonal, as sources are disjoint. Every Newton step is one pass over `lengths` (source,
    size, n), to which all documents add up, since those of one length have one rate: it sums size * r and, where r is
    below `most`, size^2 * r. A step that leaves the bracket of what is known to be too low and too high is halved
    into it. It starts at log(target / size) over the mean length of a token's document, which for targets below
    the size is never too low. log: gets the greatest relative gap of each step.
    """
    size, q = F.col("size"), _parts(F.col("tilt"), F.col("size"), most)
    exact = F.col("n").cast("decimal(20,0)") * F.col("size").cast("decimal(12,0)")
    mean = lengths.groupBy("source").agg(F.sum((F.col("n") * F.pow(size.cast("double"), F.lit(2.0))).cast("decimal(38,0)")).cast("double").alias("_square"))
    whole = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    start = F.log(F.col("target") / F.col("source_size")) * F.col("source_size") / F.col("_square")
    at = goals.join(mean.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    at = cut(at.select("source", "source_size", "target", F.when(~whole & (F.col("source_size") > 0), start).alias("tilt"),
                       F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), "_square"))
    for step in range(STEPS):
        if step % 8 == 0:
            tidy(lengths.sparkSession)
        open_ = at.where("tilt is not null")
        asked = open_.select(F.col("source").alias("_of"), "tilt")
        sums = joined_small(lengths, asked, lengths["source"].eqNullSafe(asked["_of"])).groupBy("source").agg(
            F.sum(exact * q.cast("decimal(12,0)")).cast("double").alias("_got"),
            F.sum(F.when(q < most * PARTS, exact * size.cast("decimal(12,0)") * q.cast("decimal(12,0)"))).cast("double").alias("_slope"))
        sums = sums.select(F.col("source").alias("_of"), (F.col("_got") / PARTS).alias("_got"), (F.coalesce("_slope", F.lit(0.0)) / PARTS).alias("_slope"))
        gap = F.col("_got") - F.col("target")
        next_ = at.join(sums, at["source"].eqNullSafe(sums["_of"]), "left").drop("_of").withColumn("_gap", gap)
        low = F.when(F.col("_gap") < 0, F.col("tilt")).otherwise(F.col("_low"))
        high = F.when(F.col("_gap") > 0, F.col("tilt")).otherwise(F.col("_high"))
        next_ = next_.withColumns({"_low": low, "_high": high})
        newton = F.when(F.col("_slope") > 0, F.col("tilt") - F.col("_gap") / F.col("_slope"))
        within = newton.isNotNull() & (F.col("_low").isNull() | (newton > F.col("_low"))) & (F.col("_high").isNull() | (newton < F.col("_high")))
        # beyond a bracket with one end only: a step away from it, ever wider
        unit = F.col("source_size") / F.col("_square")
        middle = F.when(F.col("_low").isNull(), F.col("_high") * 2 - unit).when(F.col("_high").isNull(), F.abs("_low") * 2 + unit).otherwise((F.col("_low") + F.col("_high")) / 2)
        done = F.col("_gap").isNull() | (F.abs("_gap") <= F.col("target") * TOLERANCE) | F.coalesce(F.col("_high") - F.col("_low") <= F.abs("_low") * 1e-13, F.lit(False))
        next_ = next_.withColumn("_rest", F.when(~done, F.abs("_gap") / F.col("target"))).withColumn("tilt", F.when(done, F.col("tilt")).when(within, newton).otherwise(middle))
        at = cut(next_.select("source", "source_size", "target", "tilt", "_low", "_high", "_square", "_rest"))
        rest = at.agg(F.max("_rest")).first()[0]
        if log is not None:
            log.append(rest or 0.0)
        at = at.drop("_rest")
        if rest is None:
            break
    return at.select("source", "source_size", "target", "tilt")


def mixed(docs: DataFrame, size, weights: Sequence[float] = (5, 2, 1), most: int = 3, id_col: str = "doc_id",
          source: str = "source", rounds: int = 2, log: list[float] | None = None) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for every row.

    Rates are balanced() ones, tilted by length. They are rounded by systematic sampling along source and length, so that
    copies add up to the rates' running sum at every place; then in `rounds` passes each source turns the one
    document that brings its sum nearest to the target. No document is copied over `most` times. Null sources form
    one source; null and empty texts have size 0 and take nothing. Ties in size go by a hash of the id, then by the id;
    reruns agree. Repeated rows are counted one by one. Empty tables give no rows. Further columns play no part.
    """
    at = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    at = cut(at)
    lengths = cut(at.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = cut(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    goals = cut(balanced(lengths, cut(targets(sizes, weights, most)), most, log).withColumnRenamed("source", "_source"))
    # of each length: how many rows, and parts of a copy, come before it in the order of all rows
    rated = joined_small(lengths, goals, lengths["source"].eqNullSafe(goals["_source"])).drop("_source")
    q = F.when(F.col("size") > 0, _parts(F.col("tilt"), F.col("size"), most)).otherwise(F.lit(0).cast("long"))
    rated = rated.withColumn("q", q).withColumn("_part", F.col("q") % PARTS)
    rated = running(rated, [F.col("source").asc_nulls_last(), "size"], {"_first": F.col("n"), "_before": F.col("n") * F.col("_part")})
    rated = cut(rated.withColumnsRenamed({"source": "_source", "size": "_size"}).drop("tilt", "n"))
    ranked, _ = numbered(at, [F.col("source").asc_nulls_last(), "size", F.xxhash64("_id"), "_id"], "_rank")
    full = joined_small(ranked, rated, ranked["source"].eqNullSafe(rated["_source"]) & (ranked["size"] == rated["_size"])).drop("_source", "_size")
    k, half = F.col("_rank") - F.col("_first"), PARTS // 2
    over = lambda i: F.call_function("div", F.col("_before") + i * F.col("_part") + half, F.lit(PARTS))
    copies = F.call_function("div", F.col("q"), F.lit(PARTS)) + over(k + 1) - over(k)
    full = cut(full.select("_id", "source", "size", "source_size", "target", (F.col("q") / PARTS).alias("rate"), copies.cast("long").alias("copies"), "_rank"))
    for _ in range(rounds):
        full = _nearer(full, most)
    return full.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "rate", "copies")


def _nearer(full: DataFrame, most: int) -> DataFrame:
    """One pass: each source adds or removes one copy of the document that leaves its sum nearest to the target."""
    sums = cut(full.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("_got")).select(
        F.col("source").alias("_source"), (F.col("target") - F.col("_got")).alias("_lack")))
    at = joined_small(full, sums, full["source"].eqNullSafe(sums["_source"])).drop("_source")
    can = (F.col("size") > 0) & F.when(F.col("_lack") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    left = F.abs(F.abs("_lack") - F.col("size"))
    turn = cut(at.where(can & (left < F.abs("_lack"))).groupBy("source").agg(
        F.min_by(F.struct("_rank", "_lack"), F.struct(left, F.col("_rank"))).alias("_t")).select(F.col("_t._rank").alias("_turn"), F.signum("_t._lack").alias("_by")))
    at = joined_small(full, turn, full["_rank"] == turn["_turn"], "left")
    return at.withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0.0)).cast("long")).drop("_turn", "_by")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, null and empty texts with size 0, repeated rows one by one; taken is size times copies. See mixed()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixed(docs, n_words("text"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: from no row to three.

    Equal rows stand together in the mix as they do in the table, so n equal rows come out as often as the mix takes
    the n of them. Documents without words take no part and are left out. All columns, whatever their names, are
    returned as they are; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), F.concat(F.lpad(F.hex(F.xxhash64(row)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), row)), 16, "0")).alias("_key"))
    got = mixed(keyed.select("_key", F.col("_row.source").alias("source"), F.col("_row.text").alias("text")), n_words("text"), id_col="_key")
    per = got.groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_held"))
    per = cut(per.where("_copies > 0"))
    # n equal rows share their copies: the first of them take one more where these do not divide evenly
    rows = keyed.join(per, "_key")
    alone = rows.where("_held = 1").select("_row", "_copies")
    many = rows.where("_held > 1").groupBy("_key").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies")).select("_row", "_copies")
    out = alone.union(many).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return out.select("_row.*")
