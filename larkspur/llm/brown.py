"""Scores by a class-based bigram model whose classes come from exchange clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored

#: Classes that exchange words; words of highest count that do; words whose counts are sent to every executor (some 15 MB).
CLASSES, HEAD, KNOWN = 64, 1 << 15, 1 << 17
#: Rounds of exchange at most; in each a part of the words, by turns, may move. Rounds end once all parts together have gained less
#: than this share of the log-likelihood.
ROUNDS, GAIN = 40, 0.001
#: What each word of a shape's class gives up of its count to unknown words.
DISCOUNT = 0.5
#: All other words fall into fixed classes by shape: last character, whether all ASCII, whether over ten bytes.
SHAPES = 12
_FLUSH = 400_000


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    last = 2 if word[-1:] in b".!?" else 1 if word[-1:] in b",;:" else 0
    return last * 4 + (0 if word.isascii() else 2) + (len(word) > 10)


def shape_of(word: Column) -> Column:
    """shape() as an expression."""
    last = F.when(F.right(word, F.lit(1)).isin(".", "!", "?"), 2).when(F.right(word, F.lit(1)).isin(",", ";", ":"), 1).otherwise(0)
    wide, long = F.octet_length(word) != F.length(word), F.octet_length(word) > 10
    return last * 4 + F.when(wide, 2).otherwise(0) + F.when(long, 1).otherwise(0)


def _texts(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; each task sums what it has read before rows are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_texts(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for x in b.column(0):
                seen.update(split(x.as_py()))
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words by falling count, then by word: those at or above the least count step at which they are `most` at most.

    Steps are counts cut to their six highest bits, so few rows tell how many words reach each, and no task sorts.
    """
    cutoff = F.greatest(F.floor(F.log2(F.col("n").cast("double"))).cast("int") - 5, F.lit(0))
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), cutoff), cutoff)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > most:
            break
        least = r["s"]
    if least is None:
        return []
    got = counts.where(F.col("n") >= least).toPandas()
    return sorted(zip(got["word"].tolist(), got["n"].tolist()), key=lambda x: (-x[1], x[0]))


class Symbols:
    """Numbers for tokens: 0 the end, 1 to SHAPES the shapes, then the head words by count."""

    def __init__(self, words: list[str], counts: list[int]):
        self.place = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
        self.counts = np.array(counts, dtype=np.int64)
        self.head = min(HEAD, int((self.counts > 1).sum()))
        self.size = 1 + SHAPES + self.head
        rest = [1 + shape(w) for w in list(self.place)[self.head:]]
        # of each known word, and last of an unknown one, whose shape is looked at
        self.sym = np.array([*range(1 + SHAPES, self.size), *rest, 0], dtype=np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of each word, place among the known words or -1)."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        sym = self.sym[at]
        for i in np.flatnonzero(at < 0).tolist():
            sym[i] = 1 + shape(words[i])
        return sym, at


def pair_counts(docs: DataFrame, text: str, sent, size: int) -> DataFrame:
    """(a, b, n): how often symbol b follows symbol a; texts begin after an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = cloudpickle.loads(sent.value)
        held: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

        for b in batches:
            for x in b.column(0):
                sym, _ = symbols.of(split(x.as_py()))
                line = np.concatenate(([0], sym, [0]))
                held.append(line[:-1] * size + line[1:])
                rows += len(line)
                if rows > 4_000_000:
                    yield out()
                    held.clear()
                    rows = 0
        yield out()

    got = docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return got.select(F.expr(f"cast(code div {size} as int)").alias("a"), (F.col("code") % size).cast("int").alias("b"), "n")


#: Pairs in one packed row.
_PACK = 1 << 18


def _packed(pairs: DataFrame) -> DataFrame:
    """(w, o, side, n) of all pairs as rows of arrays in binary: side 1 for what follows w, side 0 for what precedes a head word.

    All pairs of one word lie in one partition. So every round reads a few wide rows instead of each pair as one.
    """
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("o"), F.lit(1).cast("byte").alias("side"), "n").union(
        pairs.where(F.col("b") > SHAPES).select(F.col("b").alias("w"), F.col("a").alias("o"), F.lit(0).cast("byte").alias("side"), "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            parts = [np.concatenate([x[i] for x in held]) for i in range(4)]
            return pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(parts, _KINDS)], ["w", "o", "side", "n"])

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            rows += b.num_rows
            if rows >= _PACK:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    # a word's pairs lie together; the symbols that are no words, of which each may be in a large share of all pairs, are dealt out
    spread = F.when(F.col("w") > SHAPES, F.lit(0)).otherwise(F.pmod(F.xxhash64("o"), F.lit(64)))
    return cut(both.repartition("w", spread).mapInArrow(run, "w binary, o binary, side binary, n binary"))  # which keeps partitions whole


_KINDS = (np.int32, np.int32, np.int8, np.int64)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for row in range(b.num_rows):
            yield [np.frombuffer(b.column(i)[row].as_buffer(), dtype=k) for i, k in enumerate(_KINDS)]


def _class_pairs(packed: DataFrame, classes: np.ndarray, total: int) -> np.ndarray:
    """The table of class bigrams: each task sends at most classes squared rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(total * total)
        for w, o, side, n in _unpacked(batches):
            m = side == 1
            t += np.bincount(classes[w[m]] * total + classes[o[m]], n[m], total * total)
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t[at].astype(np.int64))], ["at", "n"])

    out = np.zeros(total * total)
    got = packed.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(total, total)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The log-likelihood of class bigrams but for what the words' own counts add, which no class changes."""
    return float(_phi(table).sum() - _phi(table.sum(1)).sum() - _phi(table.sum(0)).sum())


def moves(left: np.ndarray, right: np.ndarray, twice: np.ndarray, own: np.ndarray, n: np.ndarray, table: np.ndarray, free: int) -> np.ndarray:
    """The class of greatest likelihood for each word, all others staying.

    left[w, c]: tokens of class c before w; right[w, c]: after it; twice: how often w follows itself; own: its class. A word is
    taken out of its class's row and column, and the change of sum of phi(N[c, d]) - 2 sum of phi(N[c]) is formed for
    every class it might enter. Only the columns and rows that the word has tokens in can change.
    """
    best, size, diagonal = own.copy(), table.sum(1)[:free], table.diagonal()[:free]
    for w in range(len(own)):
        a, t = own[w], twice[w]
        after, before = right[w].copy(), left[w].copy()
        after[a] -= t
        before[a] -= t
        d, e = np.flatnonzero(after), np.flatnonzero(before)
        rows, cols = table[:free, d], table[e, :free]
        rows[a] -= after[d]
        cols[:, a] -= before[e]
        if after[a]:
            i = np.searchsorted(d, a)
            rows[:, i] -= before[:free]
            rows[a, i] -= t
        if before[a]:
            i = np.searchsorted(e, a)
            cols[i] -= after[:free]
            cols[i, a] -= t
        row, col = _phi(rows + after[d]) - _phi(rows), _phi(cols + before[e][:, None]) - _phi(cols)
        gain = row.sum(1) + col.sum(0)
        d, e = d[d < free], e[e < free]
        gain[d] -= row[d, np.arange(len(d))]
        gain[e] -= col[np.arange(len(e)), e]
        same, held = diagonal.copy(), size.copy()
        same[a] -= after[a] + before[a] + t
        held[a] -= n[w]
        gain += _phi(same + after[:free] + before[:free] + t) - _phi(same) - 2 * (_phi(held + n[w]) - _phi(held))
        best[w] = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
    return best


def exchange(pairs: DataFrame, symbols: Symbols, rounds: int = ROUNDS, wanted: int = CLASSES, log: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, table of class bigrams).

    Words start in classes by rank. In every round the tasks, each holding all pairs of its words, find the best class
    of a part of the words, half of them at first, against the same table; the driver gets one row per head word, HEAD at most.
    As the words of a part move at once, they can lower the likelihood together; then they go back, and from there on parts
    are half as large. log: gets the likelihood at the start and after each round that is kept.
    """
    free = max(1, min(wanted, symbols.head))
    total = free + 1 + SHAPES
    classes = np.concatenate((free + np.arange(1 + SHAPES), np.arange(symbols.head) % free)).astype(np.int64)
    # as every round reads them all, no more tasks than cores, or a million pairs each
    packed = _packed(pairs).coalesce(max(pairs.sparkSession.sparkContext.defaultParallelism, 2 * pairs.count() >> 20))
    table = _class_pairs(packed, classes, total)
    log = [] if log is None else log
    log.append(likelihood(table))
    if not symbols.head:
        return classes, table
    parts, turn, gained = 2, 0, []
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], classes=classes, table=table, turn=turn, parts=parts) -> Iterator[pa.RecordBatch]:
            held = [[c[m] for c in b] for b in _unpacked(batches) for m in [(b[0] % parts == turn) & (b[0] > SHAPES)]]
            w, o, side, n = (np.concatenate([p[i] for p in held]) if held else np.zeros(0, np.int64) for i in range(4))
            ids, at = np.unique(w, return_inverse=True)
            for first in range(0, len(ids), 2048):  # so many rows of the dense table at a time
                mine = (at >= first) & (at < first + 2048)
                k = ids[first:first + 2048]
                here = at[mine] - first
                t = np.bincount((here * 2 + side[mine]) * total + classes[o[mine]], n[mine], len(k) * 2 * total).reshape(len(k), 2, total)
                twice = np.bincount(here, n[mine] * ((w[mine] == o[mine]) & (side[mine] == 1)), len(k))
                best = moves(t[:, 0], t[:, 1], twice, classes[k], t[:, 1].sum(1), table, free)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(best)], ["w", "c"])

        new = classes.copy()
        got = packed.mapInArrow(run, "w long, c long").toPandas()
        new[got["w"].to_numpy()] = got["c"].to_numpy()
        new_table = _class_pairs(packed, new, total)
        up = likelihood(new_table) - log[-1]
        if up < 0:
            parts *= 2
            if parts > 64:
                break
            turn, gained = turn % parts, []
            continue
        classes, table = new, new_table
        log.append(log[-1] + up)
        gained, turn = [*gained, up][-parts:], (turn + 1) % parts
        if len(gained) == parts and sum(gained) < GAIN * abs(log[-1]):
            break
    return classes, table


def transitions(table: np.ndarray, weight: float = 10.0) -> np.ndarray:
    """log10 of P(class | class before): counts, with `weight` more spread as the classes' own shares."""
    share = table.sum(0) + 1.0
    share /= share.sum()
    return np.log10((table + weight * share) / (table.sum(1, keepdims=True) + weight))


def scored(docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with id, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity, learnt from the rows where `train`.

    The model's probability of a token is P(its class | class before) * P(token | class). A head word's class was found by
    exchange; other words have their shape's class, in which each gives up DISCOUNT of its count to unknown words, of which
    there are taken to be as many kinds as there are words seen once, and one more. An end is a class of its own and also stands before the first word. Null and empty texts are one end. Rows that
    repeat are scored alike, null ids too; very long texts are scored whole; ties in count go by the word. Without training rows all
    counts are 0 and classes are equally likely. An empty table gives no rows; further columns play no part.
    """
    spark = docs.sparkSession
    taught = docs.where(train)
    counts = stored(word_counts(taught, text))
    ends = taught.count()
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    known = frequent(counts, KNOWN)
    symbols = Symbols([w for w, _ in known], [c for _, c in known])
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(symbols))
    pairs = stored(pair_counts(taught, text, sent, symbols.size))
    classes, table = exchange(pairs, symbols)
    total = len(table)
    free = total - 1 - SHAPES
    # per class: tokens; per shape: words, those seen once, the share kept for words never seen, and what known words are divided by
    mass = np.maximum(table.sum(0), 1.0)
    kinds, once = np.zeros(SHAPES), np.zeros(SHAPES)
    head = spark.createDataFrame([(w,) for w, _ in known[: symbols.head]], "word string")
    rare = counts.join(F.broadcast(head), "word", "left_anti")
    for r in rare.groupBy(shape_of(F.col("word")).alias("s")).agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("o")).collect():
        kinds[r["s"]], once[r["s"]] = r["k"], r["o"]
    kept = (DISCOUNT * kinds + 1.0) / (mass[free + 1:] + 2.0)
    shared = np.log10(1 - kept) - np.log10(np.maximum(mass[free + 1:] - DISCOUNT * kinds, DISCOUNT))
    step = transitions(table)
    unit = float(np.log10(n + 0.5 * (v + 1)))
    ranks, sym_known = np.arange(len(known)), symbols.sym[:-1]
    in_head = ranks < symbols.head
    emit = np.zeros(0)
    if len(known):
        apart = shared[np.clip(sym_known, 1, SHAPES) - 1]
        emit = np.where(in_head, np.log10(symbols.counts) - np.log10(mass[classes[sym_known]]), np.log10(np.maximum(symbols.counts - DISCOUNT, DISCOUNT)) + apart)
    base_known = np.log10(symbols.counts + 0.5) - unit
    base_end = float(np.log10(ends + 0.5)) - unit
    model = spark.sparkContext.broadcast(cloudpickle.dumps((symbols, classes, step, emit, base_known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, classes, step, emit, base_known = cloudpickle.loads(model.value)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for x in b.column(1):
                words = split(x.as_py())
                sym, at = symbols.of(words)
                line = classes[np.concatenate(([0], sym, [0]))]
                got = at[at >= 0]
                rest = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                for c, y in zip(cols, (len(words) + 1, len(got) + (ends > 0), base_known[got].sum() + base_end,
                                       emit[got].sum() + step[line[:-1], line[1:]].sum(), list(rest), list(rest.values()))):
                    c.append(y)
            words_ = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(c) for c in cols[4]]))).astype(np.int32),
                                              _texts([w for c in cols[4] for w in c]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols[:4], (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                 words_, pa.array(cols[5], pa.list_(pa.int64()))], ["id", "n_tokens", "n_known", "base", "model", "words", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(id_col, text).mapInArrow(
        run, f"id {kind}, n_tokens long, n_known long, base double, model double, words array<string>, times array<long>")
    got = stored(got.withColumn("row", F.monotonically_increasing_id()))
    rest = got.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    c = F.coalesce(F.col("n"), F.lit(0))
    per_shape = F.lit([float(x) for x in shared]).cast("array<double>")
    unknown = F.lit([float(x) for x in np.log10(kept / (once + 1.0))]).cast("array<double>")
    s = (shape_of(F.col("word")) + 1).cast("int")
    rest = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_known"),
        F.sum(F.col("k") * (F.log10(c + 0.5) - unit)).alias("_base"),
        F.sum(F.col("k") * F.when(c > 0, F.log10(F.greatest(c, F.lit(1)) - DISCOUNT) + F.element_at(per_shape, s)).otherwise(F.element_at(unknown, s))).alias("_model"))
    got = got.drop("words", "times").join(rest, "row", "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return got.select(F.col("id").alias(id_col), "n_tokens", plus("n_known", "_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      plus("base", "_base").alias("base_score"), plus("model", "_model").alias("score")).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model of those that are not held out; see scored()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = scored(docs, ~out)
    return got.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
