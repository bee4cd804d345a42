"""Near copies: SimHash anchors and MinHash bands link most, a prefix filter proposes all that is left; exact Jaccard similarity of word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, gathered, joined_small, let_go, stored, tidy
from .simhash import near_pairs, shingle_hashes, summed

#: Similarity from which two texts are near copies, as a fraction.
ALIKE = (4, 5)
#: Differing bits up to which anchors propose a pair.
BITS = 2
#: Bands of minima, and minima in each: two texts of similarity s share no band with probability (1 - s^4)^28, 4e-7 at 0.8.
BANDS, MINIMA = 28, 4
#: Classes of a band up to which all pairs are made; of more, each meets one of them a round, while rounds find links. What that leaves, _rest() proposes.
CROWDED = 24
#: Another round follows if one in so many candidates of a round held. It sets the time only: _rest() proposes what is left.
GAIN = 20
#: One in so many texts is read for shingles that are common. It sets the order of shingles only, and so the time, not the result.
SAMPLED = 16
#: Shingles held as common at most, those seen most often in the sample; again only for the order.
COMMON = 100_000
#: Candidates verified at a time, so that their sets need no more disk than this.
SLICE = 500_000
#: Rows up to which ids of texts are broadcast (some 10 MB); beyond it texts are shuffled to the ids.
IDS = 400_000


def digest(text: str | None, width: int) -> tuple[np.ndarray, int]:
    """(distinct XXH64 hashes of the word shingles in order, SimHash of all of them); see simhash.fingerprints()."""
    parts, ones, total = [], np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width):
        ones += summed(h)
        total += len(h)
        parts.append(np.unique(h.view(np.int64)))
    if not parts:
        return np.empty(0, dtype=np.int64), 0
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)), int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * MINIMA
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of MINIMA minima of the shingles under as many rearrangements; none for no shingles."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    times, plus = _FACTORS
    low = np.full(len(times), 2**64 - 1, dtype=np.uint64)
    h = found.view(np.uint64)
    for at in range(0, len(h), 512):
        x = h[at:at + 512, None] * times + plus
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, MINIMA).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_FACTORS = _factors()


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield part.column(0), [digest(x.as_py(), width) for x in part.column(1)]


def _signed(texts: DataFrame, width: int) -> DataFrame:
    """(th, key, n, fp, p) of rows (th, text): a hash of the shingles, their number, their SimHash and their bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, got in _batches(batches, width):
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x, _ in got], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [th, pa.array(keys), pa.array([len(x) for x, _ in got], pa.int32()), pa.array([f for _, f in got], pa.int64()),
                 pa.array([bands(x) for x, _ in got], pa.list_(pa.int64()))], ["th", "key", "n", "fp", "p"])

    return texts.mapInArrow(run, "th long, key long, n int, fp long, p array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(key, s) of rows (key, text): the low halves of the shingles' hashes, enough to count what two texts share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in _batches(batches, width):
            yield pa.RecordBatch.from_arrays([key, pa.array([np.unique(x.astype(np.int32)) for x, _ in got], pa.list_(pa.int32()))], ["key", "s"])

    return texts.mapInArrow(run, "key long, s array<int>")


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two near copies share one at least: n - ceil(0.8 n) + 1 first ones, common ones ordered last."""
    n, (p, q) = len(found), ALIKE
    if not n:
        return found
    if len(common):
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate((found[~often], found[often]))
    return found[: n - -(-n * p // q) + 1]


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that several texts of the sample hold, COMMON at most, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _batches(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in got]))], ["s"])

    sample = texts.where(F.pmod("th", F.lit(SAMPLED)) == 0).groupBy("th").agg(F.first("text").alias("text"))
    often = sample.mapInArrow(run, "s long").groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON)
    return np.sort(np.array([r["s"] for r in often.collect()], dtype=np.int64))


def _rest(texts: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of keys in different components that may be near copies, however many classes hold a shingle.

    In whatever order of shingles, the first that two near copies share lies in the prefixes of both (Chaudhuri et al. 2006), and
    they share no more than it and what follows it in either (Xiao et al. 2008). Classes of a shingle meet by steps of
    size, in as many parts as a frequent one needs.
    """
    p, q = ALIKE
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, width))  # of COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in _batches(batches, width):
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x, _ in got], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) for x, _ in got], pa.int32()),
                                              pa.array([prefix(x, common.value) for x, _ in got], pa.list_(pa.int64()))], ["key", "n", "p"])

    at = texts.mapInArrow(run, "key long, n int, p array<long>").groupBy("key").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    at = joined_small(at, roots, "key", "left", IDS).select("key", "n", F.coalesce("root", "key").alias("root"), F.posexplode("p").alias("i", "tok"))
    held = Window.partitionBy("tok")
    at = at.select("*", F.min("root").over(held).alias("low"), F.max("root").over(held).alias("high"), F.count("*").over(held).alias("k")).where("low < high")
    # sizes of near copies differ by a quarter at most, so by one of these steps; a frequent shingle is dealt to several parts
    at = at.withColumns({"step": F.floor(F.log("n") / F.lit(float(np.log(1.3)))), "parts": F.ceil(F.sqrt("k") / 32)})
    at = stored(at.drop("low", "high", "k"))
    one, two = (at.select("tok", "step", "parts", *[F.col(c).alias(f"{c}{x}") for c in ("key", "n", "root", "i")]) for x in "ab")
    one = one.withColumn("part", F.pmod(F.xxhash64("keya"), F.col("parts"))).drop("parts")
    two = two.withColumn("step", F.explode(F.array("step", F.col("step") - 1)))
    two = two.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = one.join(two, ["tok", "step", "part"]).where((F.struct("na", "keya") < F.struct("nb", "keyb")) & (F.col("roota") != F.col("rootb")))
    met = met.where(most * (p + q) >= (F.col("na") + F.col("nb")) * p)
    got = gathered(met.select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct())
    let_go(at)
    return got


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of keys whose shingles are near copies by count. Only their texts are read for shingles again."""
    p, q = ALIKE
    keys = gathered(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    asked = gathered(joined_small(classes.select("key", "th"), keys, "key", "inner", IDS))
    sets = stored(_sets(joined_small(texts, asked, "th", "inner", IDS).select("key", "text"), width).groupBy("key").agg(F.first("s").alias("s")))
    at = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
    at = at.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    got = stored(at.where(both * (p + q) >= p * (F.size("sa") + F.size("sb"))).select("a", "b"))
    let_go(sets)
    tidy(texts.sparkSession)
    return got


def _proposed(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys by SimHash: the least key of each fingerprint with the others of it, and with that of each fingerprint within BITS."""
    low = gathered(classes.groupBy("fp").agg(F.min("key").alias("a")))
    same = classes.select("fp", F.col("key").alias("b")).join(low, "fp").where("a <> b").select("a", "b")
    near = near_pairs(low.select("fp"), BITS).withColumnsRenamed({"a": "fa", "b": "fb"})
    near = near.join(low.withColumnsRenamed({"fp": "fa"}), "fa").join(low.withColumnsRenamed({"fp": "fb", "a": "b"}), "fb").select("a", "b")
    return same.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """(th, root) for each distinct text, th being its xxhash64; texts of one root are linked by Jaccard similarity of 0.8 or more.

    Texts with the same shingles are one class, and only classes are paired. First SimHash proposes pairs through its
    anchors, and those that hold are joined. Since the fingerprints of most texts of similarity 0.8 differ in more
    bits than anchors can serve, bands of minima then propose the others: the classes of a band that are not yet in one
    component meet one of them, each class one in all its bands; then all pairs are made of bands of few classes, while
    those of many go on meeting one, another each round, while rounds find links. At last a prefix filter proposes every pair
    of different components that may still hold, so neither crowded bands nor the chance of bands leave a link out; see
    _rest(). All candidates are verified on whole sets of shingles.
    """
    def rooted(edges: DataFrame) -> DataFrame:
        return gathered(components(edges).withColumnRenamed("node", "key"))

    p, q = ALIKE
    tidy(docs.sparkSession)
    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    at = stored(_signed(texts, width))
    classes = stored(at.groupBy("key").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("p").alias("p")))
    sizes = classes.select("key", "n")
    pairs = gathered(_proposed(classes).distinct())
    sized = F.least("na", "nb") * q >= F.greatest("na", "nb") * p
    for x in "ab":
        pairs = gathered(joined_small(sizes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}")), pairs, x, "inner", IDS))
    met = gathered(pairs.where(sized).select("a", "b"))
    edges = _verified(met, texts, classes, width)
    entries = classes.select("key", "n", F.explode("p").alias("tok"))
    tokens = stored(entries.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1"))
    shared = whole = stored(joined_small(entries, tokens, "tok"))
    roots = rooted(edges)
    turn, worth, before = 0, True, None
    while worth or turn < 2:
        # the bands whose classes are not yet in one component
        marked = joined_small(shared, roots, "key", "left", IDS).withColumn("root", F.coalesce("root", "key"))
        tok = marked.groupBy("tok").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min(F.struct(F.xxhash64("key", F.lit(turn)), "key", "n", "root")).alias("h"))
        hubs = stored(tok.where("_low < _high").select("tok", F.col("h.key").alias("a"), F.col("h.n").alias("na"), F.col("h.root").alias("ra")))
        other = stored(joined_small(marked.select("tok", "k", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")), hubs, "tok"))
        let_go(hubs)
        if before is not None:
            let_go(before)
        before, shared = other, other.select("tok", "k", F.col("b").alias("key"), F.col("nb").alias("n"))
        new = other.where((F.col("ra") != F.col("rb")) & sized).select("a", "na", "ra", "b", "nb", "rb")
        tried = met.union(met.select("b", "a"))
        new = joined_small(new, tried, ["a", "b"], "left_anti", IDS).groupBy("b", "nb", "rb").agg(F.min_by(F.struct("a", "na", "ra"), F.xxhash64("a", F.lit(turn))).alias("h"))
        new = new.select("h.a", "h.na", "h.ra", "b", "nb", "rb")
        if turn:
            few = other.where(F.col("k") <= CROWDED)
            new = new.union(few.select("tok", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("rb").alias("ra")).join(
                few.select("tok", "b", "nb", "rb"), "tok").where("a < b").select("a", "na", "ra", "b", "nb", "rb"))
        new = new.where((F.col("ra") != F.col("rb")) & sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = gathered(joined_small(new, met, ["a", "b"], "left_anti", IDS))
        linked = 0
        if new._rows:
            found = _verified(new, texts, classes, width)
            met, linked = gathered(met.union(new)), found.count()
            if linked:
                edges = gathered(edges.union(found))
                roots = rooted(edges)
        worth = linked and linked * GAIN >= new._rows
        turn += 1
        tidy(docs.sparkSession)
    rest = gathered(joined_small(_rest(texts, roots, width), met, ["a", "b"], "left_anti", IDS))
    many = -(-rest._rows // SLICE)
    for k in range(many):
        edges = edges.union(_verified(rest.where(F.pmod(F.xxhash64("a"), F.lit(many)) == k), texts, classes, width))
    if many:
        roots = rooted(edges)
    named = joined_small(at.select("th", "key").distinct(), roots, "key", "left", IDS)
    named = cut(named.select("th", F.coalesce("root", "key").alias("root")))
    for x in (at, classes, tokens, whole, before):
        let_go(x)
    return named
