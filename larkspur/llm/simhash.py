"""SimHash near-duplicates through anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, joined_small

#: Shingles hashed at a time, so that one very long text needs no more memory than this.
_BLOCK = 1 << 15
#: Fingerprints of one anchor up to which all meet.
CROWDED = 64
#: Rows up to which hashes of rows are broadcast (some 15 MB); beyond it rows are shuffled to them.
IDS = 400_000


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42, unsigned) of the word shingles with repeats, _BLOCK at a time; see fingerprints()."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k, h = min(width, len(w)), xxhash.xxh64_intdigest
    starts, ends = starts[: len(w) - k + 1], ends[k - 1:]
    for at in range(0, len(starts), _BLOCK):
        a, b = starts[at:at + _BLOCK].tolist(), ends[at:at + _BLOCK].tolist()
        yield np.array([h(joined[i:j], 42) for i, j in zip(a, b)], dtype="<u8")


def summed(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of the word shingles, unsigned; see fingerprints()."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width):
        ones += summed(h)
        total += len(h)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long) of every row: A-Z lower-cased, shingles of `width` words with repeats, XXH64 with seed 42, a bit
    set if over half of the hashes have it. Fewer words: one shingle of them all. None, or null: 0.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _code() -> tuple[np.ndarray, np.ndarray]:
    """For each 7-bit word: the codeword of the perfect Hamming code within distance 1, and those at distance 2.

    A word is a codeword if the XOR of its set positions, counted from 1, is 0. Absent entries are -1.
    """
    def syndrome(v: int) -> int:
        s = 0
        for i in range(7):
            s ^= (i + 1) * (v >> i & 1)
        return s

    codewords = [v for v in range(128) if not syndrome(v)]
    home = np.array([next(c for c in codewords if (c ^ v).bit_count() <= 1) for v in range(128)], dtype=np.int64)
    near = [[c for c in codewords if (c ^ v).bit_count() == 2] for v in range(128)]
    return home, np.array([x + [-1] * (3 - len(x)) for x in near], dtype=np.int64)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint in fps, anchor) for every anchor that a fingerprint is replicated to.

    Anchors are the codewords of nine Hamming (7,4) blocks and one free bit: covering radius 1 in each block, 0 in the
    free bit. Two fingerprints at distance 2 or less have a midpoint at distance 1 or less from both. The midpoint's
    anchor is within the covering radius of it, so it is within the radius plus one differing bit of both: it equals
    their home anchor but for one block at distance 2 at most, or but for the free bit. All those are emitted, 29 at most.
    """
    home, near = _code()
    v = fps.astype(np.uint64)
    blocks = [((v >> np.uint64(7 * i)) & np.uint64(127)).astype(np.int64) for i in range(9)]
    at_home = v & np.uint64(1 << 63)
    for i, b in enumerate(blocks):
        at_home = at_home | (home[b].astype(np.uint64) << np.uint64(7 * i))
    place = np.arange(len(v))
    who, which = [place, place], [at_home, at_home ^ np.uint64(1 << 63)]
    for i, b in enumerate(blocks):
        rest = at_home & ~np.uint64(127 << (7 * i))
        for k in range(3):
            c = near[b, k]
            ok = c >= 0
            who.append(place[ok])
            which.append(rest[ok] | (c[ok].astype(np.uint64) << np.uint64(7 * i)))
    return np.concatenate(who), np.concatenate(which).view(np.int64)


def near_pairs(fps: DataFrame, bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a < b as signed longs) of distinct fingerprints `fp` that differ in at most `bits` (0 to 2) bits.

    At an anchor of more than `crowded` fingerprints only those meet that agree on one of bits + 1 blocks, as any two within
    `bits` do.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the covering code serves thresholds of 0 to 2 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            who, which = anchors(f.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(f[who])], ["anchor", "fp"])

    def met(sent: DataFrame, keys: list[str]) -> DataFrame:
        left, right = sent.withColumnRenamed("fp", "a"), sent.withColumnRenamed("fp", "b")
        close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        return left.join(right, keys).where(close).select("a", "b")

    sent = fps.mapInArrow(run, "anchor long, fp long")
    hot = cut(sent.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > crowded).select("anchor"))
    if not hot.limit(1).count():
        return met(sent, ["anchor"]).distinct()
    width = 64 // (bits + 1) + 1
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), F.call_function("shiftrightunsigned", F.col("fp"), F.lit(width * i)).bitwiseAND(F.lit((1 << width) - 1)).alias("block"))
                       for i in range(bits + 1)]) if bits else F.array(F.struct(F.lit(0).alias("i"), F.col("fp").alias("block")))
    split = joined_small(sent, hot, "anchor", "left_semi").select("anchor", "fp", F.inline(blocks))
    return met(joined_small(sent, hot, "anchor", "left_anti"), ["anchor"]).union(met(split, ["anchor", "i", "block"])).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links of at most `bits` bits.

    Texts without words, and null ones, have fingerprint 0 and link like any other. Rows that repeat an id with several
    texts get a row each. An empty table gives an empty result. Only distinct fingerprints are compared, so copies
    cost no pairs.
    """
    at = cut(fingerprints(docs, width, id_col, text))
    classes = cut(at.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(near_pairs(classes.select("fp"), bits))
    linked = cut(roots.join(classes.withColumnRenamed("fp", "node"), "node").select("node", "root", "first"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("_c"))
    named = cut(classes.join(linked, "fp", "left").select("fp", F.coalesce("_c", "first").alias("component_id")))
    return joined_small(at, named, "fp").select(id_col, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by fingerprints of 3-word shingles that link at 2 bits; see near_duplicates()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, width=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id, a null id coming last, then by two hashes of
    the row. Rows that repeat it whole stay once. Ids need not be unique: rows are known by 128 bits of all their columns,
    which come back as they are whatever their names. Null texts and such without words are near copies of one another. An
    empty table stays empty.

    Groups are components under Jaccard similarity of 0.8 or more on 5-word shingles; SimHash anchors propose pairs and
    MinHash bands those beyond their reach; see near_copies().
    """
    from .jaccard import near_copies  # which itself builds on this module

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    flags = [F.col(f"`{c}`").isNull() for c in docs.columns]  # since a hash passes nulls over
    keyed = docs.select(row.alias("_row"), F.xxhash64(row, *flags).alias("_h1"), F.xxhash64(F.lit(1), row, *flags).alias("_h2"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_h1", "_h2")).alias("least")
    narrow = keyed.select(F.col("_row.doc_id").alias("id"), "_h1", "_h2", F.xxhash64("_row.text").alias("th"))
    at = cut(narrow.groupBy("th").agg(least))
    at = joined_small(at, near_copies(docs.select("text")), "th").select("root", "least.*")
    kept = cut(at.groupBy("root").agg(least).select("least._h1", "least._h2"))
    return joined_small(keyed, kept, ["_h1", "_h2"], "left_semi", IDS).dropDuplicates(["_h1", "_h2"]).select("_row.*")


#: The primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _sql(width: int = 3, bits: int = 2, seed: int = 42) -> str:
    """The same with XXH64 written out in 128-bit whole numbers, and all pairs of distinct fingerprints."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _PRIMES)
    whole = f"{1 << 64}::UHUGEINT"

    def kept(x: str) -> str:
        return f"(({x}) % {whole})::UBIGINT"

    def times(a: str, b: str) -> str:
        return kept(f"({a})::UHUGEINT * {b}")

    def plus(a: str, b: str) -> str:
        return kept(f"({a})::UHUGEINT + {b}")

    def turned(x: str, by: int) -> str:
        return f"({kept(f'({x})::UHUGEINT * {1 << by}::UHUGEINT')} | (({x}) >> {64 - by}))"

    def lane(at: str, n: int) -> str:
        """The number in n bytes of x from a place, least byte first."""
        return "('0x' || " + " || ".join(f"substr(x, (2 * ({at}) + {2 * i + 1})::INT, 2)" for i in reversed(range(n))) + ")::UBIGINT"

    def mixed_in(h: str, k: str, by: int, p: str, q: str | None) -> str:
        got = times(turned(f"xor({h}, {k})", by), p)
        return plus(got, q) if q else got

    first = [(seed + _PRIMES[0] + _PRIMES[1]) % (1 << 64), (seed + _PRIMES[1]) % (1 << 64), seed, (seed - _PRIMES[0]) % (1 << 64)]
    sums = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda i: {times(lane(f'32 * i + {8 * j}', 8), p2)}), lambda a, k: "
                     f"{times(turned(plus('a', 'k::UHUGEINT'), 31), p1)}, {v}::UBIGINT) AS v{j}" for j, v in enumerate(first))
    joined = " + ".join(f"{turned(f'v{j}', by)}::UHUGEINT" for j, by in enumerate((1, 7, 12, 18)))
    steps = [f"g{j + 1} AS (SELECT *, {plus(times(f'xor(h{j}, {times(turned(times(f'v{j}', p2), 31), p1)})', p1), p4)} AS h{j + 1} FROM g{j})" for j in range(4)]
    count = ", ".join(f"sum(c * ((h >> {b}) & 1)::BIGINT) AS b{b}" for b in range(64))
    bit = " + ".join(f"(CASE WHEN 2 * b{b} > total THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END)" for b in range(64))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT rid, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT rid, sh FROM (SELECT rid, n, i, concat_ws(' ', x{''.join(f', lead(x, {j}) OVER p' for j in range(1, width))}) AS sh FROM u WINDOW p AS (PARTITION BY rid ORDER BY i))
      WHERE i <= greatest(n - {width - 1}, 1)),
k AS (SELECT sh, hex(encode(sh)) AS x, octet_length(encode(sh)) AS n FROM (SELECT DISTINCT sh FROM s)),
v AS (SELECT sh, x, n, {sums} FROM k WHERE n >= 32),
g0 AS (SELECT sh, x, n, v0, v1, v2, v3, {kept(joined)} AS h0 FROM v),
{', '.join(steps)},
m AS (SELECT sh, x, n, {plus('h4', 'n::UHUGEINT')} AS h FROM g4 UNION ALL SELECT sh, x, n, {plus(f'{(seed + _PRIMES[4]) % (1 << 64)}::UBIGINT', 'n::UHUGEINT')} FROM k WHERE n < 32),
e AS (SELECT sh, x, n, n // 8 * 8 AS pos, list_reduce(list_transform(range(n % 32 // 8), lambda i: {times(turned(times(lane('n // 32 * 32 + 8 * i', 8), p2), 31), p1)}),
             lambda a, k: {mixed_in('a', 'k', 27, p1, p4)}, h) AS h FROM m),
f AS (SELECT sh, x, n, pos + n % 8 // 4 * 4 AS pos, CASE WHEN n % 8 >= 4 THEN {mixed_in('h', times(lane('pos', 4), p1), 23, p2, p3)} ELSE h END AS h FROM e),
b AS (SELECT sh, list_reduce(list_transform(range(n - pos), lambda i: {times(lane('pos + i', 1), p5)}), lambda a, k: {mixed_in('a', 'k', 11, p1, None)}, h) AS h FROM f),
x AS (SELECT sh, xor(h, h >> 33) AS h FROM b), y AS (SELECT sh, {times('h', p2)} AS h FROM x), z AS (SELECT sh, xor(h, h >> 29) AS h FROM y),
q AS (SELECT sh, {times('h', p3)} AS h FROM z), hashes AS (SELECT sh, xor(h, h >> 32) AS h FROM q),
counted AS (SELECT rid, sum(c) AS total, {count} FROM (SELECT rid, sh, count(*) AS c FROM s GROUP BY ALL) JOIN hashes USING (sh) GROUP BY rid),
prints AS (SELECT rid, doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT rid, {bit} AS fp FROM counted) USING (rid)),
firsts AS (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
links AS (SELECT a.fp AS x, b.fp AS y FROM firsts a JOIN firsts b ON a.fp <> b.fp WHERE bit_count(xor(a.fp, b.fp)::BIT) <= {bits}),
reach(fp, far) AS (SELECT fp, fp FROM firsts UNION SELECT reach.fp, links.y FROM reach JOIN links ON links.x = reach.far),
roots AS (SELECT r.fp, min(f.first) AS component_id FROM reach r JOIN firsts f ON f.fp = r.far GROUP BY r.fp)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN roots USING (fp)
"""


SQL = _sql()
