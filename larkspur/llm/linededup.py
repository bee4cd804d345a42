"""Line dedup: a segment-partition edit join over the distinct lines of a corpus, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, joined_small, let_go, stored, tidy, trimmed

#: Edits up to which two lines are one.
EDITS = 2
#: Lines of fewer characters take no part in the edit join; the query and the pipeline take them as one only if they are equal.
LEAST_CHARS = 24
#: Rows of a segment index entry above which it is refined before its pairs are made.
CROWDED = 24
#: The same for refined entries, whose pairs the join itself verifies.
REFINED = 128
#: Rows up to which a table of bare ids is broadcast (some 10 MB); beyond it the lines are shuffled to the ids.
IDS = 400_000
#: Columns of the edit matrix after which a pair that is too far apart is given up.
_COLUMNS = 24


def _piece(text: Column, start: Column, n: Column) -> Column:
    return F.substring(text, start * 4 + 1, n * 4)


def _without(text: Column, start: Column, n: Column) -> Column:
    """The text but for n characters from `start`."""
    return F.concat(F.substring(text, F.lit(1), start * 4), F.substring(text, (start + n) * 4 + 1, F.length(text)))


def _size(text: str) -> Column:
    """Characters of a text in UTF-32."""
    return F.shiftright(F.length(text), 2)


def _entries(level: DataFrame, cases: list[tuple[int, int, int]], edits: int, rest: bool, probe: bool, only: str | None = None) -> DataFrame:
    """(id, sig, and gap of a probe or n, and rest) of each row (id, key, s) for each case (gap, segment, shift) that fits it.

    The cases are a literal table that rows are multiplied with, so that all that follows is plain projection, which
    Spark compiles whole. only: the column with the one gap that counts for a row.
    """
    k = edits + 1
    table = F.array(*[F.struct(F.lit(g).alias("_gap"), F.lit(i).alias("_i"), F.lit(o).alias("_off")) for g, i, o in cases])
    at = level.select("id", "key", "s", _size("s").alias("_n"), *[only] * bool(only), F.inline(table))
    if only:
        at = at.where(F.col("_gap") == F.col(only))
    n = F.col("_n") - F.col("_gap")
    base = F.call_function("div", n, F.lit(k)).cast("int")
    late = n - base * k - k + F.col("_i")  # of the longer segments, which come last, how many precede this one
    at = at.select("id", "key", "s", "_n", "_gap", "_i", (base * F.col("_i") + F.greatest(late, F.lit(0)) + F.col("_off")).alias("_start"),
                   (base + (late >= 0).cast("int")).alias("_w"))
    at = at.where((F.col("_start") >= 0) & (F.col("_start") + F.col("_w") <= F.col("_n")) & (F.col("_n") > F.col("_gap")))
    sig = F.xxhash64("key", F.col("_n") - F.col("_gap"), "_i", _piece(F.col("s"), F.col("_start"), F.col("_w")))
    left = [_without(F.col("s"), F.col("_start"), F.col("_w")).alias("rest")] * rest
    return at.select("id", sig.alias("sig"), F.col("_gap").alias("gap") if probe else F.col("_n").alias("n"), *left)


def _indexed(level: DataFrame, edits: int, rest: bool) -> DataFrame:
    """The index entries of `s`: one signature per segment, of the segment's place, the length of s and `key`."""
    return _entries(level, [(0, i, 0) for i in range(edits + 1)], edits, rest, False)


def _probed(level: DataFrame, edits: int, rest: bool, only: str | None = None) -> DataFrame:
    """The probes of `s` for texts shorter by 0 to `edits` characters: the substrings that can meet segment i.

    With i segments before it holding at most i edits, and the others at most edits - i (Li et al. 2011), the start is within i
    of the segment's place, and within edits - i of that place moved by the gap. only: the column of the one gap to probe, else all.
    """
    cases = [(gap, i, off) for gap in range(edits + 1) for i in range(edits + 1)
             for off in range(max(-i, gap - (edits - i)), min(i, gap + (edits - i)) + 1)]
    return _entries(level, cases, edits, rest, True, only)


def _met(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """Pairs of ids that share a signature; of equal lengths each pair comes once. Where the rows carry what is left of
    their lines, the join itself holds that to the limit, so that it emits only true pairs.
    """
    i = index.drop("n").withColumnsRenamed({"id": "a", "rest": "_ra", "sig": "_s"})
    p = probe.withColumnsRenamed({"id": "b", "rest": "_rb"})
    on = (F.col("_s") == F.col("sig")) & (((F.col("gap") > 0) & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b")))
    if "_ra" in i.columns:
        on = on & (edits_within(F.col("_ra"), F.col("_rb"), edits) <= edits)
    return i.join(p, on).select("a", "b")


def candidates(lines: DataFrame, edits: int = EDITS, crowded: int = CROWDED, refined: int = REFINED) -> DataFrame:
    """Pairs (a, b) of ids of the distinct lines (id, line) that share a segment where edits allow; every pair within
    `edits` is among them.

    A segment that more than `crowded` lines share is not paired at once. Its lines lose the shared segment; what is
    left must again be within `edits`, so it is split and probed in the same way under that signature, until few lines
    share a signature or what is left is no longer than `edits`. Then any two are within `edits` once more, and each is
    paired with the least id of them only, which keeps them connected. So no pair of a crowd is lost to the components.
    """
    # UTF-32 gives every character four bytes, so that a substring is found without reading what is before it
    level = lines.select(F.lit(0).cast("long").alias("key"), "id", F.encode("line", "UTF-32").alias("s"))
    index = whole = stored(_indexed(level, edits, False))
    probe = _probed(level, edits, False)
    found: DataFrame | None = None
    while True:
        hot = cut(index.groupBy("sig").agg(F.count("*").alias("_k"), F.min("n").alias("_n")).where(F.col("_k") > (refined if "rest" in index.columns else crowded)).select("sig", "_n"))
        hot, sizes = hot.select("sig"), hot.select(F.explode(F.sequence(F.col("_n"), F.col("_n") + edits)).alias("_n")).distinct()
        some = hot.limit(1).count() > 0
        calm_i, calm_p = index, probe
        if some:
            calm_i, calm_p = (joined_small(x, hot, "sig", "left_anti") for x in (calm_i, calm_p))
        pairs = _met(calm_i, calm_p, edits)
        found = cut(pairs.distinct() if found is None else pairs.union(found).distinct())
        if not some:
            let_go(whole)
            return found
        if "rest" not in index.columns:
            # only lines of the crowds' lengths can be among them
            some_lines = joined_small(lines.withColumn("_n", F.length("line")), cut(sizes), "_n", "left_semi").drop("_n")
            some_lines = some_lines.select(F.lit(0).cast("long").alias("key"), "id", F.encode("line", "UTF-32").alias("s"))
            who_i = joined_small(_indexed(some_lines, edits, False), hot, "sig", "left_semi")
            who_p = joined_small(_probed(some_lines, edits, False), hot, "sig", "left_semi")
            ids = cut(who_i.select("id").union(who_p.select("id")).distinct())
            text = cut(joined_small(level, ids, "id", "left_semi", IDS))
            index = joined_small(_indexed(text, edits, True), hot, "sig", "left_semi")
            probe = joined_small(_probed(text, edits, True), hot, "sig", "left_semi")
        else:
            index, probe = (joined_small(x, hot, "sig", "left_semi") for x in (index, probe))
        index, probe = cut(index), cut(probe)
        short_i, short_p = index.where(_size("rest") <= edits), probe.where(_size("rest") <= edits)
        ends = short_i.select("sig", "id").union(short_p.select("sig", "id"))
        low = ends.groupBy("sig").agg(F.min("id").alias("a"))
        stars = ends.join(low, "sig").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        found = cut(found.union(stars))
        one = index.where(_size("rest") > edits).select("id", F.col("sig").alias("key"), F.col("rest").alias("s"))
        two = probe.where(_size("rest") > edits).select("id", F.col("sig").alias("key"), F.col("rest").alias("s"), F.col("gap").alias("_g"))
        index = cut(_indexed(one, edits, True))
        probe = cut(_probed(two, edits, True, "_g"))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _common(a: Column, b: Column, most: Column, at_end: bool, done: Column | None = None) -> Column:
    """Characters that two UTF-32 texts share at their start, or end, up to `most`; by steps of falling powers of two."""
    powers = F.transform(F.sequence(F.ceil(F.log2(most + 1.0)).cast("int"), F.lit(0)), lambda i: F.pow(F.lit(2.0), i).cast("int"))

    def part(x: Column, p: Column, w: Column) -> Column:
        return _piece(x, F.shiftright(F.length(x), 2) - p - w if at_end else p, w)

    return F.aggregate(powers, F.lit(0), lambda p, w: F.when((p + w <= most) & (part(a, p, w) == part(b, p, w)), p + w).otherwise(p))


def edits_within(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two UTF-32 texts if it is at most `edits`, else a greater number.

    Common ends are dropped. Then bit-parallel over the band of 2 * edits + 1 diagonals (Hyyro 2003): bit t of a
    column's word stands for row j - edits + t, vertical differences are kept in two words, and the score follows the
    lowest diagonal. A pair is given up once the lowest diagonal is too high to come back.
    """
    def sized(s: Column) -> Column:
        most = F.shiftright(F.least(F.length(s["a"]), F.length(s["b"])), 2)
        return _let(_common(s["a"], s["b"], most, False), lambda p: _let(
            _common(s["a"], s["b"], most - p, True), lambda q: _banded(s, p, q, edits)))

    far = F.abs(F.length(a) - F.length(b)) > 4 * edits
    return F.when(far, F.lit(3 * edits + 1)).otherwise(_let(F.struct(a.alias("a"), b.alias("b")), sized))


def _banded(s0: Column, p: Column, q: Column, k: int) -> Column:
    w = 2 * k + 1
    full = (1 << w) - 1
    m, n = (F.shiftright(F.length(s0[c]), 2) - p - q for c in ("a", "b"))
    lit = lambda v: F.lit(v).cast("long")

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(lit(full))

    def bits(j: Column, ch: Column) -> Column:
        out = lit(0)
        for t in range(w):
            row = j - k + t
            out = out + F.when((row >= 1) & (row <= m) & (_piece(s0["a"], p + row - 1, F.lit(1)) == ch), lit(1 << t)).otherwise(lit(0))
        return out

    def step(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]

        def go(pm: Column) -> Column:
            x = pm.bitwiseAND(vp) + vp
            d0 = x.bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(lit(full))
            return _let(d0, done)

        def done(d: Column) -> Column:
            hp = vn.bitwiseOR(flip(d.bitwiseOR(vp)))
            hn = d.bitwiseAND(vp)
            down = F.shiftright(d, 1)
            return F.struct(
                hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                (s["score"] + F.when(d.bitwiseAND(lit(1 << 2 * k)) == 0, 1).otherwise(0)).alias("score"))

        one = _let(_piece(s0["b"], p + j - 1, F.lit(1)), lambda ch: _let(bits(j, ch), go))
        return F.when(s["score"] > 3 * k, s).otherwise(one)

    def end(s: Column) -> Column:
        # rows m + 1 to n + k of the last column lie below the wanted one; vp and vn have moved down one row
        below = F.call_function("shiftleft", lit(1), (n + k - m).cast("int")) - 1
        mask = F.call_function("shiftleft", below, (m + k - n).cast("int"))
        gap = F.bit_count(s["vp"].bitwiseAND(mask)) - F.bit_count(s["vn"].bitwiseAND(mask))
        return F.when(s["score"] > 3 * k, s["score"]).otherwise(s["score"] - gap)

    def block(s: Column, j: Column) -> Column:
        ours = F.sequence(j, F.least(j + (_COLUMNS - 1), n))
        return F.when(s["score"] > 3 * k, s).otherwise(F.aggregate(ours, s, step))

    start = F.struct(lit(full ^ ((1 << k) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(k).alias("score"))
    run = F.aggregate(F.sequence(F.lit(1), n, F.lit(_COLUMNS)), start, block, end)
    return F.when((n < 1) | (m < 1), F.greatest(n, m)).otherwise(run)


def _measured(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) whose lines are within `edits`."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    text = cut(joined_small(lines.select("id", "line"), ids, "id", "left_semi", IDS))
    text = text.select("id", F.encode("line", "UTF-32").alias("s"))
    at = pairs.join(text.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    at = at.join(text.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return at.where(edits_within(F.col("sa"), F.col("sb"), edits) <= edits).select("a", "b")


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("decimal(20,0)").alias("doc"), F.xxhash64(text).alias("th"),
                       F.posexplode(F.split(text, "\n")).alias("no", "line"))


def _key(line: Column | str) -> Column:
    """What joins know a line by."""
    return F.xxhash64(line)


def _tag(line: Column | str) -> Column:
    """64 bits more, which tell lines of one key apart."""
    return F.xxhash64(F.lit(1), line)


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text: str = "text",
                  short: bool = False) -> DataFrame:
    """(doc, th, drop): for each document with lines to drop, their places from 0; th is xxhash64 of its text.

    Lines of at least `least` characters form classes: components under links of at most `edits` edits. Shorter lines are
    a class with their exact copies if `short`, else stay; those of blanks alone always stay. Of each class the line stays
    that comes first by (id, place); all others go. Ids are whole numbers; rows without one count as the first. Lines
    are known by 64 bits, and two lines of one key are found by 64 bits more and keyed anew. Rows that repeat id and
    text share a decision. Null texts have no lines, very long ones are split whole, an empty table gives no rows.
    """
    every = _lines(docs, id_col, text).where((F.length("line") >= least) | (F.lit(short) & (trimmed("line") != ""))).withColumn("id", _key("line"))

    def distinct(rows: DataFrame) -> DataFrame:
        tag = _tag("line")
        return stored(rows.groupBy("id").agg(F.first("line").alias("line"), F.min(tag).alias("_lo"), F.max(tag).alias("_hi")))

    lines = distinct(every)
    twins = cut(lines.where("_lo <> _hi").select("id", F.lit(True).alias("_twin")))
    if twins.limit(1).count():  # two lines of one key: as good as never, and then these are keyed anew by both hashes
        new = F.when(F.col("_twin"), F.xxhash64("id", _tag("line"))).otherwise(F.col("id"))
        every = joined_small(every, twins, "id", "left").withColumn("id", new).drop("_twin")
        let_go(lines)
        lines = distinct(every)
    spot = F.coalesce("doc", F.lit("-1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("no")
    spots = stored(every.select("doc", "th", "no", "id", spot.cast("decimal(38,0)").alias("spot")))
    held, lines = lines, lines.where(F.length("line") >= least).select("id", "line")
    firsts = spots.groupBy("id").agg(F.min("spot").alias("first"), F.count("*").alias("n"))
    edges = cut(_measured(candidates(lines, edits), lines, edits))
    roots = cut(components(edges))
    at = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left")
    at = cut(at.where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "id")))
    stay = at.groupBy("root").agg(F.min("first").alias("stay"))
    at = cut(at.join(stay, "root").select("id", "stay"))
    gone = joined_small(spots, at, "id").where("spot <> stay")
    gone = cut(gone.groupBy("doc", "th").agg(F.collect_set("no").alias("drop")))
    for x in (spots, held):
        let_go(x)
    tidy(docs.sparkSession)
    return gone


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text: str = "text",
                short: bool = False) -> DataFrame:
    """The rows of `docs` with the repeated lines taken out of `text`; see dropped_lines(). Null texts stay null."""
    gone = dropped_lines(docs, edits, least, id_col, text, short).withColumnsRenamed({"doc": "_doc", "th": "_th", "drop": "_drop"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # one column, so that no name clashes
    at = docs.select(row.alias("_row"), F.col(id_col).cast("decimal(20,0)").alias("_id"), F.xxhash64(text).alias("_text"))
    at = at.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_th")), "left")  # by shuffle at every size: the lists have no bound
    whole = F.col("_row")[text]
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return at.select(*[F.when(F.col("_drop").isNull(), whole).otherwise(left).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped) for every document; dropped lists the places of its lines that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = dropped_lines(docs, short=True)
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("th"), n.alias("n_lines"))
    same = (all_docs["doc_id"].cast("decimal(20,0)").eqNullSafe(gone["doc"])) & (all_docs["th"] == gone["th"])
    drop = F.coalesce(F.array_sort("drop"), F.array().cast("array<int>"))
    return all_docs.join(gone, same, "left").select(  # by shuffle at every size: the lists have no bound
        all_docs["doc_id"], "n_lines", (F.col("n_lines") - F.size(drop)).alias("n_kept"), drop.alias("dropped"))


def stage_linededup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; a document all of whose lines go is left out, and so is one without a
    word to begin with: a null, empty or blank text. Other columns come back as they are.
    """
    return dedup_lines(docs, short=True).where(trimmed("text") != "")


def _sql(edits: int = EDITS, least: int = LEAST_CHARS) -> str:
    """The same by trying all pairs of about one length that share a third of a line, and the least line reachable."""
    piece = lambda i: f"contains(b.line, substr(a.line, a.w * {i} + 1, {'a.w' if i < edits else 'a.n - a.w * ' + str(i)}))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
every AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM d WHERE text IS NOT NULL),
spots AS (SELECT * FROM every WHERE length(line) >= {least} OR regexp_matches(line, '[^\x20\x09-\x0D]')),
kinds AS (SELECT line, length(line) AS n, length(line) // {edits + 1} AS w, row_number() OVER () AS k FROM spots WHERE length(line) >= {least} GROUP BY line),
pairs AS (SELECT a.k AS x, b.k AS y, a.line AS p, b.line AS q FROM kinds a JOIN kinds b ON b.n BETWEEN a.n AND a.n + {edits} AND a.k <> b.k
          WHERE {' OR '.join(piece(i) for i in range(edits + 1))}),
-- DuckDB counts bytes: of each pair, characters of several bytes become such of one that neither line has
odd AS (SELECT *, list_filter(list_distinct(string_split(p || q, '')), lambda c: octet_length(encode(c)) > 1) AS wide,
               list_filter(list_transform(range(1, 128), lambda i: chr(i::INT)), lambda c: NOT contains(p || q, c)) AS free FROM pairs),
near AS (SELECT x, y FROM odd WHERE levenshtein(translate(p, array_to_string(wide, ''), array_to_string(free[1:len(wide)], '')),
                                                translate(q, array_to_string(wide, ''), array_to_string(free[1:len(wide)], ''))) <= {edits}),
links AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach(k, c) AS (SELECT k, k FROM kinds UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.k),
classes AS (SELECT line, 'k' || min(c)::VARCHAR AS class FROM reach JOIN kinds USING (k) GROUP BY line),
placed AS (SELECT rid, doc_id, no, coalesce(class, 's' || line) AS class FROM spots LEFT JOIN classes USING (line)),
ranked AS (SELECT rid, no, dense_rank() OVER (PARTITION BY class ORDER BY doc_id NULLS FIRST, no) AS r FROM placed),
gone AS (SELECT rid, list(no::INT ORDER BY no) AS dropped FROM ranked WHERE r > 1 GROUP BY rid)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, n_lines - len(coalesce(dropped, [])) AS n_kept, coalesce(dropped, []::INT[]) AS dropped
FROM d LEFT JOIN gone USING (rid)
"""


SQL = _sql()
