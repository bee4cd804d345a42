"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, trimmed, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this an or from at "
    "der die das und in den von zu mit ist des auf für im eine nicht ein sich dem auch es an als "
    "le la les de des du et en un une que est pour dans qui sur par au "
    "el los las y del se con una su al lo por para como"
).split()
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= top / bottom <= high (either bound may be None), or if it has fewer than `since` words."""

    name: str
    top: str
    bottom: str | None = None
    low: float | None = None
    high: float | None = None
    since: int = 0


#: The production table. Counts are columns of measured(); every line is one comparison of the projection.
RULES = (
    Rule("length", "n_words", None, 10, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.04, None, 30),
    Rule("line_copies", "n_dup_lines", "n_lines", None, 0.40),
    Rule("line_words", "n_words", "n_lines", 1.5, None, 30),
    Rule("shouting", "n_bangs", "n_words", None, 0.50),
)


def _one(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, so that later projections read them instead of repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _repeats(w: Column, h: Column) -> Column:
    """How many words lie in a window whose hash h[i] occurs twice or more.

    Windows are sorted by hash; those equal to a neighbour keep their places, and the union of windows is the sum of
    the gaps between following places, five at most.
    """
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(
        F.sort_array(F.flatten(F.transform(F.array(pairs), lambda s: F.transform(F.filter(
            F.transform(s, lambda x, j: F.struct(
                x["i"].alias("i"),
                ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])).alias("p"),
                F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)).alias("n"))),
            lambda x: x["p"] | x["n"]), lambda x: x["i"])))),
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"]))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bangs")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """(_row, then the counts): _row is the row as it came, so that no name of its columns can clash."""
    df = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = _one(df, _w=words("_t"), _l=F.filter(F.split("_t", "\n"), lambda x: trimmed(x) != ""))
    five = F.transform(F.when(F.size("_w") > 4, F.sequence(F.lit(0), F.size("_w") - 5)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(5)]))
    df = _one(df, _h=five)

    def gone(chars: str) -> Column:
        return F.length(F.translate("_t", chars, ""))

    out = {
        "n_words": F.size("_w"),
        "word_chars": gone(BLANKS),
        "n_symbols": F.length("_t") - gone(SYMBOLS),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _repeats(F.col("_w"), F.col("_h")),
        "n_stop_words": F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_bangs": F.length("_t") - gone("!"),
    }
    return _one(df, **{k: c.cast("long") for k, c in out.items()}).select("_row", *_COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def compiled(rules=RULES) -> list[Column]:
    """One boolean column per rule, true if the document breaks it; a ratio over nothing counts as 0."""
    out = []
    for r in rules:
        ratio = F.col(r.top).cast("double")
        if r.bottom:
            ratio = F.when(F.col(r.bottom) > 0, ratio / F.col(r.bottom)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratio < r.low)
        if r.high is not None:
            bad = bad | (ratio > r.high)
        out.append((bad & (F.col("n_words") >= r.since)).alias(f"fails_{r.name}"))
    return out


def _judged(docs: DataFrame, rules, text: str) -> DataFrame:
    """(_row, counts, base_failed, fails_<rule>, kept)."""
    broken = compiled(rules)
    any_broken = F.lit(False)
    for r in rules:
        any_broken = any_broken | F.col(f"fails_{r.name}")
    return _measured(docs, text).select("*", base_failed().alias("base_failed"), *broken).withColumn("kept", ~F.col("base_failed") & ~any_broken)


def judged(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Every row with the counts that rules read (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words,
    n_bangs; long), `base_failed`, one `fails_<rule>` per rule, and `kept`.

    A null or empty text has all counts 0 and fails the length rule. Repeated rows are judged alike. No row is added or
    lost, and very long texts are read whole. A column of `docs` by one of these names gives way to the result.
    """
    df = _judged(docs, rules, text)
    names = df.columns[1:]
    return df.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in names], *names)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one row each, with the base counts, each rule's finding and the verdict; see judged()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fails = [f"fails_{r.name}" for r in RULES]
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                               "base_failed", "kept", *fails)


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that judged() keeps, as they came: all columns, whatever their names, and repeated rows each. Null and
    empty texts go. An empty table stays empty.
    """
    return _judged(docs, RULES, "text").where("kept").select("_row.*")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS five
      FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) AS c FROM v WHERE five IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM h, range(5) AS t(k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, length(t) - length(replace(t, '!', '')) AS n_bangs
      FROM w LEFT JOIN r USING (rid)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words < 10 AS fails_length,
             n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 15 AS fails_word_length,
             n_words > 0 AND n_symbols / n_words > 0.25 AS fails_symbols,
             n_words >= 30 AND n_stop_words / n_words < 0.04 AS fails_stop_words,
             n_lines > 0 AND n_dup_lines / n_lines > 0.4 AS fails_line_copies,
             n_words >= 30 AND n_words / n_lines < 1.5 AS fails_line_words,
             n_words > 0 AND n_bangs / n_words > 0.5 AS fails_shouting FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR fails_length OR fails_word_length OR fails_symbols OR fails_stop_words OR fails_line_copies OR fails_line_words OR fails_shouting) AS kept,
       fails_length, fails_word_length, fails_symbols, fails_stop_words, fails_line_copies, fails_line_words, fails_shouting
FROM j
"""
