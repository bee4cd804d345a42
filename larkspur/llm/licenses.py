"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest licensed directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined_small

#: Notices, headers and short licences in the words of their public texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
#: Names that make a file the licence of its directory.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.\-_][^/]*)?$"
#: A tag that names its licence outright.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+\-]*)"
LEAST_COSINE = 0.75
#: Terms of a text that are looked at together; with the longest template's length on either side.
BLOCK = 512


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


#: (place of a template, licence, its terms); terms that any template has.
_PARTS = [(i, name, _words_of(text)) for i, (name, text) in enumerate(TEMPLATES)]
_VOCABULARY = sorted({w for _, _, t in _PARTS for w in t})
_LONGEST = max(len(t) for _, _, t in _PARTS)


class Weights:
    """The templates' weights tf * (1 + ln((1 + N) / (1 + df))), df over all texts, and their keys.

    A template's keys are its heaviest terms, down to where what is left has less than LEAST_COSINE of its length: by
    Cauchy and Schwarz no span that lacks all of them reaches that cosine, whatever else it holds.
    """

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for w in _VOCABULARY}
        #: What a term of no template weighs: as much as those of the templates do on average.
        self.other = sum(self.idf.values()) / len(self.idf)
        self.terms, self.keys = [], {}
        for i, name, words in _PARTS:
            w = {x: k * self.idf[x] for x, k in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            self.terms += [(i, name, x, y / norm) for x, y in w.items()]
            rest = sum(x * x for x in w.values())
            for x in sorted(w, key=lambda x: (-w[x], x)):
                if rest < (LEAST_COSINE * norm) ** 2:
                    break
                rest -= w[x] * w[x]
                self.keys.setdefault(x, []).extend(i * 1000 + at for at, y in enumerate(words) if y == x)


def weights(files: DataFrame, text: str) -> Weights:
    """Weights from one pass over all texts; a row for each term of the templates reaches the driver."""
    seen = F.array_append(F.array_distinct(F.filter(_terms(F.coalesce(F.col(text), F.lit(""))), lambda w: w.isin(_VOCABULARY))), F.lit(""))
    got = {r["w"]: r["n"] for r in files.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return Weights(got, got.pop("", 0))


def spans(texts: DataFrame, w: Weights) -> DataFrame:
    """(th, tg, t, span) of rows (th, tg, text): the spans of template t's length that have one of its keys where the template has it.

    Comment marks and line ends are no terms, so a wrapped header is one run. Texts are looked at in overlapping
    blocks, so that one very long text is not one very long row.
    """
    keys = sorted(w.keys)
    lengths = F.lit([len(t) for _, _, t in _PARTS]).cast("array<int>")
    known, places = F.lit(keys).cast("array<string>"), F.lit([",".join(map(str, w.keys[k])) for k in keys]).cast("array<string>")
    at = texts.select("th", "tg", _terms(F.col("text")).alias("_w")).where(F.exists("_w", lambda x: x.isin(keys)))
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(BLOCK))
    part = lambda s: F.struct(
        F.slice("_w", F.greatest(s - _LONGEST, F.lit(0)) + 1, F.least(s, F.lit(_LONGEST)) + BLOCK + _LONGEST).alias("w"), F.least(s, F.lit(_LONGEST)).alias("lead"))
    at = at.select("th", "tg", F.explode(F.transform(starts, part)).alias("b")).select("th", "tg", "b.w", "b.lead")
    found = F.filter(F.transform("w", lambda x, i: F.when((i >= F.col("lead")) & (i < F.col("lead") + BLOCK) & x.isin(keys), i)), lambda i: i.isNotNull())

    def aligned(i: Column) -> Column:
        codes = F.split(F.get(places, F.array_position(known, F.get("w", i)).cast("int") - 1), ",").cast("array<int>")
        return F.transform(codes, lambda c: one(F.call_function("div", c, F.lit(1000)).cast("int"), i - c % 1000))

    def one(t: Column, start: Column) -> Column:
        got = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.get(lengths, t) + F.least(start, F.lit(0)))
        return F.struct(t.alias("t"), F.array_join(got, " ").alias("span"))

    return at.select("th", "tg", F.explode(F.array_distinct(F.flatten(F.transform(found, aligned)))).alias("x")).select("th", "tg", "x.t", "x.span")


def cosines(kinds: DataFrame, w: Weights) -> DataFrame:
    """(t, span, license, cosine) of the distinct rows (t, span) at LEAST_COSINE or more, to nine places."""
    spark = kinds.sparkSession
    idf = spark.createDataFrame(list(w.idf.items()), "term string, idf double")  # as many rows as the templates have terms
    made = spark.createDataFrame(w.terms, "t int, license string, term string, tw double")
    at = kinds.select("t", "span", F.explode(F.split("span", " ")).alias("term")).groupBy("t", "span", "term").agg(F.count("*").alias("tf"))
    at = at.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(w.other)))
    at = at.join(F.broadcast(made.select("t", "term", "tw")), ["t", "term"], "left")
    got = at.groupBy("t", "span").agg(F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    names = spark.createDataFrame([(i, name) for i, name, _ in _PARTS], "t int, license string")
    return got.join(F.broadcast(names), "t").select("t", "span", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(
        F.col("cosine") >= LEAST_COSINE)


def licensed_texts(texts: DataFrame, w: Weights) -> DataFrame:
    """(th, tg, license, cosine) of the rows (th, tg, text) with a licence: an SPDX tag's own (the first by name, cosine 1), else that of
    the best span; ties go to the first template. th and tg are two hashes of the text.
    """
    met = cut(spans(texts, w).distinct())
    kinds = cut(cosines(met.select("t", "span").distinct(), w))
    hits = joined_small(met, kinds, ["t", "span"]).select("th", "tg", "cosine", "t", "license")
    tags = texts.where(F.col("text").contains("SPDX-License-Identifier:")).select(
        "th", "tg", F.lit(1.0).alias("cosine"), F.lit(-1).alias("t"), F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("license"))
    least = F.min(F.struct((F.col("t") >= 0).alias("o"), (-F.col("cosine")).alias("c"), "t", "license")).alias("b")
    return cut(hits.union(tags).groupBy("th", "tg").agg(least).select("th", "tg", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")))


def whole_texts(texts: DataFrame, w: Weights) -> DataFrame:
    """(th, tg) of the rows (th, tg, text) that are a licence and little else: all their terms together are at LEAST_COSINE or more to a template."""
    tw = {x: [0.0] * len(_PARTS) for x in _VOCABULARY}
    for t, _, x, y in w.terms:
        tw[x][t] = y
    made = texts.sparkSession.createDataFrame([(x, w.idf[x], tw[x]) for x in _VOCABULARY], "term string, idf double, tw array<double>")
    at = texts.groupBy("th", "tg").agg(F.first("text").alias("text")).select("th", "tg", F.explode(_terms(F.col("text"))).alias("term"))
    at = at.groupBy("th", "tg", "term").agg(F.count("*").alias("tf")).join(F.broadcast(made), "term", "left")  # as many rows as the templates have terms
    at = at.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(w.other)))
    dots = [F.sum(F.col("w") * F.coalesce(F.get("tw", F.lit(t)), F.lit(0.0))) for t, _, _ in _PARTS]
    got = at.groupBy("th", "tg").agg(F.greatest(*dots).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return got.where(F.round(F.col("dot") / F.col("norm"), 9) >= LEAST_COSINE).select("th", "tg")


def _above(directory: Column) -> Column:
    """A directory and those above it, nearest first, down to the root, which is empty."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("up"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/").alias("home")))


def scanned(files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text", by_text: bool = False) -> DataFrame:
    """(id, license, cosine, how, directory) of every row.

    how: `own` if the text holds an SPDX tag or a span at LEAST_COSINE or more to a template (see licensed_texts()),
    `inherited` if not but a directory above holds a file named as a licence that has one (the nearest; of several there
    the best cosine, then the first name), else `none` with a null license. With `by_text`, files of other names whose whole
    text is a licence (see whole_texts()) pass it on as well, for tables whose names tell nothing. A null path inherits nothing; null and empty
    texts have no licence of their own. Rows are judged one by one, so repeated rows and ids, null ones too, are each
    returned; further columns are passed over whatever their names. An empty table gives no rows. Paths have `/`
    between names; further ones, and any in front, are passed over.
    """
    one = F.regexp_replace(F.regexp_replace(F.col(path), "/+", "/"), "^/", "")
    base = files.select(F.col(id_col).alias("id"), one.alias("path"), F.col(text).alias("text"))
    base = base.withColumns({"th": F.xxhash64("text"), "tg": F.xxhash64(F.lit(1), "text")})
    texts, w = base.where(F.col("text").isNotNull()).select("th", "tg", "text"), weights(base, "text")
    own = licensed_texts(texts, w).withColumn("file", F.lit(False))
    if by_text:
        whole = whole_texts(joined_small(texts, own.select("th", "tg"), ["th", "tg"], "left_semi"), w).withColumn("whole", F.lit(True))
        own = cut(own.join(whole, ["th", "tg"], "left").withColumn("file", F.coalesce("whole", "file")).drop("whole"))
    rows = base.select("id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "th", "tg")
    rows = cut(joined_small(rows, own, ["th", "tg"], "left").drop("th", "tg"))
    homes = rows.where(F.col("license").isNotNull() & (F.col("file") | F.col("path").rlike(LICENCE_FILE))).groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    homes = cut(homes.select(F.col("dir").alias("home"), F.col("b.license").alias("given"), (-F.col("b.c")).alias("given_cosine")))
    asked = rows.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    asked = asked.select("dir", F.explode(_above(F.col("dir"))).alias("x")).select("dir", "x.up", "x.home")
    near = joined_small(asked, homes, "home").groupBy("dir").agg(F.min(F.struct("up", "home", "given", "given_cosine")).alias("b"))
    near = cut(near.select("dir", "b.home", "b.given", "b.given_cosine"))
    got = joined_small(rows, near, "dir", "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return got.select(F.col("id").alias(id_col), F.coalesce("license", "given").alias("license"), F.coalesce("cosine", "given_cosine").alias("cosine"),
                      how.alias("how"), F.when(F.col("license").isNull(), F.col("home")).alias("directory"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files `source/lang/doc_id`; see scanned().

    Numbers name no licence file, so those whose whole text is a licence are the licence files of `source/lang`. Without a
    source a document stands in no directory, and neither inherits nor passes on.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    path = F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", "lang", name))
    return scanned(docs.select("doc_id", path.alias("path"), "text"), by_text=True)


def _sql_terms(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\pL\pN]+'), lambda x: x <> '')"


_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
SQL = rf"""
WITH f AS (SELECT row_number() OVER () AS rid, doc_id AS id, text,
      CASE WHEN source IS NOT NULL THEN regexp_replace(regexp_replace(concat_ws('/', source, lang, coalesce(doc_id::VARCHAR, '')), '/+', '/', 'g'), '^/', '') END AS path,
      {_sql_terms("coalesce(text, '')")} AS terms FROM documents),
templates(t, license, text) AS (VALUES {_TEMPLATE_ROWS}),
parts AS (SELECT t, license, {_sql_terms("text")} AS terms FROM templates),
placed AS (SELECT t, license, len(terms) AS m, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS off FROM parts),
vocabulary AS (SELECT DISTINCT term FROM placed),
words AS (SELECT rid, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM f),
idf AS (SELECT term, 1 + ln((1 + (SELECT count(*) FROM f)) / (1 + count(DISTINCT rid))::DOUBLE) AS idf FROM vocabulary LEFT JOIN words USING (term) GROUP BY term),
tw AS (SELECT t, license, term, count(*) * any_value(idf) AS w FROM placed JOIN idf USING (term) GROUP BY t, license, term),
tn AS (SELECT t, sqrt(sum(w * w)) AS tn FROM tw GROUP BY t),
falling AS (SELECT t, term, tn, sum(w * w) OVER (PARTITION BY t) - coalesce(sum(w * w) OVER (PARTITION BY t ORDER BY w DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
            FROM tw JOIN tn USING (t)),
keys AS (SELECT p.t, p.term, p.off, p.m FROM placed p JOIN falling k USING (t, term) WHERE k.rest >= ({LEAST_COSINE} * k.tn) * ({LEAST_COSINE} * k.tn)),
met AS (SELECT DISTINCT rid, t, pos - off AS start, m FROM words JOIN keys USING (term)),
spans AS (SELECT DISTINCT rid, t, list_slice(terms, greatest(start, 0) + 1, start + m) AS span FROM met JOIN f USING (rid)),
kinds AS (SELECT row_number() OVER () AS k, t, span FROM (SELECT DISTINCT t, span FROM spans)),
tf AS (SELECT k, t, term, count(*) AS tf FROM (SELECT k, t, unnest(span) AS term FROM kinds) GROUP BY ALL),
w AS (SELECT k, t, term, tf * coalesce(idf, (SELECT avg(idf) FROM idf)) AS w FROM tf LEFT JOIN idf USING (term)),
dots AS (SELECT k, sum(w.w * coalesce(tw.w / tn, 0)) AS dot, sqrt(sum(w.w * w.w)) AS norm FROM w LEFT JOIN tw USING (t, term) LEFT JOIN tn USING (t) GROUP BY k),
good AS (SELECT k, round(dot / norm, 9) AS cosine FROM dots WHERE round(dot / norm, 9) >= {LEAST_COSINE}),
hits AS (SELECT rid, t, license, cosine FROM spans JOIN kinds USING (t, span) JOIN good USING (k) JOIN templates USING (t)
         UNION ALL SELECT rid, -1, unnest(regexp_extract_all(text, '{SPDX}', 1)), 1.0 FROM f),
own AS (SELECT rid, license, cosine FROM hits QUALIFY row_number() OVER (PARTITION BY rid ORDER BY t >= 0, cosine DESC, t, license) = 1),
bag AS (SELECT rid, term, count(*) * coalesce(any_value(idf), (SELECT avg(idf) FROM idf)) AS w FROM words SEMI JOIN own USING (rid) LEFT JOIN idf USING (term) GROUP BY rid, term),
size AS (SELECT rid, sqrt(sum(w * w)) AS norm FROM bag GROUP BY rid),
likes AS (SELECT rid, t, sum(bag.w * tw.w / tn) AS dot FROM bag JOIN tw USING (term) JOIN tn USING (t) GROUP BY rid, t),
whole AS (SELECT DISTINCT rid FROM likes JOIN size USING (rid) WHERE round(dot / norm, 9) >= {LEAST_COSINE}),
homes AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, cosine FROM f JOIN own USING (rid)
          WHERE regexp_matches(path, '{LICENCE_FILE}') OR rid IN (SELECT rid FROM whole)
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1),
near AS (SELECT rid, dir, license, cosine FROM f JOIN homes ON dir = '' OR starts_with(path, dir || '/') WHERE rid NOT IN (SELECT rid FROM own)
         QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(dir) DESC) = 1)
SELECT f.id AS doc_id, coalesce(own.license, near.license) AS license, coalesce(own.cosine, near.cosine) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN own.license IS NULL THEN near.dir END AS directory
FROM f LEFT JOIN own USING (rid) LEFT JOIN near USING (rid)
"""
