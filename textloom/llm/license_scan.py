"""Operator 6: license scans by an exact set-similarity join, in DataFrame functions only.

Method: the *blocks* of a text are overlapping windows of ``2 s`` words, one
every ``s`` words, for each of the ``SIZES`` s; a template of m words is sought
in the blocks of the least s that is m or more, so that however lines are
wrapped some block holds all of any m words in a row.  A block meets a template
when it holds at least ``PERCENT`` of the template's distinct words, and the
words that name the license.

Words of templates are ordered by how many documents hold them, rarest first,
counted over all texts.  Prefix filter: a block that meets a template of n words
holds one of its n - k + 1 rarest, where k = ceil(PERCENT * n / 100); these are
the rows of an inverted index, which is joined with the rare words of all blocks
(by broadcast up to ``BROADCAST_ROWS``, else shuffled).  Length filter: the
block holds k words of templates at least.  Positional filter: all template
words up to the last one found in the prefix are known to be shared or not; what
was found, and the block's words that come later in the order, must make k.
Candidates that pass are verified on whole sets.  No filter drops a block that
meets a template.

Beside that, places where a fixed phrase stands word by word are found; such a
place holds its phrase wholly, so the text's score is 1.

Cases: null text counts as empty and has no words, places or labels; repeated
doc_ids and null ones are scanned row by row; a very long text is cut into
segments whose blocks are joined on their own; of several blocks that meet a
template the best share counts; an empty table gives no rows; other columns are
not read.  Words are runs of letters, digits and characters beyond ASCII, with
A-Z lower-cased.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, UPPER, table, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80
SIZES = (8, 16, 32, 64)
#: Words of a segment, and how many of them come before the next one: a block begins before STRIDE and ends by SEGMENT.
SEGMENT, STRIDE = 512, 384
#: Rows of the inverted index (some hundred bytes each) that are broadcast.
BROADCAST_ROWS = 100_000

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates: the label, words that name the license, and a sentence of it or of a notice that refers to it.
TEMPLATES = (
    ("mit", "mit", "Released under the terms of the MIT License"),
    ("mit", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache", "", "See the License for the specific language governing permissions and limitations under the License"),
    ("apache", "", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work"),
    ("gpl", "general", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "general", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "general", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("gpl", "", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("lgpl", "lesser", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "lesser", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "affero", "licensed under the GNU Affero General Public License"),
    ("agpl", "affero", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "attribution noderivatives", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc0", "", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("epl", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("boost", "boost", "Distributed under the Boost Software License, Version 1.0"),
    ("ofl", "font", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("artistic", "artistic", "you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
)


def cut(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def needed(n: int) -> int:
    """Words of a template of n that a block must hold."""
    return -(-PERCENT * n // 100)


def size_of(words: int) -> int:
    """The least of ``SIZES`` that holds so many words."""
    return next(s for s in SIZES if words <= s)


#: Distinct words of each template, its block size, and the words that it can't miss.
SETS = [list(dict.fromkeys(cut(t))) for *_, t in TEMPLATES]
BLOCK_SIZES = [size_of(len(cut(t))) for *_, t in TEMPLATES]
KEYS = [names.split() for _, names, _ in TEMPLATES]
VOCABULARY = sorted({w for s in SETS for w in s})


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def _stands(words: Column, parts: list[str]):
    """For a word and its place: the place, if the phrase stands there."""

    def at(w: Column, i: Column) -> Column:
        rest = [F.coalesce(F.get(words, i + k) == part, F.lit(False)) for k, part in enumerate(parts) if k]
        return F.when(reduce(lambda a, b: a & b, rest, w == parts[0]), i)

    return at


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("place"), F.lit(label).alias("label")))


def _places(words: Column) -> Column:
    """First words' places of each phrase, as structs in an array."""
    found = []
    for phrase, label in PHRASES:
        starts = F.filter(F.transform(words, _stands(words, phrase.split())), lambda i: i.isNotNull())
        found.append(_labelled(starts, label))
    return F.concat(*found)


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _segments(words: Column) -> Column:
    """The template words of each segment: their place in it, and the word."""

    def own(w: Column, i: Column) -> Column:
        return F.when(w.isin(VOCABULARY), F.struct(i.cast("int").alias("place"), w.alias("word")))

    def segment(g: Column) -> Column:
        return F.filter(F.transform(F.slice(words, g * STRIDE + 1, F.lit(SEGMENT)), own), lambda x: x.isNotNull())

    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / STRIDE).cast("int")), segment)


def inverted(order: dict[str, int]) -> tuple[list[str], list[tuple[str, int, int, int]], list[list[int]]]:
    """All words, rarest first; (word, its rank from 1, template, words needed) for each template's prefix; each template's ranks."""
    words = sorted(VOCABULARY, key=lambda w: (order.get(w, 0), w))
    rank = {w: k for k, w in enumerate(words, 1)}
    ranks = [sorted(rank[w] for w in s) for s in SETS]
    rows = []
    for t, own in enumerate(ranks):
        k = needed(len(own))
        rows += [(words[r - 1], r, t, k) for r in own[: len(own) - k + 1]]
    return words, rows, ranks


def _rows(spark: SparkSession, rows: list[Column], most: int = BROADCAST_ROWS) -> DataFrame:
    """A small table of literal structs, broadcast up to ``most`` of them."""
    df = spark.range(1).select(F.inline(F.array(*rows)))
    return F.broadcast(df) if len(rows) <= most else df


def _codes(hits: Column, k: int, size: int) -> Column:
    """Codes of the blocks of the ``k``-th size that hold one of ``hits``."""
    both = F.flatten(F.transform(hits, lambda h: F.array(F.floor(h["place"] / size), F.floor(h["place"] / size) - 1)))
    return F.transform(F.filter(both, lambda b: (b >= 0) & (b * size < STRIDE)), lambda b: b + k * SEGMENT)


def blocks_with(texts: DataFrame, words: list[str], rare: list[str]) -> DataFrame:
    """``rid, segment, size, block, ranks``: the blocks of ``texts(rid, segments)`` that hold a rare word, as sorted ranks of ``words``."""
    each = texts.select("rid", F.posexplode("segments").alias("segment", "held")).where(F.exists("held", lambda h: h["word"].isin(rare)))
    hits = F.filter("held", lambda h: h["word"].isin(rare))
    # a block is coded as one number, so that equal ones are found by hashing
    codes = F.concat(*(_codes(hits, k, size) for k, size in enumerate(SIZES)))
    sizes = F.array(*map(F.lit, SIZES))
    each = each.withColumn("code", F.explode(F.array_distinct(codes)))
    each = each.withColumn("size", F.element_at(sizes, (F.floor(F.col("code") / SEGMENT) + 1).cast("int"))).withColumn("block", F.col("code") % SEGMENT)
    first = F.col("block") * F.col("size")
    inside = F.filter("held", lambda h: (h["place"] >= first) & (h["place"] < first + 2 * F.col("size")))
    ranks = F.array_sort(F.array_distinct(F.transform(inside, lambda h: F.array_position(_strings(words), h["word"]).cast("int"))))
    return each.select("rid", "segment", "size", "block", ranks.alias("ranks"))


def candidates(blocks: DataFrame, rows: list[tuple[str, int, int, int]]) -> DataFrame:
    """``rid, segment, block, template, found, last, ranks, needed``: blocks that share a prefix word with a template and are long enough."""
    index = _rows(blocks.sparkSession, [F.struct(F.lit(r).alias("rank"), F.lit(t).alias("template"), F.lit(k).alias("needed"), F.lit(BLOCK_SIZES[t]).alias("size")) for _, r, t, k in rows])
    hits = blocks.withColumn("rank", F.explode(F.array_intersect("ranks", F.array(*map(F.lit, sorted({r for _, r, *_ in rows}))))))
    met = hits.join(index, ["rank", "size"]).where(F.size("ranks") >= F.col("needed"))  # length filter
    return met.groupBy("rid", "segment", "block", "template").agg(F.count("*").alias("found"), F.max("rank").alias("last"), F.first("ranks").alias("ranks"), F.first("needed").alias("needed"))


def positional(met: DataFrame) -> DataFrame:
    """Candidates whose matches up to the last prefix word, and the block's words after it, can make what is needed."""
    after = F.size("ranks") - F.array_position("ranks", F.col("last"))
    return met.where(F.col("found") + after >= F.col("needed"))


def verified(met: DataFrame, ranks: list[list[int]], words: list[str]) -> DataFrame:
    """``rid, label, share`` of candidates that hold enough of the template's words, and those that name it."""
    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    to = {w: k for k, w in enumerate(words, 1)}
    rows = [F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), ints(own).alias("own"), ints([to[w] for w in keys]).alias("keys")) for t, ((label, *_), own, keys) in enumerate(zip(TEMPLATES, ranks, KEYS, strict=True))]
    both = met.join(_rows(met.sparkSession, rows), "template")
    shared = F.size(F.array_intersect("ranks", "own"))
    named = F.size(F.array_intersect("ranks", "keys")) == F.size("keys")
    return both.where((100 * shared >= PERCENT * F.size("own")) & named).select("rid", "label", (shared / F.size("own")).alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """Places, labels and score of each row of ``docs(doc_id, text)``.

    One pass over the texts stores each row's places and template words; the
    join and the answer read only that table.
    """
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select("doc_id", lower.alias("text")).withColumn("words", words_of(F.col("text")))
    words = F.col("words")
    texts = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size(words).cast("long").alias("n_words"), F.when(F.col("text").contains("license"), _places(words)).alias("places"), _segments(words).alias("segments"))
    texts = written(texts)
    distinct = F.array_distinct(F.transform(F.flatten("segments"), lambda h: h["word"]))
    held = texts.select(F.explode(distinct).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = {r["word"]: r["n"] for r in held.collect()}  # bounded by the templates' words
    vocabulary, index, ranks = inverted(order)
    blocks = blocks_with(texts, vocabulary, sorted({w for w, *_ in index}))
    found = verified(positional(candidates(blocks, index)), ranks, vocabulary)
    own = found.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    out = texts.drop("segments").join(own, "rid", "left")
    place = F.transform("places", lambda p: p["place"])
    n = F.coalesce(F.size("places"), F.lit(0))
    base = F.coalesce(F.transform("places", lambda p: p["label"]), _strings([]))

    def joined(x: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(x)), ",")

    score = F.when(n > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.when(n > 0, n).otherwise(0).cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.coalesce("own", _strings([])))).alias("labels"), score.alias("score"),
    )


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL for the query: every block against every template of its size, without filters."""
    split = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    sets = " UNION ALL ".join(f"SELECT '{label}' AS label, {size} AS size, {s!r}::VARCHAR[] AS need, {keys!r}::VARCHAR[] AS keys" for (label, *_), size, s, keys in zip(TEMPLATES, BLOCK_SIZES, SETS, KEYS, strict=True))

    def place(phrase: str, label: str) -> str:
        p = phrase.split()
        test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p, 1))
        return f"list_transform(list_filter(range(len(words)), lambda i: {test}), lambda i: {{'place': i, 'label': '{label}'}})"

    places = ", ".join(place(p, label) for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM documents),
templates AS ({sets}),
w AS (SELECT r, doc_id, {split.format('t')} AS words FROM d),
b AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, list_concat({places}) AS places FROM w),
g AS (SELECT r, words, unnest(range(0, greatest(len(words), 1), {STRIDE})) AS lo FROM w),
s AS (SELECT r, list_slice(words, lo + 1, lo + {SEGMENT}) AS words FROM g),
z AS (SELECT r, words, unnest({list(SIZES)}) AS size FROM s),
k AS (SELECT r, size, words, unnest(range(0, {STRIDE}, size)) AS lo FROM z),
blocks AS (SELECT r, size, list_distinct(list_slice(words, lo + 1, lo + 2 * size)) AS words FROM k WHERE lo < len(words)),
m AS (SELECT r, label, len(list_intersect(words, need)) / len(need) AS share FROM blocks JOIN templates USING (size)
      WHERE len(list_intersect(words, need)) * 100 >= {PERCENT} * len(need) AND len(list_intersect(words, keys)) = len(keys)),
o AS (SELECT r, list(DISTINCT label) AS own, max(share) AS score FROM m GROUP BY r)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda p: p.place))::BIGINT AS first_word, list_max(list_transform(places, lambda p: p.place))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(own, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM b LEFT JOIN o USING (r)
"""
