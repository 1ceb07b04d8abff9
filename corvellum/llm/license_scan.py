"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams, in DataFrame functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvellum.llm.common import table

# Templates, as (licence, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

THRESHOLD = 0.8
# Words that many texts hold; they tell of a licence only if nothing else does.
COMMON = ("a", "and", "any", "as", "at", "by", "following", "for", "in", "is", "it", "its", "may", "not", "of", "on", "or", "provided", "source", "the", "this", "to", "under", "with", "without", "work", "you")


def template_bigrams(text: str) -> list[str]:
    """Word bigrams of a template in order, normalised as documents are."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def least_overlap(size: int, threshold: float) -> int:
    """Distinct bigrams that a unit must share with a template of ``size`` of them to reach the threshold: a unit of
    the least size that the coefficient allows needs the fewest."""
    return math.ceil(threshold * (math.ceil(threshold / (2 - threshold) * size - 1e-9) + size) / 2 - 1e-9)


def telling_words(grams: list[str], threshold: float) -> set[str]:
    """Words of a template of which a match must hold at least one: so many bigrams have one of them that the others are
    too few for a match. Words that aren't common go first, then long ones, as few texts hold them."""
    left, chosen = set(grams), set()
    free = least_overlap(len(left), threshold) - 1
    for w in sorted({w for g in left for w in g.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(left) <= free:
            break
        gone = {g for g in left if w in g.split()}
        if gone:
            chosen.add(w)
            left -= gone
    return chosen


def window_lengths(n: int) -> list[int]:
    """Lengths, in bigrams, of the runs of words that are compared with a template of ``n``: shorter where something is
    left out of it, longer where something is put in."""
    return sorted({max(1, math.ceil(0.8 * n)), n, math.floor(1.25 * n), math.floor(1.5 * n)})


def _bigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _once(value: Column) -> Column:
    """``value`` worked out once a row: what is exploded stays a column, while a plain expression is put into each lambda
    that looks at it, and worked out there again and again."""
    return F.explode(F.array(value))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches with templates: doc_id, scope, unit, template (its number), license, dice. No shuffle; the templates are a
    constant of the plan.

    Scopes are lines, blank-line-separated paragraphs and whole texts, known by their number, and ``window``: the best
    run of words of a text, wherever lines begin and end, known by its first word. Runs begin at a bigram of the template
    and have the lengths of `window_lengths`; of equal ones the first, then the shortest counts.

    Text is normalised by lower-casing and taking all but a-z and 0-9 as separators. Texts without any of a template's
    `telling_words` can't match and go first, then templates of which a text has fewer distinct bigrams than
    `least_overlap`. Of a unit only templates within the size bounds that the coefficient implies (|A| between
    t/(2-t) and (2-t)/t of |B|) are compared; the coefficient itself decides. Null, empty and one-word texts
    match nothing; a very long text is scanned whole, and its runs only where a template's bigrams stand; a unit may
    match several templates, alike ones too; repeated rows repeat their matches. A paragraph or text that
    is a single line or paragraph isn't reported again under the wider scope. Other columns are ignored; an empty table
    gives no rows.
    """
    sizes = [(i, name, template_bigrams(t)) for i, (name, t) in enumerate(templates)]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    telling = sorted({w for _, _, g in sizes for w in telling_words(g, threshold)})
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, dict.fromkeys(g))).alias("grams"), F.lit(least_overlap(len(set(g)), threshold)).alias("least"), F.array(*map(F.lit, window_lengths(len(g)))).alias("lengths"))
        for i, name, g in sizes
    ]
    literal = F.array(*rows)

    low_text = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    split_words = lambda x: F.array_remove(F.split(x, "[^a-z0-9]+"), "")
    a = docs.select(F.col(f"`{id_col}`").alias("doc_id"), low_text.alias("low")).select("doc_id", "low", _once(split_words(F.col("low"))).alias("w"))
    a = a.where(F.arrays_overlap("w", F.array(*map(F.lit, telling)))).select("doc_id", "low", _once(_bigrams(F.col("w"))).alias("all"))
    a = a.select("doc_id", "low", "all", _once(F.filter(literal, lambda t: F.size(F.array_intersect("all", t["grams"])) >= t["least"])).alias("t")).where(F.size("t") > 0)

    part = "array<struct<scope:string,unit:int,x:string>>"
    lines = F.split("low", "\n")
    paragraphs = F.split("low", r"\n[^a-z0-9\n]*\n[^a-z0-9]*")
    scope = lambda name, parts: F.transform(parts, lambda x, i: F.struct(F.lit(name).alias("scope"), i.alias("unit"), x.alias("x")))
    several = lambda x: F.instr(x["x"], "\n") > 0
    whole = F.when(F.size(paragraphs) > 1, scope("text", F.array("low"))).otherwise(F.array().cast(part))
    every = F.concat(scope("line", lines), F.filter(scope("paragraph", paragraphs), several), whole)
    u = a.select("doc_id", "t", F.explode(every).alias("u")).select("doc_id", "t", "u.scope", "u.unit", _once(F.array_distinct(_bigrams(split_words(F.col("u.x"))))).alias("g"))
    dice = lambda g, t: 2.0 * F.size(F.array_intersect(g, t)) / (F.size(g) + F.size(t))
    near = lambda t: (F.size("g") >= low * F.size(t["grams"])) & (F.size("g") <= high * F.size(t["grams"]))
    u = u.select("doc_id", "scope", "unit", "g", F.explode(F.filter("t", near)).alias("t")).select("doc_id", "scope", "unit", "t", dice(F.col("g"), F.col("t.grams")).alias("dice"))

    hit = a.select("doc_id", "all", F.explode("t").alias("t"))
    hit = hit.select("doc_id", "all", _once(F.filter(F.transform("all", lambda g, i: F.when(F.array_contains("t.grams", g), i)), lambda i: i.isNotNull())).alias("at"), "t")
    run = lambda i, n: F.array_distinct(F.slice("all", i + 1, n))
    runs = F.flatten(F.transform("at", lambda i: F.transform("t.lengths", lambda n: F.struct(dice(run(i, n), F.col("t.grams")).alias("dice"), (-i).alias("at"), (-n).alias("n")))))
    best = hit.select("doc_id", F.lit("window").alias("scope"), F.array_max(runs).alias("best"), "t").select("doc_id", "scope", (-F.col("best.at")).alias("unit"), "t", "best.dice")
    found = u.unionByName(best).where(F.col("dice") >= threshold)
    return found.select("doc_id", "scope", "unit", "t.template", "t.license", F.round("dice", 6).alias("dice"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence matches of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = [(i, name, template_bigrams(t)) for i, (name, t) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({i}, '{name}', [{', '.join(map(repr, dict.fromkeys(g)))}], {window_lengths(len(g))})" for i, name, g in grams)
    return rf"""
WITH t(template, license, grams, lengths) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS norm FROM documents),
p AS (SELECT doc_id, norm, string_split(norm, chr(10)) AS ls, regexp_split_to_array(norm, '\n *\n[ \n]*') AS ps FROM d),
u AS (
  SELECT doc_id, 'line' AS scope, unnest(range(len(ls))) AS unit, unnest(ls) AS x FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS scope, unnest(range(len(ps))) AS unit, unnest(ps) AS x FROM p) WHERE contains(x, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, norm FROM p WHERE len(ps) > 1),
w AS (SELECT doc_id, scope, unit, list_filter(string_split(replace(x, chr(10), ' '), ' '), lambda y: y <> '') AS w FROM u),
g AS (SELECT doc_id, scope, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, scope, unit, template, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS x FROM g, t),
a AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
  FROM (SELECT doc_id, list_filter(string_split(replace(norm, chr(10), ' '), ' '), lambda y: y <> '') AS w FROM d) WHERE len(w) > 1),
b AS (SELECT doc_id, g, template, license, grams, lengths, unnest(range(1, len(g) + 1)) AS i FROM a, t WHERE len(list_intersect(g, grams)) * 2 >= len(grams)),
h AS (SELECT doc_id, template, license, grams, i, unnest(lengths) AS n, g FROM b WHERE list_contains(grams, g[i])),
r AS (SELECT doc_id, template, license, i - 1 AS unit, n, grams, list_distinct(g[i : i + n - 1]) AS g FROM h),
x AS (SELECT doc_id, template, license, unit, n, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS x FROM r),
y AS (SELECT doc_id, 'window' AS scope, first(unit ORDER BY x DESC, unit, n) AS unit, template, license, max(x) AS x FROM x GROUP BY doc_id, template, license)
SELECT doc_id, scope, CAST(unit AS INTEGER) AS unit, template, license, round(x, 6) AS dice
FROM (SELECT * FROM c UNION ALL SELECT * FROM y) WHERE x >= {THRESHOLD}::DOUBLE
"""


QUERIES = {"op6_license_scans": op6_license_scans}
SQL = {"op6_license_scans": _sql()}
