"""Operator 1: licence scan by Dice coefficient over word bigrams (DataFrame functions only)."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.llm.common import discard, materialize, read_table

# Public licence texts and the short notices in common use.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole licence texts, by the name of their file and "-full"; found as runs of words only.
FULL_TEXTS: dict[str, str] = {f"{p.name}-full": p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").iterdir())}
MAX_TEMPLATES = 256


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def anchor_words(known: dict[str, list[str]], share: float) -> list[str]:
    """Words of which a unit holds one at least if it holds `share` of the bigrams of any template.

    Of each template, the bigrams of the longest words, one more than may be missing, and of
    each of these its longer word.
    """
    out: set[str] = set()
    for grams in known.values():
        by_length = sorted((max(g.split(" "), key=len) for g in grams), key=lambda w: (-len(w), w))
        out.update(by_length[: len(grams) - math.ceil(share * len(grams) - 1e-9) + 1])
    return sorted(out)


def least_words(grams: list[str], share: float) -> tuple[list[str], int]:
    """The distinct words of a template, and how many of them whatever holds `share` of its bigrams has at least.

    A bigram is held with both of its words, so the words held stand in twice as many places of
    bigrams as there are bigrams held; the words of most places get there first.
    """
    places: dict[str, int] = {}
    for word in (w for g in grams for w in g.split(" ")):
        places[word] = places.get(word, 0) + 1
    wanted, n = 2 * share * len(grams) - 1e-6, 0
    for k in sorted(places.values(), reverse=True):
        if wanted <= 0:
            break
        wanted, n = wanted - k, n + 1
    return list(places), n


def may_hold(docs: DataFrame, known: dict[str, list[str]], share: float, long: int = 256) -> DataFrame:
    """The rows of docs(doc_id, text) with words enough, anywhere in the text, for `share` of the bigrams of any template; others hold it in no part.

    Templates of over `long` bigrams are only looked for in texts that are long enough for them.
    """
    strings = lambda own: F.split(F.lit("\n".join(own)), "\n")
    once = lambda x: F.explode(F.array(x))
    words = F.split(F.lower("text"), r"[^a-z0-9\p{L}\p{N}]+")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", once(words).alias("w"))
    kinds = [{k: v for k, v in known.items() if (len(v) > long) == big} for big in (False, True)]
    held = F.lit(False)
    for i, kind in enumerate(kinds):
        if not kind:
            continue
        needs = [least_words(own, share) for own in kind.values()]
        fits = F.size("w") > share * min(map(len, kind.values()))
        found = F.array_intersect(strings(list(dict.fromkeys(w for own, _ in needs for w in own))), F.col("w"))
        rows = rows.select("*", once(F.when(fits, found).otherwise(F.array().cast("array<string>"))).alias(f"m{i}"))
        for own, n in needs:
            m = F.col(f"m{i}")
            held = held | ((F.size(m) >= n) & (F.size(F.array_intersect(strings(own), m)) >= n))
    return rows.where(held).select("doc_id", "text")


def scan_runs(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """Best run of words in docs(doc_id, text) for every document and template: doc_id, license_id, dice, whole_text.

    A run starts and ends anywhere, so line breaks and text around a notice do not count. Only
    rows whose whole text holds a share threshold / (2 - threshold) of a template's bigrams are
    looked into. A run of n bigrams with c in the template reaches the threshold where
    2 * c - threshold * n is threshold * t at least: for each end the best start within the
    admissible size is a running minimum, and the best ends of every stretch are scored on
    distinct bigrams. Of runs that share half of the shorter one, the one with more bigrams in
    common stays, so a notice inside a longer one does not count.
    """
    known = {k: template_bigrams(v) for k, v in sorted(templates.items())}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    strings = lambda own: F.split(F.lit("\n".join(own)), "\n")
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    bigrams = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    every = list(dict.fromkeys(g for own in known.values() for g in own))
    once = lambda x: F.explode(F.array(x))  # noqa: E731  keeps the optimizer from evaluating x in every expression that reads it
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", once(words).alias("w")).where(F.size("w") > 1).select("doc_id", once(bigrams("w")).alias("b"))
    rows = rows.select("doc_id", "b", once(F.array_intersect(strings(every), F.col("b"))).alias("m"))
    common = lambda own: F.size(F.array_intersect(strings(own), F.col("m")))
    held = [
        F.when(F.size("m") >= low * len(own), F.when(common(own) >= low * len(own), F.struct(F.lit(name).alias("license_id"), common(own).alias("c"))))
        for name, own in known.items()
    ]
    rows = rows.where(F.size("m") >= low * min(map(len, known.values()))).select("doc_id", "b", once(F.array_compact(F.array(*held))).alias("held")).where(F.size("held") > 0)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "b", "held"), "licence-rows")

    spark = docs.sparkSession
    facts = [(name, rank, len(own), int(high * len(own)) + len(re.findall(r"[^\W_]+", templates[name])) - len(own)) for rank, (name, own) in enumerate(known.items())]
    facts = F.broadcast(spark.createDataFrame(facts, "license_id string, rank int, t int, longest int"))  # a row a template
    grams = F.broadcast(spark.createDataFrame([(name, g) for name, own in known.items() for g in own], "license_id string, gram string"))  # bounded by the templates
    wanted = rows.select("row_id", F.col("held.license_id").alias("names"), F.posexplode("b").alias("pos", "gram"))
    hits = wanted.join(grams, "gram").where(F.array_contains("names", F.col("license_id"))).join(facts, "license_id").drop("names", "gram")
    key = ["row_id", "license_id"]
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    before = 2.0 * (F.col("k") - 1) - threshold * F.col("pos")
    near = Window.partitionBy(*key).orderBy(F.col("pos") / F.col("longest")).rangeBetween(-1, 0)
    ends = hits.withColumn("start", F.min(F.struct(before.alias("before"), "pos")).over(near))
    ends = ends.withColumn("sum", 2.0 * F.col("k") - threshold * (F.col("pos") + 1) - F.col("start.before")).where(F.col("sum") >= threshold * F.col("t") - 1e-6)
    stretch = F.floor(F.col("pos") / (F.floor(F.col("t") / 4) + 1))
    best = ends.groupBy(*key, "rank", stretch.alias("stretch")).agg(F.max(F.struct("sum", F.col("start.pos").alias("a"), F.col("pos").alias("z"))).alias("best"))
    runs = best.select(*key, "rank", "best.a", "best.z").join(rows.select("row_id", "b"), "row_id")
    runs = runs.withColumn("g", F.array_distinct(F.slice("b", F.col("a") + 1, F.col("z") - F.col("a") + 1)))
    own = F.coalesce(*[F.when(F.col("license_id") == name, strings(own)) for name, own in known.items()])
    runs = runs.withColumn("own", own).withColumn("common", F.size(F.array_intersect("g", "own")))
    runs = runs.withColumn("dice", F.lit(2.0) * F.col("common") / (F.size("g") + F.size("own"))).where(F.col("dice") >= threshold)
    runs = materialize(runs.select(*key, "a", "z", F.struct("common", "dice", (-F.col("rank")).alias("order")).alias("worth"), "dice"), "licence-runs")
    x, y = runs.alias("x"), runs.alias("y")
    shared = F.least("x.z", "y.z") - F.greatest("x.a", "y.a") + 1
    inside = (F.col("x.row_id") == F.col("y.row_id")) & (F.col("x.license_id") != F.col("y.license_id")) & (F.col("y.worth") > F.col("x.worth"))
    inside = inside & (2 * shared >= F.least(F.col("x.z") - F.col("x.a"), F.col("y.z") - F.col("y.a")) + 1)
    stay = x.join(y, inside, "left_anti").groupBy(*key).agg(F.max("dice").alias("dice"))
    sizes = rows.select("row_id", "doc_id", F.size(F.array_distinct("b")).alias("n"), F.explode("held").alias("h")).select("row_id", "doc_id", "n", "h.*")
    whole = 2.0 * F.col("c") / (F.col("n") + F.col("t")) >= threshold
    found = stay.join(sizes, key).join(facts, "license_id").withColumn("whole_text", whole)
    return found.groupBy("doc_id", "license_id").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_units"), F.max("whole_text").alias("whole_text"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Licences in docs(doc_id, text): doc_id, license_id, dice, n_units, whole_text.

    A unit is the whole text or one of its lines, lower-cased, with all but letters and digits
    as word gaps. For a unit of b distinct word bigrams and a template of t, Dice is
    2 * common / (b + t); it can reach the threshold only for t between
    b * threshold / (2 - threshold) and b * (2 - threshold) / threshold, so other templates are
    pruned before any intersection. By the same bound a unit must hold a share
    threshold / (2 - threshold) of a template's bigrams, so one of any larger remainder of
    them: units without a word of such a remainder are pruned before bigrams are made. Before all,
    one scan of the texts keeps those with words enough for such a share of any template (may_hold);
    only these are written and cut into units and runs. A unit gives its best template (the first by name on
    ties). Returned is a row for each document and licence: the highest Dice, the number of
    units, and whether the whole text is one. Licences that no unit of a document gives are looked
    for in runs of words of any place and length (scan_runs), with whole licence texts among the
    templates; n_units is then the number of rows that hold one. Null texts and units under two words match
    nothing; rows that repeat a doc_id count together; an empty table gives no rows.
    """
    in_runs = templates or TEMPLATES | FULL_TEXTS
    known = {k: template_bigrams(v) for k, v in sorted((templates or TEMPLATES).items())}
    if len(known) > MAX_TEMPLATES:
        raise ValueError(f"{len(known)} templates; at most {MAX_TEMPLATES} fit an expression")
    if not known or any(not v for v in known.values()):
        raise ValueError("every template needs two words")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    docs = materialize(may_hold(docs, {k: template_bigrams(v) for k, v in (in_runs | (templates or TEMPLATES)).items()}, low), "licence-texts")
    least, most = low * min(map(len, known.values())), high * max(map(len, known.values()))
    words = F.transform(F.split(F.lower("text"), "\n"), lambda line: F.split(line, r"[^\p{L}\p{N}]+"))
    # posexplode: unit 0 is the whole text
    units = F.when(F.size("w") > 1, F.concat(F.array(F.flatten("w")), F.col("w"))).otherwise(F.col("w"))
    exploded = docs.where(F.col("text").isNotNull()).select("doc_id", words.alias("w")).select("doc_id", F.posexplode(units).alias("unit", "w"))
    anchors = F.array(*[F.lit(x) for x in anchor_words(known, low)])
    sized = exploded.where(F.arrays_overlap("w", anchors)).select("doc_id", "unit", F.array_remove("w", "").alias("w")).where(F.size("w") - 1 >= least)
    n = F.greatest(F.size("w") - 1, F.lit(0))  # the optimizer may make bigrams before it drops short units
    grams = F.array_distinct(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = sized.select("doc_id", "unit", grams.alias("g")).where((F.size("g") >= least) & (F.size("g") <= most))
    scores = []
    for rank, (name, own) in enumerate(known.items()):
        fits = (F.size("g") >= low * len(own)) & (F.size("g") <= high * len(own))
        common = F.size(F.array_intersect("g", F.array(*[F.lit(x) for x in own])))
        dice = F.lit(2.0) * common / (F.size("g") + len(own))
        scores.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("license_id"))))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    found = grams.select("doc_id", "unit", best.alias("best")).where(F.col("best.dice") >= threshold)
    found = found.groupBy("doc_id", F.col("best.license_id").alias("license_id")).agg(
        F.max("best.dice").alias("dice"), F.count(F.lit(1)).alias("n_units"), F.max((F.col("unit") == 0)).alias("whole_text")
    )
    found = materialize(found, "licence-units")
    same = F.col("r.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("r.license_id") == F.col("u.license_id"))
    runs = scan_runs(docs, in_runs, threshold)
    discard(docs)  # both have written what they took from it
    return found.unionByName(runs.alias("r").join(found.alias("u"), same, "left_anti"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in any line of the documents, or making up a whole document."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def oracle(threshold: float = 0.8) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    names = sorted(TEMPLATES)
    rows = ", ".join(f"({i}, {quote(n)}, [{', '.join(map(quote, template_bigrams(TEMPLATES[n])))}])" for i, n in enumerate(names))
    return rf"""
WITH t(rank, license_id, tg) AS (VALUES {rows}),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, unnest(CASE WHEN len(ls) > 1 THEN list_prepend(text, ls) ELSE ls END) AS line,
    unnest(range(0, CASE WHEN len(ls) > 1 THEN len(ls) + 1 ELSE 1 END)) AS unit FROM l
), w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
s AS (
  SELECT doc_id, unit, license_id, rank, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
  FROM g, t WHERE len(g) <= 3 * (SELECT max(len(tg)) FROM t)
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, rank) AS k FROM s WHERE dice >= {threshold})
SELECT doc_id, license_id, max(dice) AS dice, count(*) AS n_units, bool_or(unit = 0) AS whole_text FROM b WHERE k = 1 GROUP BY 1, 2
"""
