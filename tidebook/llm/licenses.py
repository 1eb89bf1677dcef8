"""License scans: lines and whole texts compared with licence templates by the Dice coefficient over word bigrams.

DataFrame functions alone; bigrams travel as 64-bit hashes. A unit is a line or the whole text, in lower case, words being runs of letters and digits. A
coefficient of THRESHOLD needs bigram counts within a factor of (2 - THRESHOLD) / THRESHOLD, so each unit meets only
templates of fitting size, by an equi-join on the count with a table that lists every fitting size of every template;
a unit that shares no bigram with any template is passed over before. The templates are a fixed list, so what is
broadcast doesn't grow. There is no shuffle but for the units found.

Between lines and the whole text are runs: notices wrapped over lines, or standing in a longer line. A text is cut into
pieces at line and sentence ends; a run goes from a piece that is mostly of a template, after one that isn't, to such a
piece before one that isn't. Any run that reaches THRESHOLD holds THRESHOLD / (2 - THRESHOLD) of its template's bigrams,
hence one of any set of the others and one more, so texts without a bigram of these rarest ones, or that many of a long
template, are passed over.
Runs are also held against TEXTS, licence texts that are longer than a line. The SQL has lines and whole texts only.
"""

from __future__ import annotations

import math
import re
from importlib.resources import files

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.sources.tables import table

THRESHOLD = 0.7

# Public licence notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

#: Further public texts, for runs alone: the files of ``license_texts``, by name, and notices.
TEXTS = {x.name.removesuffix(".txt"): x.read_text("utf-8") for x in sorted((files("tidebook.llm") / "license_texts").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")} | {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def fitting_sizes(n: int, threshold: float) -> range:
    """Bigram counts that can reach ``threshold`` with a template of ``n``."""
    return range(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


#: Bigrams of a template from which it is long.
LONG = 300
#: Words of a text whose distinct bigrams are counted first: if they are too many for any template, so are the text's.
FIRST_WORDS = 400


def _hashed(words: Column) -> Column:
    """64-bit hashes of the distinct bigrams of an array of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b))))


def _units(lines: Column, most: int) -> Column:
    """Bigrams of each line, an array of words, and of the lines together. Lambdas name arrays, so each is made once."""
    one = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    full = lambda c: F.filter(c, lambda w: w != "")
    whole = lambda a: F.when(F.size(_hashed(full(F.slice(F.flatten(a), 1, FIRST_WORDS)))) <= most, one(full(F.flatten(a)), _hashed)).otherwise(F.array().cast("array<bigint>"))
    return one(lines, lambda a: F.concat(F.transform(a, _hashed), F.array(whole(a))))


def _signed(x: int) -> int:
    """As Spark's xxhash64, whose seed is 42, gives it."""
    return x - (1 << 64) if x >> 63 else x


def _hash(bigram: str) -> int:
    return _signed(xxhash.xxh64_intdigest(bigram, seed=42))


def anchors(known: dict[str, list[str]], threshold: float) -> dict[str, set[str]]:
    """Of each template the bigrams of which any text that reaches ``threshold`` holds one: as many as it may lack and one more, long words first."""
    longest = lambda x: (-min(map(len, x.split())), -len(x), x)
    return {k: set(sorted(b, key=longest)[: len(b) - math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) + 1]) for k, b in known.items() if b}


def _runs(docs: DataFrame, known: dict[str, list[str]], threshold: float) -> DataFrame:
    """doc_id, license, dice of runs of pieces that reach ``threshold``; of runs that overlap only the best, the first by name and place of several."""
    one = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    longs = lambda x: F.lit(sorted(map(_hash, x))).cast("array<bigint>")
    first = anchors(known, threshold)
    text = F.regexp_replace(F.lower(F.col("text").cast("string")), r"[.;:!?]+\s", "\n")
    pieces = F.filter(F.transform(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != "")), lambda x: F.size(x) > 0)
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    bigrams = one(F.flatten("pieces"), lambda w: F.zip_with(F.slice(w, F.lit(1), n(w)), F.slice(w, F.lit(2), n(w)), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces.alias("pieces")).withColumn("b", bigrams)
    # Long templates must share many bigrams, common ones too; one of the rarest says little there.
    least = {k: len(known[k]) * threshold / (2 - threshold) - 1e-9 for k in first}
    long = {k for k in first if len(known[k]) > LONG}
    within = lambda c, of: F.filter(c, lambda x: x.isin(sorted({_hash(y) for z in of for y in z})))
    rare = F.exists("b", lambda x: x.isin(sorted({_hash(y) for k in first.keys() - long for y in first[k]})))
    many = F.size(F.array_distinct(within("b", [known[k] for k in long]))) >= min((least[k] for k in long), default=math.inf)
    rows = rows.where(rare | many if long else rare)
    rows = rows.withColumn("set", F.array_distinct(within("b", known.values())))
    offered = F.array(*(F.struct(F.lit(k).alias("license"), longs(known[k]).alias("template"), longs(a).alias("anchors"), F.lit(least[k]).alias("least")) for k, a in sorted(first.items())))
    rows = rows.withColumn("t", F.explode(F.filter(offered, lambda t: (F.size("set") >= t["least"]) & F.arrays_overlap("set", t["anchors"]))))
    template, size, need = F.col("t.template"), F.size("t.template"), F.col("t.least")
    rows = rows.withColumn("hits", F.array_intersect("set", template)).where(F.size("hits") >= need)
    # Places of words from 1: the last of each piece; a bigram has the place of its first word.
    ends = F.aggregate(F.transform("pieces", lambda x: F.size(x)), F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    rows = rows.withColumn("ends", ends).drop("pieces", "set")
    start = lambda k: F.when(k > 1, F.get("ends", k - 2)).otherwise(0) + 1
    score = lambda k: one(F.slice("b", F.greatest(start(k) - 1, F.lit(1)), F.get("ends", k - 1) - F.greatest(start(k) - 1, F.lit(1))), lambda x: F.size(F.filter(x, lambda h: F.array_contains("hits", h))) - threshold / 2 * F.size(x))
    rows = rows.withColumn("good", F.transform(F.sequence(F.lit(1), F.size("ends")), lambda k: score(k) > 0))
    bounds = lambda other: F.filter(F.sequence(F.lit(1), F.size("ends")), lambda k: F.get("good", k - 1) & ~F.coalesce(F.get("good", other(k)), F.lit(False)))
    rows = rows.withColumn("from", bounds(lambda k: F.when(k > 1, k - 2))).withColumn("to", bounds(lambda k: k))
    dice = lambda x: 2.0 * F.size(F.array_intersect(x, template)) / (F.size(x) + size)
    run = lambda i, j: one(F.array_distinct(F.slice("b", start(i), F.get("ends", j - 1) - start(i))), lambda x: F.struct((-dice(x)).alias("d"), F.col("t.license").alias("license"), i.alias("i"), j.alias("j")))
    far = lambda i: F.filter("to", lambda j: (j >= i) & (F.get("ends", j - 1) - start(i) >= need))
    found = F.filter(F.flatten(F.transform("from", lambda i: F.transform(far(i), lambda j: run(i, j)))), lambda x: x["d"] <= -threshold)
    rows = rows.select("doc_id", F.xxhash64("b").alias("h"), F.explode(found).alias("r")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("r")).alias("runs"))
    best = F.aggregate("runs", F.slice("runs", 1, 0), lambda a, x: F.when(F.exists(a, lambda y: (y["i"] <= x["j"]) & (x["i"] <= y["j"])), a).otherwise(F.concat(a, F.array(x))))
    return rows.select("doc_id", F.explode(best).alias("r")).select("doc_id", "r.license", (-F.col("r.d")).alias("dice"))


def license_scan(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, dice, n_units of every row of ``docs`` (doc_id, text, any others).

    license: the template of the highest coefficient of ``threshold`` or more among the lines and the whole text, the
    first by name if several tie, null if there is none; dice: its coefficient; n_units: how many units, repeated lines
    once, reach the threshold (0 if none). Runs between are units too where they reach more than all lines and the whole
    text of the document; ``templates``, if given, are all that runs are held against. Null, empty and one-word texts have no bigrams and match nothing. Rows of one
    doc_id are one document; rows without an id are one too. Very long texts are read whole.
    """
    known = {k: template_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    sizes = [(n, k, b) for k, b in known.items() if b for n in fitting_sizes(len(b), threshold)]
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    fits = spark.createDataFrame(sizes, "n int, license string, template array<string>").withColumn("template", hashed("template"))
    every = sorted({_signed(xxhash.xxh64_intdigest(x, seed=42)) for b in known.values() for x in b})
    least, most = min((x[0] for x in sizes), default=1), max((x[0] for x in sizes), default=0)
    text = F.lower(F.col("text").cast("string"))
    lines = F.transform(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.split(F.trim(x), " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _units(lines, most).alias("units"))
    # explode_outer: for explode the planner would compute all units once more to drop rows without any
    units = rows.select("doc_id", F.explode_outer("units").alias("bigrams")).withColumn("n", F.size("bigrams")).where(F.col("n").between(least, most)).where(F.exists("bigrams", lambda x: x.isin(every)))
    units = units.select("doc_id", F.array_sort("bigrams").alias("bigrams"), "n")
    dice = 2.0 * F.size(F.array_intersect("bigrams", "template")) / (F.col("n") + F.size("template"))
    scored = units.join(F.broadcast(fits), "n").withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "bigrams").agg(F.min(F.struct(F.negative("dice").alias("d"), "license")).alias("b")).groupBy("doc_id").agg(F.min("b").alias("b"), F.count("*").alias("n_units"))
    # Runs of at most as much as a line or the whole text reaches mostly are that line or text once more.
    lines_ = best.select("doc_id", F.col("b.d").alias("d"), F.col("b.license").alias("license"), "n_units", F.lit(0).alias("run"))
    runs = _runs(docs, known if templates else known | {k: template_bigrams(v) for k, v in TEXTS.items()}, threshold)
    runs = runs.select("doc_id", F.negative("dice").alias("d"), "license", F.lit(1).cast("long").alias("n_units"), F.lit(1).alias("run"))
    each = lines_.unionByName(runs.groupBy("doc_id", "d", "license", "run").agg(F.sum("n_units").alias("n_units")))
    top = each.groupBy("doc_id").agg(F.min(F.struct("d", "run", "license")).alias("b"), F.min(F.when(F.col("run") == 0, F.col("d"))).alias("line"), F.collect_list(F.struct("d", "run", "n_units")).alias("all"))
    units_ = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.when((x["run"] == 0) | F.col("line").isNull() | (x["d"] < F.col("line") - 1e-9), x["n_units"]).otherwise(0))
    found = top.select(F.col("doc_id").alias("id"), F.col("b.license").alias("license"), F.negative("b.d").alias("dice"), units_.alias("n_units"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "license", "dice", F.coalesce("n_units", F.lit(0)).alias("n_units"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB's SQL."""
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{x}'" for x in template_bigrams(v))) for k, v in TEMPLATES.items())
    return rf"""
WITH t(license, template) AS (VALUES {rows}),
c AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS clean FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_append(string_split(clean, chr(10)), replace(clean, chr(10), ' '))) AS unit FROM c),
w AS (SELECT doc_id, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM u),
b AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS bigrams
  FROM w WHERE len(words) > 1
),
s AS (
  SELECT doc_id, bigrams, license, 2.0 * len(list_intersect(bigrams, template)) / (len(bigrams) + len(template)) AS dice FROM b, t
  WHERE len(bigrams) * {threshold} <= len(template) * {2 - threshold} AND len(template) * {threshold} <= len(bigrams) * {2 - threshold}
),
m AS (SELECT doc_id, bigrams, max(CAST(dice AS DOUBLE)) AS dice, arg_min(license, (-dice, license)) AS license FROM s WHERE dice >= {threshold} GROUP BY doc_id, bigrams),
r AS (SELECT doc_id, count(*) AS n_units, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM m GROUP BY doc_id)
SELECT d.doc_id, r.license, r.dice, coalesce(r.n_units, 0) AS n_units
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id
"""


SQL = oracle()
