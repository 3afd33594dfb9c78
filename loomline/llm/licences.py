"""Licence scans: TF-IDF cosine of licence lines to templates, then the nearest licensed directory.

A unit is a line that holds a licence word. Its terms are weighted by their frequency in the unit
and their rarity among the templates, so a line scores alike in every corpus; the template with the
largest cosine wins, at ``threshold`` or more, ties to the smaller name. A file's own licence is that of its best unit. A file
of at most ``file_words`` words with a licence is a licence file and covers its directory. A file
without a licence of its own takes that of the nearest covered directory above it.

Equal units are folded before anything else, so a notice that a third of all files carry is judged
once; inheritance is looked up once per directory. A null text has no units; a null path is in no
directory. Where several licence files cover one directory the smallest licence name holds. Equal
paths are judged row by row. Result columns replace columns of their name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import stash

THRESHOLD = 0.5
FILE_WORDS = 64
CUE = r"(?i)licen[cs]|copyright|spdx|permission is hereby|public domain"
RESULTS = ["licence", "own_licence", "score", "licence_file", "inherited_from"]

#: Fixed texts: the short notices by which files name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license that can be found in the LICENSE file",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0, Creative Commons Attribution-NonCommercial 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def template_terms(templates: dict[str, str]) -> list[tuple[str, str, float]]:
    """(licence, term, weight) of every template: the count in it times the rarity among all."""
    counts = {name: Counter(re.findall(_TERM, text.lower())) for name, text in sorted(templates.items())}
    df = Counter(t for c in counts.values() for t in c)
    return [(name, t, c[t] * rarity(df[t], len(counts))) for name, c in counts.items() for t in sorted(c)]


def rarity(df: int, n_templates: int) -> float:
    return math.log((n_templates + 1) / (df + 1)) + 1


def matches(distinct: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(unit, licence, score) of the units, each given once, that are near a template."""
    spark = distinct.sparkSession
    known = spark.createDataFrame(template_terms(templates), "licence string, term string, v double")
    df = known.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(F.lit(len(templates) + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    tf = distinct.select("unit", F.explode(terms(F.col("unit"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighted = tf.join(F.broadcast(df), "term", "left").select("unit", "term", (F.col("tf") * weight).alias("w"))
    sizes = known.groupBy("licence").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_size"))
    lengths = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_size"))
    dots = weighted.join(F.broadcast(known), "term").groupBy("unit", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(F.broadcast(sizes), "licence").join(lengths, "unit")
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("v_size") * F.col("w_size")), 9))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("b")
    return scored.groupBy("unit").agg(best).select("unit", F.col("b.l").alias("licence"), (-F.col("b.s")).alias("score")).filter(F.col("score") >= threshold)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, the root as an empty name."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), above))


def scan(
    files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD, file_words: int = FILE_WORDS,
) -> DataFrame:
    """(key, path, own_licence, score, licence_file, inherited_from, licence) per row of ``files``."""
    templates = templates or TEMPLATES
    lines = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(CUE)))
    short = F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")) <= file_words
    rows = files.select(F.col(key), F.col(path).alias("path"), short.alias("_short"), lines.alias("_lines"), directory(F.col(path)).alias("_dir"))
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.explode("_lines").alias("unit"))
    distinct = each.select("unit").distinct()
    found = each.join(matches(distinct, templates, threshold), "unit")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("b")
    own = found.groupBy("_row").agg(best).select("_row", F.col("b.l").alias("own_licence"), (-F.col("b.s")).alias("score"))
    judged = rows.join(own, "_row", "left").withColumn("licence_file", F.col("_short") & F.col("own_licence").isNotNull())
    covered = judged.filter("licence_file").groupBy("_dir").agg(F.min("own_licence").alias("_licence")).select(F.col("_dir").alias("_over"), "_licence")
    folders = rows.select("_dir").distinct().filter("_dir IS NOT NULL")
    up = folders.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("_over")).join(covered, "_over")
    near = up.groupBy("_dir").agg(F.max_by(F.struct("_over", "_licence"), F.length("_over")).alias("near"))
    out = judged.join(near, "_dir", "left")
    heir = F.col("own_licence").isNull() & F.col("near").isNotNull()
    return out.select(
        F.col(key), "path", "own_licence", "score", F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.when(heir, F.col("near._over")).alias("inherited_from"), F.coalesce("own_licence", "near._licence").alias("licence"),
    )
