"""Licence scan by Dice coefficient of word bigrams: single lines against notices, and passages of whole texts against notices and licence texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticelake.llm.common import cut
from noticelake.llm.license_texts import TEXTS

# Short licence notices as projects publish them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    "ISC": ("Licensed under the ISC License.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


#: What passages are compared with: notices and whole texts.
PASSAGES = {name: TEMPLATES.get(name, ()) + TEXTS.get(name, ()) for name in [*TEMPLATES, *(t for t in TEXTS if t not in TEMPLATES)]}


def normalised(text: Column) -> Column:
    """Lower case, every run of other characters than ASCII letters, digits and non-ASCII ones as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def bigrams(text: Column) -> Column:
    """The distinct word pairs of a normalised text, as neighbours joined by a space.

    Pairs are strings, whose distinct ones are found by hashing; structs would be compared with each other.
    """
    words = F.split(text, " ")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(license, variant, size, pair)``: a row for each bigram of each template."""
    rows = [(name, k, text) for name, variants in templates.items() for k, text in enumerate(variants)]
    given = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(k).alias("variant"), F.lit(text).alias("text")) for name, k, text in rows
    ]))).withColumn("pairs", bigrams(normalised(F.col("text"))))
    return given.select("license", "variant", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))


def telling_words(templates: dict[str, tuple[str, ...]], ratio: float) -> list[str]:
    """Words of which every matching line holds one; empty if there are no such words.

    A match shares at least ``ratio`` of a template's bigrams. So once fewer of them than that
    lack all of the chosen words, no match can do without those. Words in many bigrams go first,
    long ones before short ones, which other texts hold by chance.
    """
    wanted = [(found, math.ceil(len(found) * ratio - 1e-9)) for variants in templates.values() for t in variants if (found := _pairs(t))]
    chosen: list[str] = []
    while wanted:
        counts = Counter(w for left, need in wanted if len(left) >= need for pair in left for w in set(pair) if w.isascii())
        if not counts:
            return chosen if all(len(left) < need for left, need in wanted) else []
        best = min(counts, key=lambda w: (-counts[w] * len(w) ** 2, w))
        chosen.append(best)
        wanted = [({p for p in left if best not in p}, need) for left, need in wanted]
    return chosen


def telling_signs(templates: dict[str, tuple[str, ...]], ratio: float, letters: int = 5) -> list[str | tuple[str, str]]:
    """Words of at least ``letters`` letters, and word pairs, of which every matching passage holds one; empty if there are none.

    As ``telling_words``, but templates whose short words alone could still make a match are told by
    a pair: short words stand in most texts, pairs of them in few.
    """
    wanted = []
    for text in (t for variants in templates.values() for t in variants):
        words = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", text.lower()).strip().split(" ")
        pairs = list(zip(words, words[1:], strict=False))
        if pairs:
            wanted.append((pairs, math.ceil(len(pairs) * ratio - 1e-9)))
    signs: list[str | tuple[str, str]] = []
    while wanted := [(left, need) for left, need in wanted if len(left) >= need]:
        usable = [pair for left, _ in wanted for pair in left if pair[0].isascii() and pair[1].isascii()]
        counts = Counter(w for pair in usable for w in set(pair) if len(w) >= letters)
        if counts:
            sign = min(counts, key=lambda w: (-counts[w] * len(w) ** 3, w))
            wanted = [([p for p in left if sign not in p], need) for left, need in wanted]
        elif usable:
            sign = min(usable, key=lambda p: (-usable.count(p), -len(p[0] + p[1]), p))
            wanted = [([p for p in left if p != sign], need) for left, need in wanted]
        else:
            return []
        signs.append(sign)
    return signs


def license_lines(docs: DataFrame, at_least: float = 0.8, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``(doc_id, line, license, variant, dice)`` for the lines of ``docs(doc_id, text)`` that match a template.

    Dice is twice the shared over the summed sizes of the two sets of bigrams. A line of a bigrams
    can reach ``at_least`` only against templates of a*t/(2-t) to a*(2-t)/t, so other lines and
    templates are pruned by size before any bigram is met, and lines without any of the
    ``telling_words`` before their bigrams are made. Null and empty texts have no matches;
    rows that repeat a doc_id and a line at the same place count once; a null doc_id stays.
    ``templates`` is a fixed table of the caller's, sent to every task.
    """
    spark = docs.sparkSession
    wanted = template_table(spark, templates)
    sizes = sorted({len(_pairs(t)) for variants in templates.values() for t in variants})
    ratio = at_least / (2 - at_least)
    text = F.coalesce("text", F.lit(""))
    both = F.arrays_zip(F.split(text, "\n").alias("said"), F.split(F.lower(text), "\n").alias("low"))
    lines = docs.select("doc_id", F.posexplode(both).alias("line", "both")).select("doc_id", "line", "both.*")
    if words := telling_words(templates, ratio):
        lines = lines.where(reduce(Column.__or__, [F.contains("low", F.lit(w)) for w in words]))
    paired = lines.select("doc_id", "line", F.xxhash64("said").alias("_said"), bigrams(normalised(F.col("said"))).alias("pairs"))
    # The size test stands inside the explode: as a filter it would be pushed below and find the pairs twice.
    own = F.size("pairs")
    fits = (own >= min(sizes) * ratio) & (own <= max(sizes) / ratio)
    met = paired.select("doc_id", "line", "_said", own.alias("own"), F.explode(F.when(fits, F.col("pairs"))).alias("pair")).join(
        F.broadcast(wanted), "pair"
    ).where((F.col("own") >= F.col("size") * ratio) & (F.col("own") <= F.col("size") / ratio))
    shared = F.size(F.collect_set("pair"))
    return (
        met.groupBy("doc_id", "line", "_said", "license", "variant", "own", "size").agg(shared.alias("shared"))
        .withColumn("dice", 2.0 * F.col("shared") / (F.col("own") + F.col("size"))).where(F.col("dice") >= at_least)
        .select("doc_id", "line", "license", "variant", "dice")
    )


def _pairs(text: str) -> set[tuple[str, str]]:
    words = re.sub(r"[^a-z0-9\x80-\U0010FFFF]+", " ", text.lower()).strip().split(" ")
    return set(zip(words, words[1:], strict=False))


def license_passages(docs: DataFrame, at_least: float = 0.8, templates: dict[str, tuple[str, ...]] = PASSAGES) -> DataFrame:
    """``(doc_id, word, license, variant, dice)``: where in ``docs(doc_id, text)`` passages begin that match a template.

    A passage is as many consecutive words as the template has, or those left, wherever lines break,
    that begin with one of the template's bigrams; ``word`` counts from 0. Dice is twice the shared
    over the summed numbers of bigrams, repeats included. Texts without any of the ``telling_signs``
    are left out first. A passage of m words lies in two neighbouring stretches of m words, so only
    stretches that hold enough of a template's bigrams between them are looked at closer: no other
    passage can share the t * a / (2 - a) bigrams that a template of t needs. Null and empty texts
    have no matches; rows that repeat a doc_id and a text count once; a null doc_id stays.
    """
    ratio = at_least / (2 - at_least)
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    if signs := telling_signs(templates, ratio):
        held = [F.contains(low, F.lit(w)) if isinstance(w, str) else low.rlike("[^a-z0-9]+".join(w)) for w in signs]
        docs = docs.where(reduce(Column.__or__, held))
    rows = [(name, k, t) for name, variants in templates.items() for k, t in enumerate(variants)]
    wanted = docs.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(k).alias("variant"), F.split(normalised(F.lit(t)), " ").alias("w")) for name, k, t in rows
    ]))).where(F.size("w") > 1).select("license", "variant", F.size("w").alias("m"), F.explode(_neighbours(F.col("w"))).alias("pair"))
    wanted = wanted.groupBy("license", "variant", "m", "pair").agg(F.count("*").alias("held"))
    said = docs.select("doc_id", F.xxhash64(text).alias("_said"), F.split(normalised(F.col("text")), " ").alias("w"))
    places = said.select("doc_id", "_said", F.size("w").alias("n"), F.posexplode(_neighbours(F.col("w"))).alias("word", "pair"))
    of = ["doc_id", "_said", "license", "variant"]
    met = places.join(F.broadcast(wanted), "pair").groupBy(*of, "n", "m", "word", "pair", "held").agg(F.lit(1).alias("one")).drop("one")
    hits = cut(met.select("*", F.floor(F.col("word") / F.col("m")).alias("stretch"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")))
    by = ["_id", "_none", "_said", "license", "variant", "stretch"]
    # A hit counts for passages that begin in its own stretch or in the one before.
    both = F.explode(F.array(F.col("stretch"), F.col("stretch") - 1))
    counted = hits.groupBy(*by, "m").agg(F.count("*").alias("found"))
    dense = (
        counted.select(*by[:-1], "m", "found", both.alias("stretch")).groupBy(*by, "m").agg(F.sum("found").alias("found"))
        .where(F.col("found") >= (F.col("m") - 1) * ratio).select(*by)
    )
    starts = hits.join(dense, by, "left_semi").select(*by, "doc_id", "n", "m", F.col("word").alias("start"))
    held = hits.select(*by[:-1], both.alias("stretch"), "word", "pair", "held").join(dense, by, "left_semi")
    inside = starts.join(held, by).where((F.col("word") >= F.col("start")) & (F.col("word") <= F.col("start") + F.col("m") - 2))
    passage = [*by, "doc_id", "n", "m", "start"]
    shared = inside.groupBy(*passage, "pair", "held").agg(F.count("*").alias("times")).groupBy(*passage).agg(F.sum(F.least("times", "held")).alias("shared"))
    size = F.col("m") - 1
    own = F.least(F.col("m"), F.col("n") - F.col("start")) - 1
    return shared.withColumn("dice", 2.0 * F.col("shared") / (own + size)).where(F.col("dice") >= at_least).select(
        "doc_id", F.col("start").alias("word"), "license", "variant", "dice"
    )


def _neighbours(words: Column) -> Column:
    """Word pairs with repeats, joined by a space."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def licenses_of(docs: DataFrame, at_least: float = 0.8, notices: dict[str, tuple[str, ...]] = TEMPLATES, passages: dict[str, tuple[str, ...]] = PASSAGES) -> DataFrame:
    """``(doc_id, license, dice, n_lines, word)`` for each document's licences.

    The best Dice of a line or passage, how many lines match, and the first word of the best passage
    (the first of equals; null if only lines match).
    """
    lines = license_lines(docs, at_least, notices).groupBy("doc_id", "line", "license").agg(F.max("dice").alias("dice"))
    lines = lines.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_lines"))
    best = F.max(F.struct("dice", (-F.col("word")).alias("back")))
    found = license_passages(docs, at_least, passages).groupBy("doc_id", "license").agg(best.alias("best"))
    both = lines.withColumn("word", F.lit(None).cast("int")).unionByName(
        found.select("doc_id", "license", "best.dice", F.lit(0).cast("long").alias("n_lines"), (-F.col("best.back")).alias("word"))
    )
    return both.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("n_lines").alias("n_lines"), F.max("word").alias("word"))
