"""Licence scan: normalised text against templates by the Dice coefficient of word bigrams; DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

THRESHOLD = 0.8
# fixed values: notices of common licences, as their authors ask to print them
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."],
}
# fixed values: words too common in any text to look for first
COMMON = {"a", "and", "any", "at", "be", "by", "can", "do", "for", "from", "if", "in", "is", "it", "may", "not", "of", "on", "one", "or", "so", "that", "the",
          "they", "this", "to", "use", "was", "with", "you", "0", "2", "3", "4", "v"}


def normal_words(text: str) -> list[str]:
    """The plain form of ``words_of``, for the templates: lower case, runs of anything but letters and digits split."""
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, str, list[str]]]:
    """(licence, template, bigrams) of every template."""
    out = []
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            words = normal_words(text)
            out.append((name, f"{name}#{k}", sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or set(words))))
    return out


def anchors(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """A few words so that a text alike to a template must hold one of them.

    A text of Dice t shares at least t / (2 - t) of a template's bigrams, so of any larger set of them than may be missing one is shared; words
    are taken, most useful first, until they occur in that many bigrams of every template.
    """
    rows, chosen = template_rows(templates), []
    spare = {t: int(len(b) * (1 - threshold / (2 - threshold)) + 1e-9) + 1 for _, t, b in rows}
    hit = lambda words, b: sum(any(w in g.split() for w in words) for g in b)
    while any(hit(chosen, b) < spare[t] for _, t, b in rows):
        short = [(t, b) for _, t, b in rows if hit(chosen, b) < spare[t]]
        words = sorted({w for _, b in short for g in b for w in g.split()})
        chosen.append(max(words, key=lambda w: (w not in COMMON and sum(min(hit([*chosen, w], b), spare[t]) - hit(chosen, b) for t, b in short), len(w), w)))
    return chosen


def notices(docs: DataFrame, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, license, dice, n_matches) of notices anywhere in (doc_id, text): windows of words across the ends of lines and sentences.

    A window that is alike to a template stays so without its outer words that the template lacks, so windows run from one shared bigram to
    another.  From each shared bigram with enough of them close behind it the end of the highest Dice is taken (bigrams that the template
    lacks count each time they occur), and of windows that overlap the most alike one stays, whatever its licence.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    length = {f"{name}#{k}": len(normal_words(text)) for name, texts in templates.items() for k, text in enumerate(texts)}
    rows = [(name, key, len(grams), max(1, math.ceil(low * len(grams) - 1e-9)), int(high * len(grams) + 1e-9) + length[key] - 1 - len(grams), k, gram)
            for name, key, grams in template_rows(templates) for k, gram in enumerate(grams)]
    table = docs.sparkSession.createDataFrame(rows, "license string, template string, m int, need int, reach int, k int, gram string")
    keys = ["_row", "doc_id", "_text", "license", "template", "m", "need", "reach"]
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("words")).where(F.size("words") > 1)
    grams = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    hits = words.select("_row", "doc_id", "_text", F.posexplode(grams).alias("pos", "gram")).join(F.broadcast(table), "gram")  # a fixed table
    hits = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "k"))).alias("hits")).where(F.size("hits") >= F.col("need"))
    close = lambda i: F.get("hits", i + F.col("need") - 1)["pos"] - F.get("hits", i)["pos"] < F.col("reach")
    spans = hits.select(*keys, "hits", F.explode(F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("need")), close)).alias("_i"))
    spans = spans.withColumn("first", F.get("hits", F.col("_i"))["pos"]).withColumn(
        "hits", F.filter(F.slice("hits", F.col("_i") + 1, F.col("reach")), lambda x: x["pos"] < F.col("first") + F.col("reach")))

    def step(acc: Column, x: Column) -> Column:
        again = F.array_contains(acc["seen"], x["k"])
        both = F.size(acc["seen"]) + F.when(again, 0).otherwise(1)
        twice = acc["twice"] + F.when(again, 1).otherwise(0)
        dice = 2.0 * both / (x["pos"] - F.col("first") + 1 - twice + F.col("m"))
        return F.struct(F.when(again, acc["seen"]).otherwise(F.concat(acc["seen"], F.array(x["k"]))).alias("seen"), twice.alias("twice"),
                        F.greatest(acc["best"], F.struct(dice.alias("dice"), x["pos"].alias("last"))).alias("best"))

    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("twice"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("last")).alias("best"))
    spans = spans.withColumn("best", F.aggregate("hits", start, step)["best"]).where(F.col("best.dice") >= threshold - 1e-9)
    span = F.struct((-F.col("best.dice")).alias("order"), (F.col("first") - F.col("best.last")).alias("short"), "first", F.col("best.last").alias("last"), "license", "template")
    # only windows of one run of overlapping ones are compared, so a text with very many notices costs no more for each
    ahead = Window.partitionBy("_row").orderBy("span.first", "span.last").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_row", "doc_id", "_text", span.alias("span")).withColumn("_opens", (F.col("span.first") > F.coalesce(F.max("span.last").over(ahead), F.lit(-1))).cast("int"))
    spans = spans.withColumn("_run", F.sum("_opens").over(Window.partitionBy("_row").orderBy("span.first", "span.last")))
    spans = spans.groupBy("_row", "_run", "doc_id", "_text").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    apart = lambda kept, s: ~F.exists(kept, lambda o: (o["first"] <= s["last"]) & (s["first"] <= o["last"]))
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda kept, s: F.when(apart(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    found = spans.select("doc_id", "_text", F.explode(kept).alias("s")).select("doc_id", "_text", "s.*")
    return found.groupBy("doc_id", "license").agg((-F.min("order")).alias("dice"), F.countDistinct("_text", "first", "last").alias("n_matches"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_matches): one row per document and licence with a notice anywhere in the whole text.

    A notice is a window of words, across the ends of lines and sentences, that is alike to a template (``notices``); where windows overlap
    one counts.  ``dice`` is the best one's, ``n_matches`` counts them.  Only texts that hold an anchor word are read on, and
    only windows that hold between t / (2 - t) and (2 - t) / t times the template's bigrams are compared.  The templates are a fixed
    table, each of two words or more.  Null, empty and clean texts give no rows, an empty table none either; repeated rows
    count once, rows of one id are counted together; a null id is one id; of equally alike windows the longer one counts.
    """
    templates = TEMPLATES if templates is None else templates
    if any(len(normal_words(text)) < 2 for texts in templates.values() for text in texts):
        raise ValueError("a template needs two words or more")
    words = "|".join(sorted(anchors(templates, threshold)))
    anchor = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])"
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).where(F.col("text").rlike(anchor))
    return notices(texts, templates, threshold).select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches")
