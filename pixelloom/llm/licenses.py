"""Licence scan with DataFrame functions only: Dice coefficient over word bigrams against licence templates.

Texts are normalised: lower case, everything but a-z and 0-9 is one space. Units of a document are its lines, its paragraphs (parts
between blank lines; the whole text where there are none) and all runs of consecutive lines, blank ones left out, of no more
words than the largest template allows. So a notice is found however it is wrapped or commented, and amid other lines.

A Dice coefficient of t needs sizes within a factor of t / (2 - t), and as many shared bigrams as that share of the
template. So a text is looked at by units only where it has that share of some template's bigrams as a whole; its units are
ranges of one array of bigrams, and a run begins and ends with lines that have a bigram of some template, since cutting
off others lowers no coefficient. Everything stays in one projection per document, so hot sources and copies need no shuffle.

Defined results: null and empty texts have no units and no licence; ties between templates go to the earlier one in
the list; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices and texts of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Reserved", "All rights reserved."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)


def normal(text: str) -> list[str]:
    """The words of a template."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams(text: str) -> list[tuple[str, str]]:
    words = normal(text)
    return list(dict.fromkeys(zip(words, words[1:], strict=False)))


def limits(templates: tuple[tuple[str, str], ...], percent: int) -> tuple[int, int]:
    """The fewest bigrams of a unit that can reach the threshold, and the most."""
    sizes = [len(bigrams(text)) for _, text in templates]
    return -(-min(sizes) * percent // (200 - percent)), max(sizes) * (200 - percent) // percent


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once: a column that is named inside another's lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Array of (line, word) of the text."""
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")
    return F.flatten(F.transform(F.split(clean, "\n"), lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("word")))))


def _units(words: Column, pairs: Column, known: Column, low: int, high: int) -> Column:
    """Ranges (a, b) of words: lines, paragraphs, runs of lines."""
    line = lambda p: F.get(words, p)["line"]
    at = F.sequence(F.lit(0), F.size(words) - 1)
    starts = lambda new: F.concat(F.filter(at, lambda p: (p == 0) | new(p)), F.array(F.size(words)))
    numbers = lambda c: F.sequence(F.lit(0), F.size(c) - 2)
    own = lambda c: F.transform(numbers(c), lambda k: F.struct(F.get(c, k).alias("a"), F.get(c, k + 1).alias("b")))

    def runs(lines: Column) -> Column:
        # whether a line has a bigram of a template, or one that leads over to it or on from it
        before = lambda k: F.greatest(F.get(lines, k), F.lit(1))
        marked = F.transform(numbers(lines), lambda k: F.arrays_overlap(known, F.slice(pairs, before(k), F.get(lines, k + 1) - before(k) + 1)))
        fits = lambda m, k, j: F.get(m, j) & (F.get(lines, j + 1) - F.get(lines, k) <= high + 1)
        from_line = lambda m, k: F.filter(F.sequence(k, F.least(F.size(m) - 1, k + high)), lambda j: fits(m, k, j))
        range_of = lambda k, j: F.struct(F.get(lines, k).alias("a"), F.get(lines, j + 1).alias("b"))
        return let(marked, lambda m: F.flatten(F.transform(F.filter(numbers(lines), lambda k: F.get(m, k)), lambda k: F.transform(from_line(m, k), lambda j: range_of(k, j)))))

    paragraphs = let(starts(lambda p: line(p) > line(p - 1) + 1), own)
    every = let(starts(lambda p: line(p) != line(p - 1)), lambda lines: F.concat(own(lines), paragraphs, runs(lines)))
    # a unit of w words has w - 1 bigrams, fewer if some repeat: only the lower bound can be told from w
    return F.filter(F.array_distinct(every), lambda u: u["b"] - u["a"] > low)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence (of the best template, null if none reaches percent), dice (the highest coefficient that reaches it,
    else 0), licences (all found, sorted, comma-joined)."""
    grams = [bigrams(text) for _, text in templates]
    sizes = [len(g) for g in grams]
    low, high = limits(templates, percent)
    hashed = [F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in g)) for g in grams]
    every = F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted({x for g in grams for x in g})))

    def dice(g: Column, k: int) -> Column:
        n = sizes[k]
        fits = (percent * n <= (200 - percent) * F.size(g)) & (percent * F.size(g) <= (200 - percent) * F.lit(n))
        return F.when(fits, 2 * F.size(F.array_intersect(g, hashed[k])) / (F.size(g) + n)).otherwise(F.lit(0.0))

    def best(words: Column, pairs: Column, known: Column) -> Column:
        """The highest coefficient of each template that reaches percent, else 0."""
        own = F.filter(F.transform(_units(words, pairs, known, low, high), lambda u: F.array_distinct(F.slice(pairs, u["a"] + 1, u["b"] - u["a"] - 1))), lambda g: F.size(g).between(low, high))
        highest = lambda found, k: F.coalesce(F.array_max(F.transform(found, lambda g: dice(g, k))), F.lit(0.0))
        return let(own, lambda found: F.transform(F.array(*(highest(found, k) for k in range(len(templates)))), lambda x: F.when(100 * x >= percent, x).otherwise(F.lit(0.0))))

    def looked(words: Column, pairs: Column, known: Column) -> Column:
        # the share of a template's bigrams that Dice's coefficient needs
        may = [F.size(F.array_intersect(known, hashed[k])) * (200 - percent) >= percent * n for k, n in enumerate(sizes)]
        return F.when(functools.reduce(lambda a, b: a | b, may), best(words, pairs, known)).otherwise(F.array(*[F.lit(0.0)] * len(templates)))

    paired = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.xxhash64(x["word"], y["word"]))
    found = let(words(F.coalesce(docs[text_col], F.lit(""))), lambda w: let(paired(w), lambda pairs: let(F.array_intersect(pairs, every), lambda known: looked(w, pairs, known))))
    tops = docs.select(docs[id_col].alias("doc_id"), found.alias("best")).withColumn("dice", F.array_max("best"))
    names = F.array(*(F.lit(name) for name, _ in templates))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda name, i: F.when(F.col("best")[i] > 0, name)), lambda x: x.isNotNull())))
    first = names[F.array_position("best", F.col("dice")).cast("int") - 1]
    return tops.select("doc_id", F.when(F.col("dice") > 0, first).alias("licence"), F.round("dice", 6).alias("dice"), F.array_join(found, ",").alias("licences"))
