"""Licence texts in documents by the Dice coefficient of word bigrams, in DataFrame operations only.

Every line, every paragraph of several lines, every sentence of a line that speaks of a licence among other things, and every
sentence that runs over several lines of a paragraph that grants something, is normalised (lower case, runs of anything but a-z and 0-9, comment marks too, become one
space) and compared with licence templates: 2 |A and B| / (|A| + |B|) over the sets of word bigrams. A template of b bigrams can
reach the threshold t only with a between t b / (2 - t) and b (2 - t) / t bigrams, so sizes prune nearly all comparisons
before any set is intersected. Each version of a licence has its own templates, so that a notice goes to the nearest one. The templates are a fixed table of a few kilobytes inside the plan; nothing is shuffled
but one row per find.

Edge cases: NULL, empty and one-word units have no bigrams and match nothing. Equal scores: the first licence by name, then the
first unit. Repeated rows each have their finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.quality_votes import let
from lintlake.llm.text import text_or_empty

THRESHOLD = 0.8

# Public licence notices (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


# Lines that speak of a licence, and where their sentences part (both engines read these patterns alike).
NAMED = "[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]"
SENTENCE = "[.!?;] +"
# Paragraphs part at lines that are blank or hold comment marks only; marks and blanks at their ends don't make a second line.
MARKS = "/#*;%-"
PARTED = r"\n[ \t\r]*[/#*;%-]*[ \t\r]*\n"
EDGES = " \t\r\n" + MARKS
# Paragraphs that grant something, and where their sentences part, at ends of lines too.
GRANTS = NAMED + "|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb][Uu][Tt]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]|[Uu][Nn][Ee][Nn][Cc][Uu][Mm][Bb][Ee][Rr][Ee][Dd]"
WRAPPED = r"[.!?;][ \r\n]+"


def normalised_words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1]))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def best_match(unit: Column, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """(dice, licence) of the best template at or above the threshold, or NULL."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    least = threshold / (2 - threshold)
    sizes = [len(b) for _, b in known]

    def compare(own: Column) -> Column:
        def one(name: str, theirs: list[str]) -> Column:
            b = len(theirs)
            fits = (F.size(own) >= least * b) & (F.size(own) * least <= b)
            shared = F.size(F.array_intersect(own, F.array(*map(F.lit, theirs))))
            dice = 2 * shared / (F.size(own) + b)
            return F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("licence")))

        found = F.filter(F.array(*[one(*k) for k in known]), lambda m: m["dice"] >= threshold)
        # The greatest score, then the first name.
        return F.aggregate(found, F.lit(None).cast("struct<dice:double,licence:string>"), lambda best, m: F.when(
            best.isNull() | (m["dice"] > best["dice"]) | ((m["dice"] == best["dice"]) & (m["licence"] < best["licence"])), m).otherwise(best))

    def sized(words: Column) -> Column:
        return F.when(F.size(words) - 1 >= least * min(sizes), let(bigrams(words), compare))

    return let(normalised_words(unit), sized)


def units(text: Column) -> Column:
    """Lines, then paragraphs of more than one line, then sentences of lines that have several and speak of a licence, then sentences
    over several lines of paragraphs that have several and grant something, in order."""
    wrapped = lambda p: F.btrim(p, F.lit(EDGES)).contains("\n")
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, PARTED), wrapped)
    several = F.filter(lines, lambda x: x.rlike(NAMED) & x.rlike(SENTENCE + "[^ ]"))
    granting = F.filter(paragraphs, lambda p: p.rlike(GRANTS) & p.rlike(WRAPPED + "[^ \r\n]"))
    return F.concat(lines, paragraphs, F.flatten(F.transform(several, lambda x: F.split(x, SENTENCE))),
                    F.flatten(F.transform(granting, lambda p: F.filter(F.split(p, WRAPPED), wrapped))))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``licences``: array of (unit, dice, licence), one entry per unit that matches."""
    def of(all_: Column) -> Column:
        rated = F.transform(all_, lambda u, i: F.struct(i.alias("unit"), best_match(u, threshold).alias("m")))
        return F.transform(F.filter(rated, lambda r: r["m"].isNotNull()), lambda r: F.struct(r["unit"], r["m"]["dice"].alias("dice"), r["m"]["licence"].alias("licence")))

    return docs.withColumn("licences", let(units(text_or_empty(F.col(text))), of))
