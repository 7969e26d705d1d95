"""Licence scans: normalised text against templates by the Dice coefficient over word bigrams.

A text is looked at as a whole, line by line, and in windows of words as long as a template: notices are
lines or wrapped paragraphs of other texts, and licences whole files. A window is put where a text has an
anchor, one of a template's bigrams, as far before it as in the template, so a long text costs its
words and what its anchors ask for. Normalising lower-cases and keeps runs of letters, digits and points between digits, so
quoting and layout don't count. The Dice coefficient of two bigram sets is at most twice the smaller
over the sum of both sizes: a segment and a template whose sizes exclude the least wanted likeness are
never compared. Column expressions only.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let

LEAST = 0.8

#: Licence notices and short licences by their usual names.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "BSD-3-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
}

WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_split = words  # where an argument has its name


def _words(text: str) -> list[str]:
    import regex

    return regex.findall(WORD, text.lower())


@lru_cache
def _table() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Licence and bigrams of each template."""
    return tuple((name, tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))) for name, texts in TEMPLATES.items() for w in map(_words, texts))


def bigrams(words: Column) -> Column:
    """The distinct word bigrams, each as one string."""
    return let(words, lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))))


#: Templates of fewer words are looked for in lines only. Of longer ones, as many bigrams, spread over the template, are anchors.
LONG, ANCHORS = 20, 6
#: What a text must hold to be looked at in windows; every long template does.
HINTS = ("licens", "software")


@lru_cache
def _windows() -> tuple[tuple[str, int, tuple[tuple[int, str], ...]], ...]:
    """Licence, number of words and anchors (offset, bigram) of each template, in the order of _table(); short ones have no anchors."""
    out = []
    for name, texts in TEMPLATES.items():
        for w in map(_words, texts):
            found = []
            for k in range(ANCHORS if len(w) >= LONG else 0):
                at = len(w) * k // ANCHORS
                # Long words tell more; the first two in this part of the template, or its first bigram.
                o = next((i for i in range(at, len(w) * (k + 1) // ANCHORS - 1) if min(len(w[i]), len(w[i + 1])) >= 5), at)
                found.append((o, f"{w[o]} {w[o + 1]}"))
            out.append((name, len(w), tuple(found)))
    return tuple(out)


def _anchors() -> dict[str, list[tuple[int, int]]]:
    """Templates, by their number, and offsets of each anchor."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, anchors) in enumerate(_windows()):
        for o, gram in anchors:
            found.setdefault(gram, []).append((t, o))
    return found


def windows(words: Column, lines: Column, least: float) -> Column:
    """The windows of a text's words that are alike to a template: an array of (dice, licence, line). lines: the lines of the text."""
    array = lambda parts: "array(" + ",".join(parts) + ")"
    table, of = _table(), _windows()
    anchors = F.expr("map(" + ",".join(f"{_quoted(g)},{array(f'struct({t} as t, {o} as o)' for t, o in places)}" for g, places in _anchors().items()) + ")")
    grams = F.expr(array(array(map(_quoted, g)) for _, g in table))
    names, sizes = F.expr(array(_quoted(n) for n, _, _ in of)), F.expr(array(str(n) for _, n, _ in of))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(words, i + 1)).alias("g"), i.alias("i")))
    hits = F.filter(pairs, lambda p: p["g"].isin(list(_anchors())))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.transform(F.element_at(anchors, p["g"]), lambda a: F.struct(a["t"].alias("t"), F.greatest(p["i"] - a["o"], F.lit(0)).alias("at"))))))

    def dice(s: Column) -> Column:
        mine = F.get(grams, s["t"])
        own = bigrams(F.slice(words, s["at"] + 1, F.get(sizes, s["t"])))
        return let(own, lambda b: F.struct((2.0 * F.size(F.array_intersect(b, mine)) / (F.size(b) + F.size(mine))).alias("dice"), F.get(names, s["t"]).alias("licence"), s["at"].alias("at")))

    found = F.filter(F.transform(starts, dice), lambda h: h["dice"] >= least)
    # A line starts after all words of those before it.
    ends = F.transform(lines, lambda x: F.size(_split(x)))
    upto = lambda c: F.transform(c, lambda _, k: F.aggregate(F.slice(c, 1, k + 1), F.lit(0), lambda a, x: a + x))
    line = lambda at: F.size(F.filter(upto(ends), lambda e: e <= at)) + 1
    return F.transform(found, lambda h: F.struct(h["dice"].alias("dice"), h["licence"].alias("licence"), line(h["at"]).cast("int").alias("line")))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(segment: Column, line: Column, least: float) -> Column:
    """Of a segment's words, the templates whose size allows the least likeness, each with its Dice coefficient of at least that: an array of (dice, licence, line).

    A segment has one bigram less than words at most, and at least one where it has two, so most
    segments are told from the number of words before any bigram is made.
    """
    low, high = least / (2 - least), (2 - least) / least
    sizes = [len(b) for _, b in _table()]

    def compare(b: Column) -> Column:
        hits = []
        for name, grams in _table():
            n = len(grams)
            template = F.expr("array(" + ",".join(map(_quoted, grams)) + ")")
            dice = 2.0 * F.size(F.array_intersect(b, template)) / (F.size(b) + n)
            fits = (F.size(b) >= F.lit(low * n - 1e-9)) & (F.size(b) <= F.lit(high * n + 1e-9))
            hits.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(name).alias("licence"), line.alias("line"))))
        return F.filter(F.array(*hits), lambda h: h.isNotNull() & (h["dice"] >= least))

    none = F.array().cast("array<struct<dice:double,licence:string,line:int>>")
    # A text of many more words than the largest template allows can still have few distinct bigrams; only small ones are excluded by words.
    return F.when(F.size(segment) - 1 >= F.lit(low * min(sizes) - 1e-9), let(bigrams(segment), lambda b: F.when((F.size(b) >= F.lit(low * min(sizes) - 1e-9)) & (F.size(b) <= F.lit(high * max(sizes) + 1e-9)), compare(b)).otherwise(none))).otherwise(none)


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with licence, dice and line of the best match, the number of matching segments n_matches, and all matches, an array of (dice, licence, line).

    line is the number from 1 of the line that matched or that a matching window starts in, 0 for the
    whole text; n_matches counts lines. The best has the greatest coefficient, then the first licence by
    name, then the first line. Texts without a match, null and empty ones among them, have null licence,
    dice and line. A very long text is one row like any, and is read whole; an empty table gives an empty
    one; rows that are repeated have equal results. Columns of these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    by_line = F.flatten(F.transform(lines, lambda x, i: let(words(x), lambda w: candidates(w, (i + 1).cast("int"), least))))
    # Whole texts of one line are that line.
    whole = F.when(text.contains("\n"), let(words(text), lambda w: candidates(w, F.lit(0), least))).otherwise(F.array().cast("array<struct<dice:double,licence:string,line:int>>"))
    best = F.element_at(F.array_sort(F.col("matches"), lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["licence"] != b["licence"], F.when(a["licence"] < b["licence"], -1).otherwise(1)).otherwise(a["line"] - b["line"])), 1)
    hinted = F.lower(text).contains(HINTS[0]) | F.lower(text).contains(HINTS[1])
    in_windows = F.when(hinted & text.contains("\n"), let(words(text), lambda w: windows(w, lines, least))).otherwise(F.array().cast("array<struct<dice:double,licence:string,line:int>>"))
    found = docs.withColumn("matches", F.array_distinct(F.concat(by_line, whole, in_windows)))
    found = found.withColumn("best_", F.when(F.size("matches") > 0, best))
    return found.withColumns({"licence": F.col("best_.licence"), "dice": F.col("best_.dice"), "line": F.col("best_.line"), "n_matches": F.size(F.array_distinct(F.transform("matches", lambda m: m["line"]))).cast("long")}).drop("best_")
