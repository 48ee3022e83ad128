"""License scans by canonical digest lookup: normalise, then hash-join entire texts, alone or as lines of a document, to known digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .common import checked_broadcast, stored

# Known notices and licences, whole texts.
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
GPL_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", BSD_HEAD + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_HEAD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
""" + BSD_WARRANTY),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""),
    ("GPL-2.0-or-later", GPL_NOTICE.format("2")),
    ("GPL-3.0-or-later", GPL_NOTICE.format("3")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]

# Spellings taken as equivalent, after lower-casing.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("defence", "defense"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"),
    ("modelled", "modeled"), ("programme", "program"), ("recognise", "recognize"), ("whilst", "while"),
    ("wilful", "willful"), ("fulfil", "fulfill"), ("analogue", "analog"), ("acknowledgement", "acknowledgment"),
]
# A line that states whose the copyright is; a wrapped line that only begins with the word is text.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|:|by\b|the\b)|\(c\)|©)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, spellings made equal; '' for null.

    Every word has blanks of its own on both sides, so that two spellings side by side are both replaced; line breaks stay.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), NOT_WORD, "  ")
    out = F.concat(F.lit(" "), F.replace(out, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def known_digests(spark, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license, first, n_words): one row per canonical text with words, the smallest name for texts listed twice."""
    table = spark.createDataFrame(known, "license string, text string").select("license", one_line(canonical(F.col("text"))).alias("t"))
    words = F.split("t", " ")
    table = table.filter("t <> ''").select("license", F.sha2("t", 256).alias("digest"), words[0].alias("first"), F.size(words).alias("n_words"))
    return table.groupBy("digest").agg(F.min("license").alias("license"), F.min("first").alias("first"), F.min("n_words").alias("n_words"))


def runs_of_lines(canon: Column, lengths: dict[str, list[int]]) -> Column:
    """(part, n_lines, digest) of the runs of whole lines that begin with a known first word and are as long as a text that does.

    Lines without words do not count, so a text may be wrapped, or broken by blank and copyright lines, in any way.
    """
    none = F.array().cast("array<int>")
    firsts = list(lengths)

    def sizes(word: Column) -> Column:
        out = none
        for first, some in lengths.items():
            out = F.when(word == first, F.array(*map(F.lit, some))).otherwise(out)
        return out

    def runs(lines: Column, starts: Column, words: Column) -> Column:
        def of(line: Column, k: Column) -> Column:
            begin = F.get(starts, k)
            fits = F.filter(sizes(line["w"][0]), lambda n: F.array_contains(starts, begin + n))
            return F.transform(fits, lambda n: F.struct(
                line["at"].cast("long").alias("part"),
                (F.get(lines, (F.array_position(starts, begin + n) - 2).cast("int"))["at"] - line["at"] + 1).cast("long").alias("n_lines"),
                F.sha2(F.array_join(F.slice(words, begin + 1, n), " "), 256).alias("digest")))

        return F.flatten(F.transform(lines, of))

    split = F.filter(F.transform(F.split(canon, "\n"), lambda x, i: F.struct(i.alias("at"), F.filter(F.split(x, " "), lambda w: w != "").alias("w"))),
                     lambda line: F.size(line["w"]) > 0)

    def with_starts(lines: Column) -> Column:
        starts = F.aggregate(lines, F.array(F.lit(0)), lambda acc, line: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(line["w"]))))
        words = F.flatten(F.transform(lines, lambda line: line["w"]))
        found = bind(starts, lambda s: bind(words, lambda w: runs(lines, s, w)))
        begins = F.exists(lines, lambda line: line["w"][0].isin(firsts))
        return F.when(begins, found).otherwise(F.array().cast("array<struct<part:bigint,n_lines:bigint,digest:string>>"))

    return bind(split, with_starts)


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, n_lines, license) for each entire text that is known: part -1 is the document, else the run's first line, from 0.

    The document, and every run of whole lines that may be a known text by its first word and number of words, is normalised and
    looked up by its digest; a match is an equal digest, never a similar text. A known text within a line is not found. Null
    texts and texts without words match nothing; repeated rows are reported once each; other columns are not read. The
    known table is broadcast if its count allows, else joined by a shuffle on digests; its first words and
    lengths are made part of the query.
    """
    known = stored(known.filter(F.col("digest").isNotNull()))
    lengths = {r["first"]: sorted(r["n"]) for r in known.groupBy("first").agg(F.collect_set("n_words").alias("n")).orderBy("first").collect()}
    known = checked_broadcast(known.select("digest", "license"))
    text = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("_text"))

    def units(canon: Column) -> Column:
        whole = F.struct(F.lit(-1).cast("long").alias("part"), F.size(F.split(canon, "\n")).cast("long").alias("n_lines"), F.sha2(one_line(canon), 256).alias("digest"))
        return F.concat(F.array(whole), runs_of_lines(canon, lengths)) if lengths else F.array(whole)

    found = text.select("id", F.inline(bind(F.col("_text"), units)))
    return found.join(known, "digest").select("id", "part", "n_lines", "license")
