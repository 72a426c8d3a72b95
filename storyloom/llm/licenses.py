"""License scans: MinHash bands over overlapping word windows retrieve templates, exact shingle containment verifies.

Texts that can't reach the containment asked for, as they have none of the words that every match needs, are left out
first. Windows of WINDOW words start at every STRIDE-th word; each has WINDOW - SHINGLE + 1 shingles and BANDS bands of
one MinHash value. Any window that holds a template's shingle shares at least one of its four shingles with a window of
that template, so that it is retrieved with probability 1 - (3/4)^32 = 0.9999 at least, and two windows hold each shingle.
DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, session

SHINGLE, WINDOW, STRIDE, BANDS = 5, 8, 2, 32
CONTAINMENT = 0.8

BROADCAST_SHINGLES = 200_000  # of all templates, up to which their table is broadcast

_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(license: str, version: str) -> str:
    return f"is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


# Customary notices and whole texts of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        _gnu("General Public License", "3"),
    ],
    "GPL-2.0": [_gnu("General Public License", "2")],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3")],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1")],
    "AGPL-3.0": [_gnu("Affero General Public License", "3")],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _WARRANTY,
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
}


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_shingles(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(license, number, its words joined by blanks in shingles) for each template of at least SHINGLE words."""
    out = []
    for name, texts in templates.items():
        for number, text in enumerate(texts):
            w = words(text)
            if len(w) < SHINGLE:
                raise ValueError(f"template {name} {number} has fewer than {SHINGLE} words")
            out.append((name, number, [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]))
    return out


def needed_words(shingles: list[str], containment: float, without=frozenset()) -> set[str]:
    """Words one of which any text has that contains enough of the shingles: long words, not among `without`, that more
    shingles than may be missing have. Empty if there are no such words."""
    distinct, chosen = set(shingles), set()
    left = set(distinct)
    for word in sorted({w for s in distinct for w in s.split()} - set(without), key=lambda w: (-len(w), w)):
        if any(word in s.split() for s in left):
            chosen.add(word)
            left = {s for s in left if word not in s.split()}
        if len(distinct) - len(left) > (1 - containment) * len(distinct) + 1e-9:
            return chosen
    return set()


def needed_sets(shingles: list[str], containment: float, most: int = 4) -> list[set[str]]:
    """At most `most` disjoint sets like that of needed_words: a text needs a word of each."""
    out: list[set[str]] = []
    while len(out) < most and (more := needed_words(shingles, containment, set().union(*out))):
        out.append(more)
    return out


def _may_match(low: Column, templates: dict, containment: float) -> Column:
    """Whether a lower-case text has the words that some template needs. The usual text has none of the first ones."""
    sets = [needed_sets(t, containment) for _, _, t in template_shingles(templates)]
    if not all(sets):
        return F.lit(True)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in sorted(words)])
    first = set().union(*(s[0] for s in sets))
    first = {w for w in first if not any(o != w and o in w for o in first)}
    return has(first) & reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(has, s)) for s in sets])


def _hash(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def _bands(shingles: list[Column]) -> Column:
    """BANDS keys of a window from the hashes of its shingles; a null hash counts for nothing."""
    low = lambda i: F.least(*[F.when(s.isNotNull(), F.xxhash64(s, F.lit(i))) for s in shingles])
    return F.array(*[F.xxhash64(low(i), F.lit(i)) for i in range(BANDS)])


def _windows(shingles: Column, step: int) -> Column:
    """Windows of WINDOW - SHINGLE + 1 shingle hashes, as structs of their place and hashes, from an array of hashes."""
    size = WINDOW - SHINGLE + 1
    starts = F.sequence(F.lit(0), F.greatest(F.size(shingles) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), *[F.try_element_at(shingles, (s + 1 + k).cast("int")).alias(f"h{k}") for k in range(size)]))


def _templates(spark: SparkSession, templates: dict) -> DataFrame:
    """(license, template, n, shingles): hashes of the shingles of each template."""
    rows = [(name, number, len(set(s)), s) for name, number, s in template_shingles(templates)]
    df = spark.createDataFrame(rows, "license string, template int, n int, shingles array<string>")
    return df.withColumn("shingles", F.transform("shingles", _hash))


def _word_array(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def find_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, start_word, end_word, containment) for each occurrence of a template.

    Words are runs of a-z and 0-9 after lower-casing, counted from 0. An occurrence is a run of places with shingles of
    the template that are no further apart than the template is long, and holds at least `containment` of them; its
    end_word is the last word of its last shingle. Null and empty texts have none. Rows that share an id are taken as
    parts of one document: their places are counted in each. A null id is kept. Other columns are ignored. An empty table
    gives an empty result. The templates' table is broadcast up to BROADCAST_SHINGLES shingles and joined by a shuffle
    beyond.
    """
    templates = templates or TEMPLATES
    bounded = sum(len(t) for _, _, t in template_shingles(templates)) <= BROADCAST_SHINGLES
    small_side = F.broadcast if bounded else (lambda df: df)
    spark = session(docs)
    text = F.col(text_col).cast("string")
    src = docs.filter(_may_match(F.lower(text), templates, containment)).select(F.col(id_col).cast("long").alias("doc_id"), _word_array(text).alias("words"))
    n = F.size("words") - SHINGLE + 1
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _hash(F.array_join(F.slice("words", i, SHINGLE), " ")))
    hashed = src.filter(n > 0).select("doc_id", each.alias("shingles"))
    windows = hashed.select("doc_id", F.explode(_windows(F.col("shingles"), STRIDE)).alias("w"))
    size = WINDOW - SHINGLE + 1
    parts = [F.col(f"h{k}") for k in range(size)]
    windows = windows.select("doc_id", "w.*").withColumn("key", F.explode(_bands(parts)))

    table = _templates(spark, templates)
    keys = table.select("license", "template", F.explode(_windows(F.col("shingles"), 1)).alias("w")).select("license", "template", "w.*")
    keys = keys.select("license", "template", F.explode(_bands(parts)).alias("key")).distinct()
    hits = windows.join(small_side(keys), "key").select("doc_id", "license", "template", "at", *[f"h{k}" for k in range(size)])

    # Which shingles of the windows retrieved are the template's: exact membership, each place once.
    places = hits.select("doc_id", "license", "template", F.explode(F.array(*[F.struct((F.col("at") + k).alias("place"), F.col(f"h{k}").alias("h")) for k in range(size)])).alias("s"))
    known = table.select("license", "template", "n", F.explode(F.array_distinct("shingles")).alias("h"))
    exact = places.select("doc_id", "license", "template", "s.*").join(small_side(known), ["license", "template", "h"])
    exact = materialise(exact.select("doc_id", "license", "template", "n", "place", "h").distinct(), "licenses")
    order = Window.partitionBy("doc_id", "license", "template").orderBy("place", "h")
    run = exact.withColumn("new", (F.col("place") - F.coalesce(F.lag("place").over(order), F.col("place")) > F.col("n") + SHINGLE - 1).cast("int"))
    run = run.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = run.groupBy("doc_id", "license", "template", "n", "run").agg(F.min("place").alias("start_word"), (F.max("place") + SHINGLE - 1).alias("end_word"), F.count_distinct("h").alias("m"))
    found = found.withColumn("containment", F.round(F.col("m") / F.col("n"), 6)).filter(F.col("m") >= F.col("n") * containment - 1e-9)
    return found.select("doc_id", "license", "template", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "containment")
