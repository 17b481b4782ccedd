"""Licence scan by Dice coefficient over word bigrams.

Lines of a text, and its paragraphs of several lines, are compared to licence templates as sets of
word bigrams. A coefficient of at least ``t`` needs sets whose sizes differ by a factor of at most
``(2 - t) / t``, so only templates within these bounds are candidates. Bigrams of a unit meet those
of the templates in a hash join with the bounds as condition; the templates are a parameter, so
the size of that table is known. Rows are shuffled only where bigrams are common.

Whole licences, and notices that are wrapped or stand within longer lines, are found as runs: the
stretches of a text's words in which bigrams of a template follow one another with at most ``GAP``
others between, from the first to the last of them, wherever lines end. A run and a template are
compared as bags of bigrams, so that a run's size is its length; the same bounds leave out runs
before they are scored. A run starts only where a bigram of a template occurs, and only such
bigrams become rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICE = 0.8
#: Bigrams of no template that a run may hold in a row.
GAP = 10

#: Notices as their licences give them, and whole texts, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
        "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
        "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by "
        "any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We "
        "make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def _once(**columns: Column) -> Column:
    """Columns of one row by a generator, which Spark does not merge into later expressions: each is
    computed once."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))


def all_bigrams(own: Column, only: Sequence[str] | None = None) -> Column:
    """The pairs of neighbouring words in their order, with a space between; with ``only`` null for
    those that begin with another word."""
    n = F.size(own)

    def pair(a: Column, b: Column) -> Column:
        both = F.concat(a, F.lit(" "), b)
        return both if only is None else F.when(a.isin(*only), both)

    return F.zip_with(
        F.slice(own, 1, F.greatest(n - 1, F.lit(0))), F.slice(own, 2, F.greatest(n - 1, F.lit(0))), pair
    )


def bigrams(own: Column) -> Column:
    """The distinct ones."""
    return F.array_distinct(all_bigrams(own))


def _units(text: Column) -> Column:
    """The words of lines, and of paragraphs (between empty lines) of more than one line."""

    def of(kind: str, parts: Column) -> Column:
        return F.transform(
            parts, lambda x, i: F.struct(
                F.lit(kind).alias("unit"), (i + 1).alias("number"), words(x).alias("w")
            )
        )

    # A paragraph of one line has been looked at as such.
    paragraphs = F.transform(
        F.split(text, r"\n[ \t\r]*\n"),
        lambda x: F.when(F.contains(F.trim(x), F.lit("\n")), x).otherwise(F.lit("")),
    )
    return F.concat(of("line", F.split(text, "\n")), of("paragraph", paragraphs))


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = DICE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, unit, number, license, common, dice)``: each line or paragraph (numbered from 1), and
    each run (by the number of its first word), with the licence whose template it resembles most,
    among equals the first by name. ``common`` counts the bigrams shared, in runs as often as both
    have them. Runs of different templates may overlap; those that start at the same word are one.

    Missing and empty texts, and units of fewer than two words, resemble nothing. Repeated rows and
    rows without an id give their own results. Other columns are not looked at. A template of
    fewer than two words, or none at all, matches nothing.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template int, license string, text string",
    )
    sets = given.select("template", "license", bigrams(words(F.col("text"))).alias("b")).select(
        "template",
        "license",
        F.size("b").alias("tsize"),
        F.ceil(F.size("b") * dice / (2 - dice) - 1e-9).alias("low"),
        F.floor(F.size("b") * (2 - dice) / dice + 1e-9).alias("high"),
        F.explode("b").alias("bigram"),
    )
    bounds = sets.select("low", "high").distinct().collect()
    if not bounds:
        bounds = [(1, 0)]
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.col(text_col).alias("text"),
    )
    units = named.select("doc_id", "row", F.inline(_units(F.col("text"))))
    own = units.where(F.size("w") > min(b[0] for b in bounds))
    own = own.select("doc_id", "row", "unit", "number", _once(b=bigrams(F.col("w"))))
    size = F.size("b")
    fits = reduce(lambda a, b: a | b, (size.between(low, high) for low, high in bounds))
    own = own.where(fits).select(
        "doc_id", "row", "unit", "number", size.alias("size"), F.explode("b").alias("bigram")
    )
    # The templates are a parameter: their bigrams are as many as the caller gave.
    common = (
        own.join(F.broadcast(sets), "bigram")
        .where("size between low and high")
        .groupBy("row", "unit", "number", "template", "license")
        .agg(
            F.count("*").alias("common"),
            F.first("doc_id").alias("doc_id"),
            (2.0 * F.count("*") / (F.first("size") + F.first("tsize"))).alias("dice"),
        )
        .where(F.col("dice") >= dice)
    )
    best = common.groupBy("row", "unit", "number").agg(
        F.min_by(
            F.struct("doc_id", "license", "common", "dice"),
            F.struct(-F.col("dice"), "license", "template"),
        ).alias("best")
    )
    found = best.select(
        "best.doc_id", "unit", F.col("number").cast("long").alias("number"), "best.license",
        "best.common", "best.dice",
    )
    return found.unionByName(_runs(named, given, dice))


def _runs(docs: DataFrame, given: DataFrame, dice: float) -> DataFrame:
    """The runs of ``docs`` (``doc_id``, ``row``, ``text``) that resemble a template."""
    pairs = given.select("template", "license", all_bigrams(words(F.col("text"))).alias("p"))
    bags = (
        pairs.select("template", "license", F.size("p").alias("tsize"), F.explode("p").alias("bigram"))
        .groupBy("template", "license", "tsize", "bigram")
        .agg(F.count("*").alias("often"))
    )
    known = [r[0] for r in bags.select("bigram").distinct().collect()]  # of the caller's templates
    if not known:
        known = [""]
    begins = sorted({b.split(" ")[0] for b in known})
    # Words that begin no bigram of a template are passed over without making theirs.
    likely = all_bigrams(words(F.col("text")), only=begins)
    placed = F.transform(
        likely, lambda b, i: F.when(b.isin(known), F.struct(b.alias("bigram"), i.alias("at")))
    )
    hits = docs.select(
        "doc_id", "row", F.inline(F.filter(placed, lambda x: x.isNotNull()))
    ).join(F.broadcast(bags), "bigram")
    along = Window.partitionBy("row", "template").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(along) > GAP + 1, F.lit(True))
    hits = hits.withColumn("starts", apart.cast("int")).withColumn("run", F.sum("starts").over(along))
    keys = ["row", "template", "license", "tsize", "run"]
    shared = hits.groupBy(*keys, "bigram", "often").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"),
        F.first("doc_id").alias("doc_id"),
    )
    runs = shared.groupBy(*keys).agg(
        F.sum(F.least("n", "often")).alias("common"), F.min("first").alias("first"),
        F.max("last").alias("last"), F.first("doc_id").alias("doc_id"),
    )
    size = F.col("last") - F.col("first") + 1
    low, high = F.col("tsize") * dice / (2 - dice) - 1e-9, F.col("tsize") * (2 - dice) / dice + 1e-9
    scored = runs.where(size.between(low, high)).withColumn(
        "dice", 2.0 * F.col("common") / (size + F.col("tsize"))
    ).where(F.col("dice") >= dice)
    best = scored.groupBy("row", "first").agg(
        F.min_by(
            F.struct("doc_id", "license", "common", "dice"),
            F.struct(-F.col("dice"), "license", "template"),
        ).alias("best")
    )
    return best.select(
        "best.doc_id", F.lit("run").alias("unit"), (F.col("first") + 1).cast("long").alias("number"),
        "best.license", "best.common", "best.dice",
    )
