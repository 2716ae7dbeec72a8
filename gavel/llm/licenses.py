"""Licence scans in DataFrame functions alone: sparse TF-IDF cosine to notices, then inheritance along directories.

Every line and sentence of every whole text, wrapped sentences, blocks between blank lines, runs of comment lines and,
for files named like a licence, the whole text are compared with the notices of ``TEMPLATES`` and the notice texts of
``TEXTS``; all words are weighed by their document frequencies, which count every document. A part that reaches the bar
must hold one of a notice's heaviest words, since the rest of the notice is too short a vector to reach it alone; so
only parts with such words are split into terms, without losing a match. What tells licences of one family apart (version
numbers, NC, ND, SA, Lesser, Affero) and a denial must agree exactly, and a sentence must hold its notice's names; a licence
without a notice here matches none. A file's licence is that of its SPDX line, or
else of its best notice text, or else of its best sentence. Files that consist mostly of licence
sentences, or are named like one (LICENSE, COPYING), license their directory, and a file without a licence of its own
takes that of its nearest ancestor directory: the different directories are joined with their ancestors, then files with
their directories. Only paths, not texts, take part in the joins, and a directory's files are never gathered.

Defined results: a null, empty or unlicensed text has a null licence unless it inherits one; rows with equal paths are
one file, with the best evidence among them; ties go to the greater score, then the greater name; an SPDX expression is
taken as it stands, less "-only", "-or-later" and "+" after a GNU version; missing parts of a
path read "-"; texts of any length are read whole; an empty table gives none; further columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import literal_rows, saved, table

# Public notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    *((f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.") for version in ("3.0", "4.0")
      for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published "
        "by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
# Whole public notice texts and file headers.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
            "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
            "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
            "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
            "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
                   "or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", _GNU.format("Lesser ", 2.1)), ("GPL-3.0", _GNU.format("", 3)), ("GPL-2.0", _GNU.format("", 2)), ("LGPL-3.0", _GNU.format("Lesser ", 3)), ("AGPL-3.0", _GNU.format("Affero ", 3)),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                                 "derived from this software without specific prior written permission. ")),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Terms that tell licences of a family apart, or deny one: a sentence has just those of its notice. Of these, what a notice
#: text (whose numbers and negations come in many forms) has to share.
MARKS = ["nc", "nd", "sa", "lesser", "library", "affero", "not", "never", "no", *map(str, range(10))]
KINDS = ["nc", "nd", "sa", "lesser", "library", "affero"]
#: Names that a sentence must hold if its notice does.
NAMES = ["license", "mit", "apache", "gnu", "bsd", "mozilla", "cc", "by", "file", "software"]
#: Cosine from which a sentence holds a notice.
BAR = 0.7
#: Share of a file's words in licence sentences from which it licenses its directory.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)copying[^/]*$"
SENTENCE = r"(?<=[.!?])\s+|\n+"
#: Where sentences over several lines end, and blocks of lines.
WRAPPED, BLOCK = r"(?<=[.!?])\s+|\n[^\p{L}\p{N}\n]*\n", r"\n[ \t\r]*\n|\*/|-->"
_MARK = r"[ \t]*(?:/?\*|//|#|--|;|%)"
#: Before a line that is no comment, and such a line at the start.
NO_COMMENT, CODE_LINE = rf"\n(?!{_MARK})", rf"^(?!{_MARK})[^\n]*\n?"
_NAME = r"\(?[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?\)?"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_NAME}(?:[ \t]+(?:or|and|with)[ \t]+{_NAME})*)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def frequencies(texts: DataFrame, text: str) -> DataFrame:
    """(term, df) of every word: the documents that hold it."""
    terms = texts.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z0-9]+"))).alias("term"))
    return terms.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def lists(templates: list) -> list:
    return [(name, re.findall("[a-z0-9]+", notice.lower()), whole) for name, notice, whole in templates]


def model(frequency: DataFrame, n: int, templates: list, bar: float = BAR) -> dict:
    """The unit vectors of notices (license, text, whole), and the words without one of which no part reaches the bar."""
    known = lists(templates)
    vocabulary = sorted({w for _, ws, _ in known for w in ws})
    df = {r.term: r.df for r in frequency.where(F.col("term").isin(vocabulary)).collect()}  # a row for each word of the notices
    idf = {w: math.log((2 + n) / (1 + df.get(w, 0))) for w in vocabulary}
    vectors, anchors = [], set()
    rules = []
    for number, (name, ws, whole) in enumerate(known):
        tell = KINDS if whole else MARKS
        rules.append((number, sorted(set(ws) & set(tell)), sorted(set() if whole else set(ws) & set(NAMES))))
        vector = {w: ws.count(w) * idf[w] for w in set(ws)}
        size = math.sqrt(sum(x * x for x in vector.values()))
        left = 1.0
        for w, x in sorted(vector.items(), key=lambda t: (-t[1], t[0])):
            vectors.append((number, name, whole, w, x / size))
            if left >= bar * bar - 1e-9:
                anchors.add(w)
                left -= (x / size) ** 2
    return {"vectors": vectors, "anchors": sorted(anchors), "rules": rules}


def notices(files: DataFrame, text: str = "text", templates=TEMPLATES, bar: float = BAR, texts=TEXTS) -> DataFrame:
    """(path, license, score, share): the best notice of each path that has one, and the share of its words in notices."""
    spark = files.sparkSession
    n = files.count()
    every = [(*x, 0) for x in templates] + [(*x, 1) for x in texts]
    frequency = saved(frequencies(files, text))
    known = model(frequency, n, every, bar)
    rare = F.array(*map(F.lit, known["anchors"]))

    def hopeful(col):
        return F.arrays_overlap(F.split(F.lower(F.col(col)), "[^a-z0-9]+"), rare)
    vectors = literal_rows(spark, known["vectors"], "number int, license string, whole int, term string, weight double")
    comments = F.transform(F.split(text, NO_COMMENT), lambda x: F.regexp_replace(x, CODE_LINE, ""))
    kinds = [F.split(text, SENTENCE), F.split(text, WRAPPED), F.split(text, BLOCK), comments,
             F.when(F.col("path").rlike(FILE_NAME), F.array(text)).otherwise(F.array().cast("array<string>"))]
    rows = files.where(hopeful(text) | F.col(text).rlike(SPDX)).select(
        "path", text, F.monotonically_increasing_id().alias("row"), F.size(words(F.col(text))).alias("n_words"))
    rows = saved(rows)  # from here on a row's number is fixed
    parts = rows.select("row", F.posexplode(F.array(*kinds)).alias("kind", "own")).select("row", "kind", F.posexplode("own").alias("pos", "part"))
    at = ["row", "kind", "pos"]
    terms = parts.where(hopeful("part")).select(*at, F.explode(words(F.col("part"))).alias("term")).groupBy(*at, "term").agg(F.count("*").alias("tf"))
    terms = saved(terms)
    # The words of the parts at hand are few beside those of all documents: cut to them first, frequencies stay small.
    frequency = saved(frequency.join(saved(terms.select("term").distinct()), "term", "left_semi"))
    idf = F.log((2 + F.lit(n)) / (1 + F.col("df")))
    terms = saved(terms.join(frequency, "term").select(*at, "term", (F.col("tf") * idf).alias("w"), "tf"))

    def own(names):
        return F.array_sort(F.collect_set(F.when(F.col("term").isin(names), F.col("term"))))
    size = terms.groupBy(*at).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.sum("tf").alias("n"), own(MARKS).alias("marks"), own(NAMES).alias("names"))
    dots = terms.join(F.broadcast(vectors), "term").groupBy(*at, "number", "license", "whole").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.join(size, at).withColumn("score", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("score") >= bar)
    rules = literal_rows(spark, known["rules"], "number int, tells array<string>, needs array<string>")
    best = best.join(F.broadcast(rules), "number")
    kinds_ = F.array_intersect("marks", F.array(*map(F.lit, KINDS)))
    best = best.where((F.when(F.col("whole") == 1, kinds_).otherwise(F.col("marks")) == F.col("tells")) & (F.size(F.array_except("needs", "names")) == 0))
    best = best.groupBy(*at).agg(F.max(F.struct("whole", "score", "license")).alias("best"), F.max("n").alias("n"))
    best = best.groupBy("row", "kind").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    named = F.regexp_replace(F.regexp_extract(text, SPDX, 1), r"(?i)(GPL-[0-9.]+)(?:-only|-or-later|\+)", "$1")
    named = F.struct(F.lit(2).alias("whole"), F.lit(1.0).alias("score"), named.alias("license"))
    spdx = rows.where(F.col(text).rlike(SPDX)).select("row", F.lit(-1).alias("kind"), named.alias("best"),
                                                      F.size(words(F.regexp_extract(text, SPDX, 0))).cast("long").alias("n"))
    found = best.unionByName(spdx).groupBy("row").agg(F.max("best").alias("best"), F.max("n").alias("n"))
    return found.join(rows.select("row", "path", "n_words"), "row").groupBy("path").agg(
        F.max("best").alias("best"), F.max(F.col("n") / F.col("n_words")).alias("share")).select(
        "path", F.col("best.license").alias("license"), F.col("best.score").alias("score"), "share")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, license, licensed_by) of every directory that has a licence or a nearest ancestor with one."""
    own = licensed.groupBy("dir").agg(F.max(F.struct("score", "license")).alias("best"))
    steps = F.split(F.col("dir"), "/")
    up = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("above")))).alias("x")).select("dir", "x.depth", "x.above")
    found = up.join(own.select(F.col("dir").alias("above"), "best"), "above")
    nearest = found.groupBy("dir").agg(F.max(F.struct("depth", "best", "above")).alias("n"))
    return nearest.select("dir", F.col("n.best.license").alias("license"), F.col("n.above").alias("licensed_by"))


def scan(files: DataFrame, text: str = "text", templates=TEMPLATES, bar: float = BAR, file_share: float = FILE_SHARE) -> DataFrame:
    """(path, license, evidence, score, licensed_by) of every different path of ``files`` (path, text); evidence is
    "own", "inherited" or null."""
    found = saved(notices(files, text, templates, bar))
    licensed = found.where((F.col("share") >= file_share) | F.col("path").rlike(FILE_NAME)).withColumn("dir", directory(F.col("path")))
    paths = files.select("path").distinct().withColumn("dir", directory(F.col("path")))
    # Directories are far fewer than files; with their size known the optimizer copies them to all tasks if they are few.
    above = saved(inherited(paths.select("dir").distinct(), licensed).withColumnRenamed("license", "above"))
    out = paths.join(found.drop("share"), "path", "left").join(above, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select("path", F.coalesce("license", "above").alias("license"),
                      F.when(own, F.lit("own")).when(F.col("above").isNotNull(), F.lit("inherited")).alias("evidence"),
                      "score", F.when(~own, F.col("licensed_by")).alias("licensed_by"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Documents as files of their source's and language's directory."""
    docs = table(spark, sf_dir, "documents")
    part = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("source", "lang", "doc_id")]
    paths = scan(docs.select(F.concat(F.lit("/"), F.concat_ws("/", *part)).alias("path"), "text"))
    return paths.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).try_cast("long"))
