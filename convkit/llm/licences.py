"""Licence scan, native: sparse TF-IDF cosine of headers and licence files to
templates, then inheritance along directories.

A licence has several templates: its names in usual sentences, its SPDX line,
the sentences of its header or text. Every text is cut into segments (lines, and
sentences of a line); a unit is a segment or up to ``WINDOW`` of them in a row,
so a notice wrapped over lines is one unit too. A unit is a vector of word counts
times idf, idf over the licences; words outside the templates weigh ``OTHER`` and
stop words nothing. A unit holds a licence if its cosine to a template is at least
``COSINE`` and they share two words or more. Only units with an anchor word are
scored: a template's anchors are its heaviest words, common ones last, as many as
it takes that the rest can't reach ``COSINE`` (Cauchy-Schwarz); and of those the
ones whose foreign words leave room for it. Both filters lose nothing.

A file with such a unit is also scored whole, against the templates and the full
texts, at the same threshold; the whole file's licence goes before its best
unit's. It is a licence file of its directory if it is one as a whole, if half of
its words lie in segments that hold a licence by themselves, or by its name
(LICENSE, COPYING, ...). Files without an own licence inherit from the nearest
directory above them that has one. Directories are resolved once each, by an
equi-join of directories and their ancestors with the licence files' directories,
and the answers go back to the files through a salted join, since one directory
may hold a third of all files. Texts are read once: the units are written, and
everything else reads those or paths alone.

Defined results: null and empty texts hold no licence and can still inherit;
a null path is the empty path, a file in the root directory; rows with equal
paths are one file, and each gets its result; of equal cosines the earlier, then
shorter unit wins, then the lesser licence id, and of several licence files in a
directory the higher cosine, then the lesser path; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convkit.llm.stages import drop, written

# Licence ids and the names that they go by.
NAMES = [
    ("AGPL-3.0", ["GNU Affero General Public License, version 3", "AGPLv3"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache 2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License"]),
    ("CC-BY-4.0", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    ("CC-BY-NC-4.0", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    ("CC-BY-SA-4.0", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    ("GPL-2.0", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"]),
    ("GPL-3.0", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"]),
    ("ISC", ["ISC License"]),
    ("LGPL-2.1", ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"]),
    ("LGPL-3.0", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3"]),
    ("MIT", ["MIT License"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "MPL 2.0"]),
]
# The sentences that name a licence.
FORMS = ["{}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This work is licensed under the {}",
         "This project is licensed under the terms of the {}"]
# Header lines, and sentences that licence texts begin with.
HEADERS = [
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any"),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. {}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Licence texts as a whole, for whole files only.
FULL = [
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                                 "products derived from this software without specific prior written permission.")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
]
TEMPLATES = ([(k, f.format(n)) for k, names in NAMES for n in names for f in FORMS]
             + [(k, f"SPDX-License-Identifier: {k}") for k, _ in NAMES] + HEADERS)
# Stop words, which weigh nothing in a vector.
STOP = ["0", "a", "an", "and", "any", "are", "as", "at", "be", "by", "either", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
        "this", "to", "under", "use", "was", "with", "without"]
# Words of any text, which weigh less and are anchors only where nothing else is left, the most usual last.
COMMON = ["redistribution", "permitted", "foundation", "published", "subject", "modify", "granted", "forms", "binary", "distribute", "distributed",
          "released", "terms", "license", "licensed", "charge", "software", "source", "copy", "permission", "form", "code", "project",
          "general", "public", "version", "free", "person", "work", "new", "january", "june", "v", "www", "http", "org", "29", "1991", "2004", "2007",
          "obtaining", "purpose", "clause", "4", "3", "2", "1"]
COSINE = 0.75
OTHER = 1.75        # weight of a word that no template has
USUAL = 0.5         # factor of the weight of a common word
SHARED = 2          # words that a unit and its template share at least
WINDOW = 4          # segments in a row that make a unit, at most
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|unlicense)(\.[^/.]*)?$"
SALT = 32


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w and w not in STOP]


def _words(text):
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP))


def vectors(templates=TEMPLATES) -> tuple[dict[str, float], float, dict[int, dict[str, float]]]:
    """idf by word over licences, the weight of any other word, and the unit vector of each template by its place."""
    df = Counter(w for w, _ in {(w, k) for k, t in templates for w in words(t)})
    n = len({k for k, _ in templates})
    idf = {w: (math.log((1 + n) / (1 + d)) + 1) * (USUAL if w in COMMON else 1) for w, d in df.items()}
    out = {}
    for i, (_, t) in enumerate(templates):
        c = Counter(words(t))
        norm = math.sqrt(sum((m * idf[w]) ** 2 for w, m in c.items())) or 1.0
        out[i] = {w: m * idf[w] / norm for w, m in c.items()}
    return idf, OTHER, out


def anchors(templates=TEMPLATES, least: float = COSINE) -> list[str]:
    """Words of which every unit that reaches ``least`` has one."""
    found, rank = set(), {w: i for i, w in enumerate(COMMON)}
    for v in vectors(templates)[2].values():
        rest = sum(x * x for x in v.values())
        for w, x in sorted(v.items(), key=lambda p: (rank.get(p[0], -1), -p[1], p[0])):
            if math.sqrt(max(rest, 0)) < least:
                break
            found.add(w)
            rest -= x * x
    return sorted(found)


def _may_reach(words, templates, least: float):
    """False only for words that can't reach ``least``: the squared weight of the
    known ones is at most that of as many of the heaviest word, the other ones
    weigh as so many distinct ones of the lightest, and the former's share is the
    most that a squared cosine can be."""
    idf, other, vec = vectors([*templates, *FULL])
    known = sorted({w for i in range(len(templates)) for w in vec[i]})
    heavy, light = max(idf[w] for w in known), min([other, *(x for w, x in idf.items() if w not in set(known))])
    mine = F.filter(words, lambda w: w.isin(*known))
    rest = F.size(F.array_distinct(words)) - F.size(F.array_distinct(mine))
    most = F.size(mine) * (F.size(mine) - F.size(F.array_distinct(mine)) + 1)       # sum of squared counts
    return (F.size(F.array_distinct(mine)) >= SHARED) & (rest * (least * light) ** 2 <= most * ((1 - least ** 2) * heavy ** 2) + 1e-6)


def units(files: DataFrame, templates=TEMPLATES, least: float = COSINE) -> DataFrame:
    """(path, unit, words, whole) of the windows with an anchor word that may
    reach ``least``, by the place of their first segment and their length; one
    row of each file carries the words of its whole text. All of it happens
    where a text is read."""
    has = f"(?<![a-z0-9])({'|'.join(anchors(templates, least))})(?![a-z0-9])"
    low = files.select("path", F.lower("text").alias("low")).where(F.col("low").rlike(has))
    # the segments beside each one, null beyond the end
    near = low.select("path", "low", F.split("low", r"\n|(?<=[.!?;])[ \t]").alias("l")).select(
        "path", "low", F.arrays_zip(*[F.slice("l", k + 1, F.size("l")).alias(f"s{k}") for k in range(WINDOW)]).alias("s"))

    def windows(k):
        line = lambda x: F.when(x[f"s{k}"].isNotNull(), F.concat_ws(" ", *[x[f"s{j}"] for j in range(k + 1)]))
        return F.transform("s", lambda x, i: F.struct((i * WINDOW + k).cast("int").alias("unit"), line(x).alias("line")))

    found = F.filter(F.concat(*[windows(k) for k in range(WINDOW)]), lambda x: x["line"].rlike(has))
    found = F.transform(found, lambda x: F.struct(x["unit"].alias("unit"), _words(x["line"]).alias("words")))
    found = F.filter(found, lambda x: _may_reach(x["words"], templates, least))
    # outer: the array isn't built twice, to see first whether it is empty
    one = near.select("path", "low", F.posexplode_outer(found).alias("i", "u")).where(F.col("u").isNotNull())
    return one.select("path", "u.unit", "u.words", F.when(F.col("i") == 0, _words("low")).alias("whole"))


def scored_units(u: DataFrame, whole: bool = False, templates=TEMPLATES, least: float = COSINE) -> DataFrame:
    """(path, unit, n, licence, cosine) of every unit that holds a licence: its
    best one. Whole files also meet the full texts."""
    spark = u.sparkSession
    some = [*templates, *FULL]
    idf, other, vec = vectors(some)
    # the templates' vocabulary, a fixed list
    vocabulary = spark.createDataFrame([(w, float(x)) for w, x in sorted(idf.items())], "word string, idf double")
    last = len(some) if whole else len(templates)
    weights = spark.createDataFrame([(w, i, some[i][0], float(x)) for i, v in vec.items() if i < last for w, x in sorted(v.items())],
                                    "word string, template int, licence string, weight double")
    tf = (u.select("path", "unit", F.size("words").alias("n"), F.explode("words").alias("word"))
           .groupBy("path", "unit", "n", "word").agg(F.count("*").alias("tf")))
    tf = tf.join(vocabulary, "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = tf.groupBy("path", "unit", "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = (tf.join(weights, "word").groupBy("path", "unit", "template", "licence")
             .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.count("*").alias("shared")).where(F.col("shared") >= SHARED))
    hit = (dot.join(norm, ["path", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= least))
    return (hit.groupBy("path", "unit", "n").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"))
               .select("path", "unit", "n", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine")))


def directory(path):
    """Directory of a path, without a slash at its end; the root is ''."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def scan(files: DataFrame, templates=TEMPLATES, least: float = COSINE, share: float = FILE_SHARE) -> DataFrame:
    """One row per distinct path: path, licence, cosine, origin (``file`` for
    its own, ``directory`` for an inherited one, else null) and source (the
    path of the file that states it)."""
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    u = written(units(files, templates, least), "licence-units")
    hit = written(scored_units(u.select("path", "unit", "words").distinct(), templates=templates, least=least), "licence-hits")
    best = hit.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "unit", "licence")).alias("best"),
                                   F.sum(F.when(F.col("unit") % WINDOW == 0, F.col("n"))).alias("licence_words"))
    full = u.where("whole is not null").join(best.select("path"), "path", "left_semi").select("path", F.lit(-1).alias("unit"), F.col("whole").alias("words")).distinct()
    size = full.groupBy("path").agg(F.min(F.size("words")).alias("n_words"))
    full = scored_units(full, True, templates, least).groupBy("path").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("whole"))
    own = best.join(size, "path").join(full, "path", "left").select(
        "path", F.coalesce("whole.licence", "best.licence").alias("licence"), (-F.coalesce("whole.c", "best.c")).alias("cosine"),
        (F.col("whole").isNotNull() | F.col("path").rlike(FILE_NAME)
         | (F.coalesce("licence_words", F.lit(0)) >= share * F.col("n_words"))).alias("stated"))
    own = written(own, "licence-own")
    drop(u)
    drop(hit)
    stated, own = own.where("stated"), own.drop("stated")
    by_dir = (stated.withColumn("dir", directory("path")).groupBy("dir")
                    .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("best"))
                    .select(F.col("dir").alias("up"), F.col("best.licence").alias("up_licence"), (-F.col("best.c")).alias("up_cosine"),
                            F.col("best.path").alias("up_source")))
    paths = files.groupBy("path").agg(F.lit(1).alias("one")).drop("one").withColumn("dir", directory("path"))
    # each distinct directory finds its nearest ancestor (or itself) with a licence file
    depth = F.size(F.split("dir", "/"))
    dirs = paths.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), depth)))
    dirs = dirs.withColumn("up", F.expr("substring_index(dir, '/', depth)"))
    nearest = (dirs.join(by_dir, "up").groupBy("dir")
                   .agg(F.max_by(F.struct("up_licence", "up_cosine", "up_source"), "depth").alias("up")))
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int"))
    rows = rows.join(salted, ["dir", "salt"], "left").join(own, "path", "left")
    mine = F.col("licence").isNotNull()
    return rows.select("path", F.coalesce("licence", "up.up_licence").alias("licence"),
                       F.when(mine, F.col("cosine")).otherwise(F.col("up.up_cosine")).alias("cosine"),
                       F.when(mine, "file").when(F.col("up").isNotNull(), "directory").alias("origin"),
                       F.when(mine, F.col("path")).otherwise(F.col("up.up_source")).alias("source"))
