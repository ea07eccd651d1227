"""Licences in other words than the templates', wrapped headers and whole licence files."""
import textwrap

from convkit.llm import licences

# usual forms; some are a template in other wrapping, and some resemble lines that the templates were tried on
VARIANTS = [
    ("The code in this repository is MIT-licensed", "MIT"),
    ("## License\n\nMIT License, see LICENSE.md", "MIT"),
    ("released under the terms of the MIT license", "MIT"),
    ("# SPDX-License-Identifier: MIT OR X", "MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"),
    ("<!-- SPDX-License-Identifier: MPL-2.0 -->", "MPL-2.0"),
    ("SPDX-License-Identifier: ISC", "ISC"),
    ("License: Apache License, Version 2.0", "Apache-2.0"),
    ("Apache-2.0 licensed", "Apache-2.0"),
    (" * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except", "Apache-2.0"),
    ("Licensed under the Apache License,\nVersion 2.0", "Apache-2.0"),
    ("All our tools come under the 3-Clause BSD License", "BSD-3-Clause"),
    ("license :: BSD 2-Clause", "BSD-2-Clause"),
    ("Text and images are shared under CC BY 4.0", "CC-BY-4.0"),
    ("Licence notes: CC BY-NC 4.0 license", "CC-BY-NC-4.0"),
    ("Creative Commons Attribution-NonCommercial 4.0 International\n(a summary follows)", "CC-BY-NC-4.0"),
    ("This book is available under the Creative Commons\nAttribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991", "GPL-2.0"),
    ("is free software under the GNU General Public License, version 3", "GPL-3.0"),
    ("# under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or", "GPL-3.0"),
    ("The library is licensed under the GNU Lesser General Public License version 3", "LGPL-3.0"),
    ("AGPLv3 licensed", "AGPL-3.0"),
    ("Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not", "MPL-2.0"),
    ("ISC licensed", "ISC"),
]
CLEAN = [
    "She renewed her fishing license in June.", "The general public may use the source of the river.", "A new version of the project was released.",
    "He studied at MIT and worked on free software.", "Permission is required to copy these forms.", "Clause 3 of the contract is subject to change.",
    "The public library is licensed to sell books.", "GNU is an animal, and so is the gnu.", "An apache is a helicopter.", "MIT", "2.0", "license",
    "CC: all members of the team", "Commons are shared; attribution is a courtesy.", "Terms of use: no warranty is given.",
]


def _found(spark, texts):
    files = spark.createDataFrame([(f"d{i}/x.txt", t) for i, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: r for r in licences.scan(files).collect()}
    return [got[f"d{i}/x.txt"]["licence"] for i in range(len(texts))]


def test_recall_on_variants(spark):
    got = _found(spark, [f"Some words before it.\n{t}\nand some words after it" for t, _ in VARIANTS])
    known = {tuple(licences.words(t)) for _, t in licences.TEMPLATES}
    for some in (VARIANTS, [v for v in VARIANTS if tuple(licences.words(v[0])) not in known]):
        missed = [(t, want, have) for (t, want), have in zip(VARIANTS, got) if want != have and (t, want) in some]
        print(len(some), missed)
        assert len(missed) <= 0.1 * len(some), missed


def test_clean_lines_hold_none(spark):
    assert _found(spark, CLEAN) == [None] * len(CLEAN)


def test_whole_files_reach_their_directory(spark):
    """A licence text with its owner's name, wrapped anew, is a licence file; a long file with a notice isn't."""
    full = dict(licences.FULL)
    text = {k: "\n".join(textwrap.wrap("Copyright (c) 2021 Some Body and others. All rights reserved. " + t, 72)) for k, t in full.items()}
    rows = [(f"{k}/terms.txt", t) for k, t in text.items()] + [(f"{k}/src/code.py", "pass") for k in text]
    rows += [("n/notice.py", "MIT License\n" + "some other words here\n" * 30), ("n/code.py", "pass"),
             ("m/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "a very long text of terms\n" * 90), ("m/a/code.py", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["licence"], r["origin"], r["source"]) for r in licences.scan(files).collect()}
    for k in text:
        assert got[f"{k}/terms.txt"] == (k, "file", f"{k}/terms.txt")
        assert got[f"{k}/src/code.py"] == (k, "directory", f"{k}/terms.txt")
    assert got["n/notice.py"][:2] == ("MIT", "file") and got["n/code.py"] == (None, None, None)
    assert got["m/a/code.py"] == ("GPL-3.0", "directory", "m/COPYING")


def test_bound_loses_no_unit(spark):
    """Every random unit that reaches the threshold passes the bound on its words."""
    import math
    import random
    from collections import Counter

    from pyspark.sql import functions as F
    idf, other, vec = licences.vectors([*licences.TEMPLATES, *licences.FULL])
    rng, rows = random.Random(4), []
    for i in range(3000):
        w = list(vec[rng.randrange(len(licences.TEMPLATES))]) * rng.randrange(1, 3)
        w = rng.sample(w, rng.randrange(1, len(w) + 1)) + rng.choices(["zebra", "piano", "damages", "events", "ox"], k=rng.randrange(9))
        c = Counter(w)
        norm = math.sqrt(sum((n * idf.get(x, other)) ** 2 for x, n in c.items()))
        best = max((sum(c[x] * idf[x] * y for x, y in v.items()) / norm for v in list(vec.values())[:len(licences.TEMPLATES)]
                    if len(set(c) & set(v)) >= licences.SHARED), default=0)
        rows.append((w, best >= licences.COSINE))
    got = spark.createDataFrame(rows, "words array<string>, reached boolean").withColumn(
        "may", licences._may_reach(F.col("words"), licences.TEMPLATES, licences.COSINE))
    assert got.where("reached and not may").count() == 0
    assert got.where("reached").count() > 300 and got.where("not may").count() > 300
