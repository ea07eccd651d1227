"""URL rules, rule ledger and licences against plain Python."""
import math
import random
import re
from collections import Counter

import pytest

from convkit.llm import catalog, licences, rule_ledger, url_rules
from llm_edge import EDGE, frame, sentence  # noqa: F401


def _judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(1)
    rules = catalog.URL_RULES + [("a.b.example.org", "/x/yz", "block"), ("org", "/x/", "allow"), ("net", "/es/", "block")]
    hosts = ["example.com", "WWW.Example.com", "a.b.example.org", "net", "x.net", "com", "", "notexample.com", "a.b.c.d.e.f.g.net", "é.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/x/yz1", "/x/y", "/es//a", "/fr/b/c/d", "//en/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{rng.choice(['', '?q=/es/', '#/fr/'])}" for h in hosts for p in paths]
    urls += [None, "", "no scheme/en/", "http:/x.net/es/", "a://b://c.com/", "http://x.net/" + "fr/" * 3000, "http://" + "a." * 2000 + "net/fr/", "http://x.net/es/\nq"] + urls[:5]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, frame).collect()}
    assert got == {i: _judge(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, frame.limit(0)).collect()} == {"allow"}
    both = spark.createDataFrame([("net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block"), ("net", None, "block")], frame.schema)
    assert {r["verdict"] for r in url_rules.judge(pages, both).where("path like '/es/%' and host like '%net'").collect()} == {"block"}


def _measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(w, w[1:], w[2:]))
    at = {p + k for p in range(len(w) - 2) if tri[tuple(w[p:p + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at)


def test_measurements(spark, frame):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\t#\u00a0é") for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(40)] + ["x\r\nx\r\n x\r", "a b c a b c", "a b c d a b c"]
    rows = EDGE + list(enumerate(texts, 100))
    got = rule_ledger.ledger(frame(rows)).collect()
    assert sorted(map(str, [(r["doc_id"], *[r[m] for m in rule_ledger.MEASURES]) for r in got])) == sorted(
        map(str, [(i, *_measure(t)) for i, t in rows]))
    assert rule_ledger.ledger(frame([])).count() == 0


def test_policies_and_ablations(spark, frame, sentence):
    rows = [(1, sentence(60)), (2, sentence(10)), (3, "a b c " * 40), (4, (sentence(60) + " ").replace(" ", "# ")), (5, None)]
    led = rule_ledger.ledger(frame(rows))
    failed = {r["doc_id"]: r["failed"] for r in led.collect()}
    assert failed[1] == 0 and failed[2] == rule_ledger.bit("few_words") and failed[3] & rule_ledger.bit("repeated_words")
    assert failed[4] == rule_ledger.bit("many_symbols") and failed[5] == rule_ledger.bit("few_words")
    got = {(r["policy"], r["rule"]): (r["kept"], r["kept_without"], r["failing"]) for r in rule_ledger.ablations(led).collect()}
    for p, rules in rule_ledger.POLICIES.items():
        m = rule_ledger.mask(p)
        for r in rules:
            b = rule_ledger.bit(r)
            assert got[p, r] == (sum(f & m == 0 for f in failed.values()), sum(f & (m & ~b) == 0 for f in failed.values()),
                                 sum(f & b != 0 for f in failed.values()))
    assert all(r["kept"] == 0 for r in rule_ledger.ablations(rule_ledger.ledger(frame([]))).collect())


def _cosines(line):
    idf, other, vec = licences.vectors()
    c = Counter(licences.words(line))
    norm = math.sqrt(sum((n * idf.get(w, other)) ** 2 for w, n in c.items()))
    return {k: sum(c[w] * idf[w] * x for w, x in v.items()) / norm if norm else 0 for k, v in vec.items()}


def test_anchors_lose_nothing():
    a = set(licences.anchors())
    rng = random.Random(1)
    vocab = sorted({w for _, t in licences.TEMPLATES for w in licences.words(t)}) + ["zebra", "piano"]
    for _ in range(3000):
        line = " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 9)))
        if max(_cosines(line).values()) >= licences.COSINE:
            assert a & set(line.split())


@pytest.mark.parametrize("line,want", [("Released under the MIT License.", "MIT"), ("* Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
                                       ("released a new license plate model under budget", None),
                                       ("This is free. Licensed under the Apache License, Version 2.0.", "Apache-2.0")])
def test_units(spark, line, want):
    files = spark.createDataFrame([("a/b.txt", "first line\n" + line + "\nlast")], "path string, text string")
    assert [r["licence"] for r in licences.scan(files).collect()] == [want]


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", mit), ("x.py", "code"), ("a/y.py", "code"), ("a/b/LICENSE", gpl), ("a/b/c/z.py", None), ("a/b/own.py", mit + "\n" + "word " * 50),
            ("ab/q.py", ""), ("a/b/LICENSE", gpl), (None, "x")]
    got = {r["path"]: (r["licence"], r["origin"], r["source"]) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"LICENSE": ("MIT", "file", "LICENSE"), "x.py": ("MIT", "directory", "LICENSE"), "a/y.py": ("MIT", "directory", "LICENSE"),
                   "a/b/LICENSE": ("GPL-3.0", "file", "a/b/LICENSE"), "a/b/c/z.py": ("GPL-3.0", "directory", "a/b/LICENSE"),
                   "a/b/own.py": ("MIT", "file", "a/b/own.py"), "ab/q.py": ("MIT", "directory", "LICENSE"), "": ("MIT", "directory", "LICENSE")}
    none = licences.scan(spark.createDataFrame([("a/x", "y")], "path string, text string")).collect()
    assert [(r["licence"], r["origin"]) for r in none] == [(None, None)]
    assert licences.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_edge_rows(spark, frame):
    files = frame(EDGE).selectExpr("cast(doc_id as string) as path", "text", "score", "doc_id as licence")
    assert {r["path"] for r in licences.scan(files).collect()} == {"", *"12345678"}
