"""DuckDB oracle for the metric queries."""

from __future__ import annotations

import math

from convkit.plans import sqlfrag as S
from convkit.sources.adapters import SQL as A

NIST_BETA = math.log(0.5) / math.log(1.5) ** 2


def _ngrams(src: str, keys: str, text: str, count: str) -> str:
    return f"""SELECT {keys}, n, array_to_string(ws[i:i + n - 1], ' ') AS g, count(*) AS {count}
               FROM (SELECT {keys}, {S.words(text)} AS ws FROM {src}) c, (SELECT unnest([1, 2, 3, 4]) AS n) k,
                    LATERAL (SELECT unnest(range(1, len(c.ws) - k.n + 2)) AS i) GROUP BY ALL"""


def base(n_refs: int = 6, vshuman: int = 1, clean: bool = True) -> list[tuple[str, str]]:
    L = "len(refs)"
    idx = f"CASE WHEN i % {L} = {vshuman} THEN (i % {L} + 1) % {L} ELSE i % {L} END"
    hyp = S.eval_clean("hyp") if clean else "hyp"
    ref = S.eval_clean("ref0") if clean else "ref0"
    return [
        ("hyps", A["hypotheses"]),
        ("refs", A["references"]),
        ("h", f"SELECT system, key, {hyp} AS hyp FROM hyps WHERE key IN (SELECT key FROM refs)"),
        ("lines0", f"""SELECT key, CAST(i AS INTEGER) AS ri, refs[{idx} + 1] AS item
                       FROM refs, (SELECT unnest(range(0, {n_refs})) AS i) t
                       WHERE key IN (SELECT key FROM hyps)"""),
        ("lines1", "SELECT key, ri, CASE WHEN strpos(item, '|') > 0 THEN split_part(item, '|', 2) ELSE item END AS ref0 "
                   "FROM lines0"),
        ("lines", f"SELECT key, ri, {ref} AS ref FROM lines1"),
        ("hng", _ngrams("h", "system, key", "hyp", "hc")),
        ("rng", _ngrams("lines", "key, ri", "ref", "tf")),
        ("rmax", "SELECT key, n, g, max(tf) AS rmax FROM rng GROUP BY ALL"),
    ]


def bleu_ctes() -> list[tuple[str, str]]:
    return [
        ("corr", """SELECT system, key, n, sum(least(hc, coalesce(rmax, 0))) AS c
                    FROM hng LEFT JOIN rmax USING (key, n, g) GROUP BY ALL"""),
        ("seg", f"SELECT system, key, len({S.words('hyp')}) AS testlen FROM h"),
        ("rl", f"SELECT key, ri, len({S.words('ref')}) AS l FROM lines"),
        ("closest", """SELECT s.system, s.key, s.testlen, arg_min(r.l, abs(r.l - s.testlen) * 1000000 + r.l) AS reflen
                       FROM seg s JOIN rl r USING (key) GROUP BY ALL"""),
        ("stats", "SELECT c.*, " + ", ".join(
            f"greatest(testlen - {k} + 1, 0) AS guess{k}, "
            f"coalesce((SELECT x.c FROM corr x WHERE x.system = c.system AND x.key = c.key AND x.n = {k}), 0) AS correct{k}"
            for k in range(1, 5)) + " FROM closest c"),
    ]


def _bleu_expr(agg: str, digits: int | None = 6) -> list[str]:
    t, r = f"{agg}(testlen)", f"{agg}(reflen)"
    ratio = f"(({t} + 1e-15) / ({r} + 1e-9))"
    bp = f"(CASE WHEN {ratio} < 1 THEN exp(1 - 1 / {ratio}) ELSE 1.0 END)"
    out, prod = [], "1.0"
    for k in range(1, 5):
        prod = f"{prod} * ({agg}(correct{k}) + 1e-15) / ({agg}(guess{k}) + 1e-9)"
        v = f"pow({prod}, 1.0 / {k}) * {bp}"
        out.append(f"round({v}, {digits}) AS bleu{k}" if digits is not None else f"{v} AS bleu{k}")
    return out


def bleu_corpus_sql(**kw) -> str:
    return S.ctes(base(**kw) + bleu_ctes(), "SELECT system, " + ", ".join(_bleu_expr("sum")) + " FROM stats GROUP BY system")


def bleu_sentence_sql(**kw) -> str:
    return S.ctes(base(**kw) + bleu_ctes(), "SELECT system, key, " + ", ".join(_bleu_expr("")) + " FROM stats")


def bleu_lengths_sql(**kw) -> str:
    """BLEU by the shortest and by the average reference length."""
    lens = ("lens2", "SELECT key, min(l) AS shortest, avg(l) AS average FROM rl GROUP BY key")
    each = [f"SELECT system, '{e}' AS effective, {', '.join(_bleu_expr('sum'))} FROM (SELECT s.* REPLACE (r.{e} AS reflen) FROM stats s JOIN lens2 r USING (key)) GROUP BY system"
            for e in ("shortest", "average")]
    return S.ctes(base(**kw) + bleu_ctes() + [lens], " UNION ALL ".join(each))


def bleu_pool_sql(**kw) -> str:
    """Every line against all reference lines as one pool."""
    own = dict(bleu_ctes())
    return S.ctes(base(**kw) + [
        ("pmax", "SELECT n, g, max(tf) AS rmax FROM rng GROUP BY n, g"),
        ("corr", "SELECT system, key, n, sum(least(hc, coalesce(rmax, 0))) AS c FROM hng LEFT JOIN pmax USING (n, g) GROUP BY ALL"),
        ("seg", own["seg"]), ("rl", own["rl"]), ("pl", "SELECT DISTINCT l FROM rl"),
        ("near", """SELECT t.testlen, arg_min(p.l, abs(p.l - t.testlen) * 1000000 + p.l) AS reflen
                    FROM (SELECT DISTINCT testlen FROM seg) t CROSS JOIN pl p GROUP BY t.testlen"""),
        ("closest", "SELECT s.system, s.key, s.testlen, r.reflen FROM seg s JOIN near r USING (testlen)"), ("stats", own["stats"]),
        ("sb", "SELECT system, key, " + ", ".join(_bleu_expr("", digits=None)) + " FROM stats")],
        "SELECT system, " + ", ".join(f"round(avg(bleu{k}), 6) AS bleu{k}" for k in range(1, 5)) + " FROM sb GROUP BY system")


def nist_ctes() -> list[tuple[str, str]]:
    return [
        ("rc", "SELECT n, g, sum(tf) AS cnt FROM rng GROUP BY n, g"),
        ("tw", "SELECT sum(cnt) AS tw FROM rc WHERE n = 1"),
        ("info", """SELECT r.n, r.g, log2(coalesce(p.cnt, tw.tw) / r.cnt) AS info
                    FROM rc r CROSS JOIN tw
                    LEFT JOIN rc p ON p.n = r.n - 1 AND r.n > 1 AND p.g = regexp_replace(r.g, ' [^ ]+$', '')"""),
        ("matched", """SELECT system, n, sum(least(hc, rmax) * info) AS inf
                       FROM hng JOIN rmax USING (key, n, g) JOIN info USING (n, g) GROUP BY ALL"""),
        ("sysn", "SELECT system, n, sum(hc) AS cnt FROM hng GROUP BY ALL"),
        ("pern", "SELECT s.system, s.n, coalesce(m.inf, 0) / s.cnt AS v FROM sysn s LEFT JOIN matched m USING (system, n)"),
        ("lens", f"""SELECT system, sum(tl) AS sl, sum(rl) AS rl FROM (
                       SELECT h.system, len({S.words('h.hyp')}) AS tl, r.rl FROM h
                       JOIN (SELECT key, avg(len({S.words('ref')})) AS rl FROM lines GROUP BY key) r USING (key))
                     GROUP BY system"""),
        ("bp", f"""SELECT system, CASE WHEN least(sl / rl, 1.0) > 0
                                      THEN exp({NIST_BETA!r} * pow(ln(least(sl / rl, 1.0)), 2)) ELSE 0.0 END AS bp
                   FROM lens"""),
        ("nistt", "SELECT p.system, " + ", ".join(
            f"round(sum(CASE WHEN n <= {k} THEN v ELSE 0 END) * any_value(b.bp), 6) AS nist{k}" for k in range(1, 5))
         + " FROM pern p JOIN bp b USING (system) GROUP BY p.system"),
    ]


def nist_sql(**kw) -> str:
    return S.ctes(base(**kw) + nist_ctes(), "SELECT * FROM nistt")


def cider_ctes() -> list[tuple[str, str]]:
    return [
        ("nseg", "SELECT count(DISTINCT key) AS nn FROM lines"),
        ("dfr", "SELECT n, g, count(DISTINCT key) AS df FROM rng GROUP BY n, g"),
        ("rv", """SELECT r.key, r.ri, r.n, r.g, r.tf * (ln(nseg.nn) - ln(greatest(coalesce(d.df, 0), 1))) AS v
                  FROM rng r LEFT JOIN dfr d USING (n, g) CROSS JOIN nseg"""),
        ("hv", """SELECT x.system, x.key, x.n, x.g, x.hc * (ln(nseg.nn) - ln(greatest(coalesce(d.df, 0), 1))) AS v
                  FROM hng x LEFT JOIN dfr d USING (n, g) CROSS JOIN nseg"""),
        ("rnorm", "SELECT key, ri, n, sqrt(sum(v * v)) AS nr FROM rv GROUP BY ALL"),
        ("hnorm", "SELECT system, key, n, sqrt(sum(v * v)) AS nh FROM hv GROUP BY ALL"),
        ("dot", """SELECT a.system, a.key, b.ri, a.n, sum(least(a.v, b.v) * b.v) AS dot
                   FROM hv a JOIN rv b ON a.key = b.key AND a.n = b.n AND a.g = b.g GROUP BY ALL"""),
        ("rlen", "SELECT key, ri, sum(tf) AS lr FROM rng WHERE n = 2 GROUP BY ALL"),
        ("hlen", "SELECT system, key, sum(hc) AS lh FROM hng WHERE n = 2 GROUP BY ALL"),
        ("vals", """SELECT d.system, d.key,
                      (CASE WHEN hn.nh <> 0 AND rn.nr <> 0 THEN d.dot / (hn.nh * rn.nr) ELSE d.dot END)
                      * exp(-pow(coalesce(hl.lh, 0) - coalesce(rl.lr, 0), 2) / (2 * 36.0)) AS val
                    FROM dot d JOIN hnorm hn USING (system, key, n) JOIN rnorm rn USING (key, ri, n)
                    LEFT JOIN hlen hl USING (system, key) LEFT JOIN rlen rl USING (key, ri)"""),
        ("ciders", """SELECT h.system, h.key, coalesce(s.s, 0.0) / 4 / nr.nr * 10.0 AS cider
                      FROM h LEFT JOIN (SELECT system, key, sum(val) AS s FROM vals GROUP BY ALL) s USING (system, key)
                      JOIN (SELECT key, count(*) AS nr FROM lines GROUP BY key) nr USING (key)"""),
    ]


def cider_sql(**kw) -> str:
    return S.ctes(base(**kw) + cider_ctes(), "SELECT system, key, round(cider, 6) AS cider FROM ciders")


def _head(n_lines: int) -> list[tuple[str, str]]:
    """The first lines of every system in the order of their keys, and their n-grams."""
    return [("hh", f"SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY system ORDER BY key) <= {n_lines}"),
            ("hhng", _ngrams("hh", "system, key", "hyp", "hc"))]


def entropy_head_sql(n_lines: int) -> str:
    return S.ctes(base() + _head(n_lines), f"""
        SELECT system, n, round(-sum(hc / t * (ln(hc) - ln(t))), 6) AS entropy, any_value(a) AS avg_len FROM (
          SELECT system, n, g, sum(hc) AS hc, sum(sum(hc)) OVER (PARTITION BY system, n) AS t FROM hhng GROUP BY system, n, g)
        JOIN (SELECT system, round(avg(len({S.words('hyp')})), 6) AS a FROM hh GROUP BY system) USING (system)
        GROUP BY system, n""")


def rouge_l_sql(**kw) -> str:
    # the LCS table row by row: acc is the row so far, x = [match, upper left, upper]
    row = """list_reduce(list_transform(range(1, len(mt) + 1), lambda i: [mt[i], prev[i], prev[i + 1]]),
               lambda acc, x: list_append(acc, CASE WHEN x[1] = 1 THEN x[2] + 1 ELSE greatest(x[3], acc[len(acc)]) END), [0::BIGINT])"""
    return S.ctes(base(**kw) + [
        ("pr", "SELECT system, key, ri, string_split(hyp, ' ') AS ht, string_split(ref, ' ') AS rt FROM h JOIN lines USING (key)"),
        ("mm", """SELECT system, key, ht, rt, list_transform(ht, lambda a: list_transform(rt, lambda b: CASE WHEN a = b THEN 1::BIGINT ELSE 0 END)) AS ms
                  FROM pr"""),
        ("lc", f"""SELECT system, key, len(ht) AS hn, len(rt) AS rn,
                          list_last(list_reduce(ms, lambda prev, mt: {row}, list_transform(range(len(rt) + 1), lambda i: 0::BIGINT))) AS l FROM mm"""),
        ("pq", "SELECT system, key, max(l / hn) AS p, max(l / rn) AS r FROM lc GROUP BY system, key")],
        "SELECT system, key, round(CASE WHEN p <> 0 AND r <> 0 THEN (1 + 1.2 ** 2) * p * r / (r + 1.2 ** 2 * p) ELSE 0.0 END, 6) AS rouge_l FROM pq")


def hyp_refs_sql(**kw) -> str:
    return S.ctes(base(**kw), "SELECT h.system, h.key, l.ri, h.hyp, l.ref FROM h JOIN lines l USING (key)")


def system_report_sql(n_lines: int | None = None, **kw) -> str:
    """Entropy and mean length over the first ``n_lines``, everything else over all lines."""
    def per_n(src):
        return f"""SELECT system, n, -sum(hc / t * (ln(hc) - ln(t))) AS e, count(*) / sum(hc) AS d FROM (
                     SELECT system, n, g, sum(hc) AS hc, sum(sum(hc)) OVER (PARTITION BY system, n) AS t
                     FROM {src} GROUP BY system, n, g) GROUP BY system, n"""
    head = _head(n_lines) if n_lines else []
    lines, grams = ("hh", "hhng") if n_lines else ("h", "hng")
    more = head + [
        ("ent", per_n(grams)), ("dv", per_n("hng")),
        ("entp", "SELECT system, " + ", ".join(f"round(max(CASE WHEN n = {k} THEN e END), 6) AS entropy{k}" for k in range(1, 5)) + " FROM ent GROUP BY system"),
        ("divp", "SELECT system, " + ", ".join(f"round(max(CASE WHEN n = {k} THEN d END), 6) AS div{k}" for k in (1, 2)) + " FROM dv GROUP BY system"),
        ("al", f"SELECT system, round(avg(len({S.words('hyp')})), 6) AS avg_len FROM {lines} GROUP BY system"),
        ("sl", "SELECT system, count(*) AS n_lines FROM h GROUP BY system"), ("bc", bleu_corpus_body())]
    body = ("SELECT s.system, s.n_lines, " + ", ".join(f"nt.nist{k}" for k in range(1, 5)) + ", "
            + ", ".join(f"b.bleu{k}" for k in range(1, 5)) + ", CAST(NULL AS DOUBLE) AS meteor, "
            + ", ".join(f"e.entropy{k}" for k in range(1, 5)) + ", d.div1, d.div2, al.avg_len "
            + "FROM sl s JOIN nistt nt USING (system) JOIN bc b USING (system) JOIN entp e USING (system) JOIN divp d USING (system) JOIN al USING (system)")
    return S.ctes(base(**kw) + bleu_ctes() + nist_ctes() + more, body)


def bleu_corpus_body() -> str:
    return "SELECT system, " + ", ".join(_bleu_expr("sum")) + " FROM stats GROUP BY system"
