"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, each over
whole tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convkit.llm import bpe, cut_bpe, decontaminate, licences, merkle, near_dedup, rule_ensemble, rule_ledger, token_count, token_file, toxicity, turn_repair, url_rules
from convkit.llm.stages import documents, written
from convkit.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_toxicity")
def op1(spark, sf):
    """doc_id, the probability of every category, toxic. Learns from labelled
    rows whose crc32(doc_id) mod 5 is not 0; the others measure accuracy."""
    docs = documents(spark, sf)
    labels = documents(spark, sf, "labels").where(~rule_ensemble.held_out(F.col("doc_id")))
    return toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).drop("text")


@query("op2_decontamination")
def op2(spark, sf):
    """doc_id, item_id, similarity of every contaminated document and its items."""
    return decontaminate.leaks(documents(spark, sf), documents(spark, sf, "benchmark")).drop("rid")


@query("op3_quality")
def op3(spark, sf):
    docs = documents(spark, sf)
    model = rule_ensemble.fit(docs, documents(spark, sf, "labels"))
    return rule_ensemble.score(docs.select("doc_id", "text"), model).select(
        "doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_near_dedup")
def op4(spark, sf):
    """doc_id, class_id, class_size, keep."""
    return near_dedup.near_dup_classes(documents(spark, sf)).drop("key")


def _vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; only the driver opens it."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op5_token_file")
def op5(spark, sf):
    with open(_vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    folder = scratch_path(spark, f"tokens-{uuid.uuid4().hex[:12]}")
    files = written(token_file.write_files(documents(spark, sf), folder, tokenizer, end_id=0), "token-files")
    return token_file.read_files(files, folder, files.count())


@query("op6_token_counts")
def op6(spark, sf):
    """doc_id, n_tokens under the pieces and scores of the 32k vocabulary."""
    vocabulary = token_count.unigram_vocabulary(_vocabulary("piece_bpe_32k.model"))
    return token_count.token_counts(documents(spark, sf).select("doc_id", "text"), vocabulary)


def bpe_digests(docs: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``docs`` without its text, plus n_tokens, ids_sha256 and decoded_sha256."""
    tokens = bpe.read_ranks(_vocabulary(rank_file))
    return _digests(bpe.decode(bpe.encode(docs, tokens), tokens))


def bpe_round_trip(docs: DataFrame, rank_file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The same columns in one pass."""
    return _digests(bpe.round_trip(docs, bpe.read_ranks(_vocabulary(rank_file))))


def _digests(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


@query("op7_bpe")
def op7(spark, sf):
    return bpe_digests(documents(spark, sf).select("doc_id", "text"))


_LICENCE_SQL = r"""
WITH t(id, licence, notice) AS (VALUES {templates}),
tw AS (SELECT id, licence, word, count(*) AS tf FROM (
  SELECT id, licence, unnest(list_filter(string_split_regex(lower(notice), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({stop}))) AS word FROM t) GROUP BY ALL),
idf AS (SELECT word, (ln((1 + {n}) / (1 + count(DISTINCT licence))) + 1) * CASE WHEN word IN ({common}) THEN {usual} ELSE 1 END AS idf FROM tw GROUP BY word),
wt AS (SELECT id, licence, word, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS weight FROM tw JOIN idf USING (word)),
f AS (SELECT DISTINCT concat(source, '/', lang, '/', doc_id, '.txt') AS path, lower(text) AS low FROM documents),
g AS (SELECT path, string_split_regex(regexp_replace(low, '([.!?;])[ \t]', '\1' || chr(10), 'g'), chr(10)) AS l FROM f),
u AS (SELECT path, i * {window} + k - 1 AS unit, array_to_string(l[i + 1:i + k], ' ') AS line
  FROM (SELECT path, l, unnest(range(len(l))) AS i FROM g), range(1, {window} + 1) r(k) WHERE i + k <= len(l)
  UNION ALL SELECT path, -1, low FROM f),
uw AS (SELECT path, unit, list_filter(string_split_regex(line, '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({stop})) AS ws FROM u),
x AS (SELECT path, unit, len(ws) AS n, unnest(ws) AS word FROM uw WHERE len(list_intersect(ws, (SELECT list(word) FROM idf))) >= {shared}),
xf AS (SELECT path, unit, n, word, count(*) * coalesce(any_value(idf), {other}) AS x FROM x LEFT JOIN idf USING (word) GROUP BY ALL),
nm AS (SELECT path, unit, n, sqrt(sum(x * x)) AS norm FROM xf GROUP BY ALL),
c AS (SELECT path, unit, n, id, licence, round(sum(x * weight) / any_value(norm), 6) AS cosine
  FROM xf JOIN wt USING (word) JOIN nm USING (path, unit, n) WHERE unit = -1 OR id < {full}
  GROUP BY ALL HAVING cosine >= {cosine} AND count(*) >= {shared}),
hit AS (SELECT *, row_number() OVER (PARTITION BY path, unit ORDER BY cosine DESC, licence) AS k FROM c QUALIFY k = 1),
best AS (SELECT path, arg_min(licence, (-cosine, unit, licence)) AS licence, max(cosine) AS cosine, sum(n) FILTER (unit % {window} = 0) AS lw
  FROM hit WHERE unit >= 0 GROUP BY path),
own AS (SELECT path, coalesce(w.licence, best.licence) AS licence, coalesce(w.cosine, best.cosine) AS cosine, lw, w.licence IS NOT NULL AS whole
  FROM best LEFT JOIN (SELECT * FROM hit WHERE unit = -1) w USING (path)),
st AS (SELECT own.*, regexp_extract(path, '^(.*)/', 1) AS dir FROM own JOIN f USING (path)
  WHERE whole OR regexp_matches(path, '{name}')
    OR coalesce(lw, 0) >= {share} * len(list_filter(string_split_regex(low, '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({stop})))),
bd AS (SELECT dir, licence, cosine, path FROM st QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, licence) = 1),
fd AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS d FROM f),
r AS (SELECT fd.path, bd.licence, bd.cosine, bd.path AS source FROM fd
  JOIN bd ON d = bd.dir OR starts_with(d, bd.dir || '/') OR bd.dir = ''
  QUALIFY row_number() OVER (PARTITION BY fd.path ORDER BY length(bd.dir) DESC) = 1)
SELECT d.doc_id, f.path, coalesce(own.licence, r.licence) AS licence, coalesce(own.cosine, r.cosine) AS cosine,
  CASE WHEN own.path IS NOT NULL THEN 'file' WHEN r.path IS NOT NULL THEN 'directory' END AS origin,
  CASE WHEN own.path IS NOT NULL THEN f.path ELSE r.source END AS source
FROM documents d JOIN f ON f.path = concat(d.source, '/', d.lang, '/', d.doc_id, '.txt')
LEFT JOIN own ON own.path = f.path LEFT JOIN r ON r.path = f.path
""".format(templates=", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate([*licences.TEMPLATES, *licences.FULL])),
           n=len({k for k, _ in licences.TEMPLATES}), full=len(licences.TEMPLATES), other=licences.OTHER, shared=licences.SHARED,
           window=licences.WINDOW, usual=licences.USUAL, common=", ".join(f"'{w}'" for w in licences.COMMON), name=licences.FILE_NAME, stop=", ".join(f"'{w}'" for w in licences.STOP),
           cosine=licences.COSINE, share=licences.FILE_SHARE)


@query("op8_licences", _LICENCE_SQL)
def op8(spark, sf):
    """Licence of every document; its path is source/lang/doc_id.txt."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"),
                    F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    docs = documents(spark, sf)
    found = licences.scan(docs.select(path.alias("path"), "text"))
    return docs.select("doc_id", path.alias("path")).join(found, "path").select("doc_id", "path", "licence", "cosine", "origin", "source")


# The URL rules of the registered query, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URL_SQL = """
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
m AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS k
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


@query("op9_url_rules", _URL_SQL)
def op9(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(documents(spark, sf, "pages"), rules)


_LEDGER_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
  (failed & {base}) <> 0 AS base_failed, (failed & {mask}) = 0 AS kept
FROM f
""".format(bits=" + ".join(f"CASE WHEN {c} THEN {rule_ledger.bit(r)} ELSE 0 END" for r, c in rule_ledger.RULES),
           base=rule_ledger.mask("base"), mask=rule_ledger.mask(rule_ledger.POLICY))


@query("op10_rule_ledger", _LEDGER_SQL)
def op10(spark, sf):
    led = rule_ledger.ledger(documents(spark, sf))
    return led.select("doc_id", *rule_ledger.MEASURES, "failed", (~rule_ledger.kept("base")).alias("base_failed"),
                      rule_ledger.kept().alias("kept"))


@query("op13_cut_bpe")
def op13(spark, sf):
    with open(_vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    ids = cut_bpe.encode(documents(spark, sf).select("doc_id", "text"), tokenizer, packed=True)
    return cut_bpe.decode(ids, tokenizer).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


_MERKLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS rest
  FROM documents),
f AS (
  SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM c),
l AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(rest, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed
  FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
u AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY tree, level, pos // 16, n),
s AS (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (
  SELECT 0 AS level, pos, n, digest FROM s
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM v WHERE n > 1 GROUP BY level, pos // 16, n),
way AS (
  SELECT p.tree, p.pos, u.level, coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < p.pos >> (4 * u.level)), '') AS lft,
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > p.pos >> (4 * u.level)), '') AS rgt
  FROM p JOIN u ON u.tree = p.tree AND u.n > 1 AND u.pos >> 4 = p.pos >> (4 * u.level + 4) GROUP BY ALL
  UNION ALL
  SELECT p.tree, p.pos, s.height + v.level, coalesce(string_agg(v.digest, '' ORDER BY v.pos) FILTER (v.pos < s.pos >> (4 * v.level)), ''),
    coalesce(string_agg(v.digest, '' ORDER BY v.pos) FILTER (v.pos > s.pos >> (4 * v.level)), '')
  FROM p JOIN s ON s.tree = p.tree JOIN v ON v.n > 1 AND v.pos >> 4 = s.pos >> (4 * v.level + 4) GROUP BY p.tree, p.pos, s.height, v.level),
g AS (
  SELECT tree, pos, 0 AS level, coalesce(changed, leaf) AS digest FROM p
  UNION ALL
  SELECT g.tree, g.pos, g.level + 1, sha256(lft || digest || rgt) FROM g JOIN way ON way.tree = g.tree AND way.pos = g.pos AND way.level = g.level),
e AS (SELECT tree, pos, arg_max(digest, level) AS folded FROM g GROUP BY ALL),
w AS (SELECT tree, pos, sha256(string_agg(lft || rgt, '' ORDER BY level)) AS proof FROM way GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(w.proof, sha256('')) AS proof_sha256, e.folded AS folded_root,
  e.folded = r.digest AS verified
FROM p JOIN s ON s.tree = p.tree JOIN (SELECT digest FROM v WHERE n = 1) r ON true JOIN e ON e.tree = p.tree AND e.pos = p.pos
LEFT JOIN w ON w.tree = p.tree AND w.pos = p.pos
"""


@query("op12_merkle", _MERKLE_SQL)
def op12(spark, sf):
    return merkle.audit(spark, sf)


_REPAIR_SQL = r"""
WITH RECURSIVE b AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
      lambda i: [ord(substr(k, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS d
  FROM b),
g AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS again
  FROM c WHERE d <> 0),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat(strlen(role), ':', role, strlen(text), ':', text))) AS i
  FROM g),
f AS (
  SELECT *, left(role, 1) AS init, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prev,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again2,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut
  FROM o),
r AS (SELECT *, NOT blank AND again2 AS dup, NOT blank AND NOT again2 AND cut AS trunc FROM f),
due(s, t, who) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins(s, t, n, said) AS (
  SELECT s, s, 0, '' FROM due UNION ALL SELECT s, t, 1, who || ':' || chr(10) FROM due
  UNION ALL SELECT x.s, y.t, 2, x.who || ':' || chr(10) || y.who || ':' || chr(10) FROM due x JOIN due y ON y.s = x.t),
keep(init, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
w AS (
  SELECT c, n + 1 AS i, s, ROW(3 * k, repeat('I', k), said) AS best
  FROM (SELECT DISTINCT c, n FROM r), (VALUES (0, 0, ''), (1, 2, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 1, 'assistant:' || chr(10)), (3, 0, '')) e(s, k, said)
  UNION ALL
  SELECT c, i, s, min(ROW(cost, script, said)) FROM (
    SELECT w.c, r.i, ins.s, 3 * ins.n + e.cost + w.best[1] AS cost, repeat('I', ins.n) || e.letter || w.best[2] AS script, ins.said || e.said || w.best[3] AS said
    FROM w JOIN r ON r.c = w.c AND r.i = w.i - 1
    JOIN LATERAL (
      SELECT w.s AS s, 4 AS cost, 'D' AS letter, '' AS said
      UNION ALL SELECT k.s, CASE WHEN r.trunc THEN 3 ELSE 0 END, 'K', r.role || ':' || r.text || chr(10) FROM keep k
        WHERE k.init = r.init AND k.t = w.s AND NOT r.blank AND NOT r.dup
      UNION ALL SELECT due.s, CASE WHEN r.trunc THEN 6 ELSE 3 END, 'R', due.who || ':' || r.text || chr(10) FROM due
        WHERE due.t = w.s AND NOT r.blank AND NOT r.dup) e ON true
    JOIN ins ON ins.t = e.s)
  GROUP BY c, i, s),
s AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
    count(*) FILTER (i > 1 AND concat(prev, init) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c)
SELECT d.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
  coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(w.best[1], 0)::BIGINT AS cost,
  coalesce(w.best[2], '') AS audit, sha256(coalesce(left(w.best[3], length(w.best[3]) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.c IS NOT NULL
LEFT JOIN w ON w.c = s.c AND w.i = 1 AND w.s = 0
"""


@query("op11_turn_repair", _REPAIR_SQL)
def op11(spark, sf):
    return turn_repair.audit(spark, sf)
