"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from convkit.plans import sqlfrag as S
from convkit.plans import thread_sql as TS
from convkit.sources.adapters import SQL as A

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


THREAD = dict(max_len=100, max_depth=5, min_depth=2, min_score=1)

oracle("thread_pairs", TS.thread_pairs_sql(**THREAD))

oracle("quality_filter", S.ctes(
    [("p", A["doc_pairs"]), ("t", f"SELECT *, {S.words('src')} AS st, {S.words('tgt')} AS tt FROM p")],
    f"SELECT doc_id, line_no, coalesce({S.skip_reason('src', 'tgt', 'st', 'tt')}, 'keep') AS skip_reason FROM t"))

# --- scalar text functions --------------------------------------------------


def _turn(expr: str) -> str:
    return f"SELECT conv_id, turn, {expr} AS out FROM conversations"


oracle("minimal_norm", _turn(S.minimal_norm("text")))
oracle("gpt_norm", _turn(S.gpt_norm("text")))
oracle("eval_clean", _turn(S.eval_clean("text")))
oracle("unescape_line", _turn(
    "regexp_replace(regexp_replace(regexp_replace(text, '\\\\+\"([^\\n])', '\"\"\\1', 'g'), "
    "'\\\\+''', '''', 'g'), '\\\\', '', 'g')"))
oracle("ws_norm", _turn(S.collapse("text")))
oracle("detokenise", _turn(
    "substr(replace(replace(replace(replace(replace(replace(array_to_string(list_concat(['<s>'], "
    f"list_transform({S.words('text')}, lambda w: ' ' || w), ['</s>']), ''), ' !', '!'), ' .', '.'), "
    "' ?', '?'), ' ,', ','), '<s>', ''), '</s>', ''), 2)"))
_P = "[" + ", ".join(S.q(p) for p in ["''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-",
                                       ".", "?", "!", ",", ":", "-", "--", "...", ";"]) + "]"
oracle("strip_punct", _turn(
    f"array_to_string(list_filter({S.words(S.eval_clean('text'))}, lambda t: NOT list_contains({_P}, t)), ' ')"))

# --- extraction ---------------------------------------------------------------
_B = TS.base_ctes()
oracle("submission_filter", S.ctes(_B, "SELECT month, sid, num_comments, title FROM subs"))
oracle("comment_admission", S.ctes(_B, "SELECT month, name, n_char, body FROM adm"))
_META = """SELECT c.month, 't1_' || c.id AS name, coalesce(lower(split_part(s.permalink, '/', 3)), '') AS subreddit,
                  coalesce(lower(s.domain), '') AS domain, coalesce(s.title, '') AS title
           FROM comments c LEFT JOIN subs s ON s.month = c.month AND s.sid = c.link_id"""
oracle("comment_meta", S.ctes(_B, _META))
oracle("score_filter", S.ctes(_B, "SELECT month, name, CAST(coalesce(score, 0) AS BIGINT) AS score FROM adm "
                                  "WHERE coalesce(score, 0) >= 1"))
oracle("subreddit_block", S.ctes(_B + [("m", _META)], """
    SELECT month, name, subreddit, CASE WHEN subreddit = '' THEN 'missing'
                                        WHEN subreddit IN ('src3', 'src7') THEN 'bad_subreddit' ELSE 'ok' END AS reason
    FROM m"""))
oracle("keep_keys", TS.thread_pairs_sql(keep_keys=True, **THREAD))
oracle("leaf_comments", S.ctes(_B, """SELECT month, name FROM adm c WHERE NOT EXISTS (
    SELECT 1 FROM adm a WHERE a.month = c.month AND a.link_id = c.link_id AND a.parent_id = c.name)"""))
oracle("turn_weights", TS.thread_pairs_sql(leaves_only=True, block_subs=True, discard=True, **THREAD))
# the same list as the query's
BLOCK_WORDS = ["und der", "the and", "que la", "of the and in", "on, the", "thonsh"]
oracle("blockword_hits", S.ctes(_B, f"SELECT name, CAST({S.block_match('body', BLOCK_WORDS)} AS INTEGER) AS blocked FROM adm"))
_EDGE = "[^\\p{L}\\p{N}_]"
oracle("blockword_list", S.ctes(_B + [
    ("pl", f"""SELECT DISTINCT lower(trim(array_to_string(ws[2:4], ' '))) AS phrase FROM (
                 SELECT {S.words('text')} AS ws FROM conversations WHERE turn = 0) WHERE len(ws) >= 4"""),
    ("hit", f"""SELECT DISTINCT name FROM adm JOIN pl ON strpos(lower(body), phrase) > 0
                AND regexp_matches(lower(body), '(^|{_EDGE})' || regexp_escape(phrase) || '({_EDGE}|$)')
                WHERE phrase <> '' AND phrase NOT LIKE '#%'""")],
    "SELECT name, CAST(name IN (SELECT name FROM hit) AS INTEGER) AS blocked FROM adm"))
oracle("thread_pairs_blocked", TS.thread_pairs_sql(block_words=BLOCK_WORDS, **THREAD))
oracle("thread_pairs_bucketed", ORACLE["thread_pairs"])
oracle("thread_pairs_repeats", TS.thread_pairs_sql(repeats=True, **THREAD))
oracle("skip_audit", S.ctes(TS.instances_ctes(block_subs=True, **THREAD), """
    SELECT skip_reason, subreddit, count(*) AS n FROM inst WHERE skip_reason IS NOT NULL GROUP BY ALL"""))
oracle("extract_stats", S.ctes(_B, """
    SELECT m.month, coalesce(a.n, 0) AS comments_kept, coalesce(r.n, 0) AS comments_read,
           coalesce(sk.n, 0) AS subs_kept, coalesce(sr.n, 0) AS subs_read
    FROM (SELECT DISTINCT month FROM comments UNION SELECT DISTINCT month FROM submissions) m
    LEFT JOIN (SELECT month, count(*) AS n FROM adm GROUP BY month) a ON a.month = m.month
    LEFT JOIN (SELECT month, count(*) AS n FROM comments GROUP BY month) r ON r.month = m.month
    LEFT JOIN (SELECT month, count(*) AS n FROM subs GROUP BY month) sk ON sk.month = m.month
    LEFT JOIN (SELECT month, count(*) AS n FROM submissions GROUP BY month) sr ON sr.month = m.month"""))
def _conv_stats(**kw) -> str:
    # selected from the instances, total from what the extract stage wrote
    return S.ctes(TS.instances_ctes(**THREAD, **kw), f"""
    SELECT month, CASE WHEN grouping(shard) = 1 THEN 'all' ELSE shard END AS shard,
           sum(CASE WHEN k THEN 1 ELSE 0 END) AS selected, sum(tot) AS total,
           CASE WHEN grouping(shard) = 1 THEN NULL
                ELSE round(sum(CASE WHEN k THEN len({S.words("coalesce(response, '')")}) END)
                           / nullif(sum(CASE WHEN k THEN 1 ELSE 0 END), 0), 6) END AS avg_len
    FROM (SELECT month, CAST(CAST(substr(sid, 4) AS BIGINT) % 2 AS VARCHAR) AS shard, skip_reason IS NULL AS k, response, 0 AS tot FROM inst
          UNION ALL SELECT month, CAST(CAST(substr(link_id, 4) AS BIGINT) % 2 AS VARCHAR), FALSE, NULL, 1 FROM adm)
    GROUP BY ROLLUP (month, shard) HAVING month IS NOT NULL""")


oracle("conv_stats", _conv_stats())
oracle("conv_stats_leaves", _conv_stats(leaves_only=True))
oracle("leaf_ratio", S.ctes(_B, "SELECT month, round(count(DISTINCT parent_id) / count(*), 6) AS leaf_ratio "
                                "FROM adm GROUP BY month"))

# --- n-gram statistics --------------------------------------------------------
_NG = ("ng", f"""
    SELECT n, array_to_string(ws[i:i + n - 1], ' ') AS ngram
    FROM (SELECT {S.words('text')} AS ws FROM conversations) c,
         (SELECT unnest([1, 2, 3, 4]) AS n) k,
         LATERAL (SELECT unnest(range(1, len(c.ws) - k.n + 2)) AS i)""")
_NC = ("nc", "SELECT n, ngram, count(*) AS cnt FROM ng GROUP BY n, ngram")
oracle("ngram_counts", S.ctes([_NG, _NC], "SELECT n, ngram, cnt FROM nc"))
oracle("ngram_entropy", S.ctes([_NG, _NC], """
    SELECT n, round(-sum(cnt / t * (ln(cnt) - ln(t))), 6) AS entropy
    FROM (SELECT *, sum(cnt) OVER (PARTITION BY n) AS t FROM nc) GROUP BY n"""))
oracle("distinct_n", S.ctes([_NG, _NC], "SELECT n, round(count(*) / sum(cnt), 6) AS distinct FROM nc GROUP BY n"))
oracle("distinct_sketch", S.ctes([_NG, _NC], "SELECT n, CAST(sum(cnt) AS BIGINT) AS tokens, 1 AS close FROM nc GROUP BY n"))
_OWN = "[a-z]+|[0-9]|[^\\sa-z0-9]"
oracle("ngram_counts_tokeniser", S.ctes([
    ("ct", f"SELECT {S.eval_clean('text', _OWN)} AS x FROM conversations"),
    ("tk", f"SELECT {S.tokenise('x', _OWN)} AS t FROM ct"),
    ("og", "SELECT n, t[i:i + n - 1] AS g FROM tk, (SELECT unnest([1, 2, 3, 4]) AS n) k, "
           "LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i)")],
    "SELECT n, array_to_string(g, ' ') AS ngram, count(*) AS cnt FROM og GROUP BY ALL"))
oracle("avg_len", f"SELECT round(avg(len({S.words('text')})), 6) AS avg_len FROM conversations")
oracle("vocab", f"""
    SELECT row_number() OVER (ORDER BY cnt DESC, word) AS rank, word, cnt
    FROM (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest({S.words('text')}) AS w FROM conversations)
          GROUP BY w)""")

_SENT = [("sa", A["state_action"]),
         ("sx", """SELECT conv_id, turn, CAST(p - 1 AS INTEGER) AS pos, arr[p] AS s
                   FROM (SELECT conv_id, turn, list_concat(string_split(source, ' EOS '), [target, next_state]) AS arr
                         FROM sa) a, LATERAL (SELECT unnest(range(1, len(a.arr) + 1)) AS p)"""),
         ("sent", "SELECT conv_id, turn, pos, substr(s, 1, 1) AS flag, substr(s, 5) AS sentence FROM sx"),
         ("tri", f"""SELECT conv_id, turn, pos, array_to_string(ws[i:i + 2], ' ') AS trigram
                     FROM (SELECT *, {S.words('sentence')} AS ws FROM sent WHERE CAST(flag AS INTEGER) <> 0) c,
                          LATERAL (SELECT unnest(range(1, len(c.ws) - 1)) AS i)"""),
         ("freq", "SELECT trigram, count(*) AS cnt FROM tri GROUP BY trigram")]
oracle("trigram_freq", S.ctes(_SENT, "SELECT trigram, cnt FROM freq"))
ORACLE_BLAND = """
    SELECT s.conv_id, s.turn, s.pos,
           CASE WHEN CAST(s.flag AS INTEGER) = 0 THEN 'bad'
                WHEN coalesce(c.n, 0) > 0 AND c.hi >= 0.9 * c.n THEN 'bland' ELSE '' END AS tag
    FROM sent s LEFT JOIN (
      SELECT t.conv_id, t.turn, t.pos, count(*) AS n, sum(CASE WHEN f.cnt > h.threshold THEN 1 ELSE 0 END) AS hi
      FROM tri t JOIN freq f ON f.trigram = t.trigram,
           (SELECT cnt AS threshold FROM freq ORDER BY cnt DESC, trigram LIMIT 1 OFFSET 100) h GROUP BY ALL) c
      ON c.conv_id = s.conv_id AND c.turn = s.turn AND c.pos = s.pos"""
oracle("bland_tag", S.ctes(_SENT, ORACLE_BLAND))

_UNROLL = """SELECT conv_id, turn, array_to_string(ctx, ' EOS ') AS context, text AS response FROM (
    SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx
    FROM conversations) WHERE len(ctx) > 0"""
oracle("unroll_context", _UNROLL)
oracle("union_months", S.ctes(_B, "SELECT month, name FROM adm"))
oracle("dedup_last", "SELECT conv_id, arg_max(text, turn) AS text, arg_max(role, turn) AS role "
                     "FROM conversations GROUP BY conv_id")
oracle("default_weights", f"SELECT conv_id, turn, '0.0 ' || context AS context, '1.0 ' || response AS response "
                          f"FROM ({_UNROLL})")
oracle("human_baseline", S.ctes([("r", A["references"])], """
    SELECT key, split_part(refs[2], '|', 2) AS human FROM r
    WHERE len(refs) >= 2 AND strpos(refs[2], '|') > 0"""))

_SHEET = ("rows", """
    SELECT CAST(2 * (conv_id % 2) AS INTEGER) AS file_no, conv_id * 2147483648 + turn AS row_no,
           CASE WHEN turn = 0 THEN 'S' ELSE '' END AS marker, text FROM conversations
    UNION ALL
    SELECT f, r, '', 'preamble' FROM (SELECT unnest([0, 1, 2]) AS f WHERE EXISTS (SELECT 1 FROM conversations)),
                                     (SELECT unnest([-2, -1]) AS r)""")
# a file without a marker uses up an id
_SEG = ("seg", """
    SELECT r.file_no, r.row_no, sum(CASE WHEN marker = 'S' THEN 1 ELSE 0 END)
             OVER (ORDER BY r.file_no, r.row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1
             + (SELECT count(*) FROM (SELECT file_no AS e FROM rows GROUP BY file_no HAVING max(marker) = '') WHERE e < r.file_no) AS conv_id,
           r.text, f.first
    FROM rows r LEFT JOIN (SELECT file_no, min(row_no) AS first FROM rows WHERE marker = 'S' GROUP BY file_no) f
      ON f.file_no = r.file_no""")
oracle("segment_conversations", S.ctes([_SHEET, _SEG], "SELECT file_no, row_no, conv_id, text FROM seg "
                                                        "WHERE row_no >= first"))
oracle("split_conversations", S.ctes([_SHEET, _SEG], """
    SELECT conv_id, row_no, CASE WHEN conv_id % 10 = 0 THEN 'test' WHEN conv_id % 10 = 1 THEN 'valid'
                                 ELSE 'train' END AS split FROM seg WHERE row_no >= first"""))
oracle("split_lines", """
    SELECT line_no, regexp_replace(regexp_replace(regexp_replace(text, '\\\\+"([^\\n])', '""\\1', 'g'),
                                   '\\\\+''', '''', 'g'), '\\\\', '', 'g') AS line,
           CASE WHEN line_no % 10 = 0 THEN 'valid' WHEN line_no % 10 = 1 THEN 'test' ELSE 'train' END AS split
    FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, text FROM conversations)""")

_EMO = ["HAPPINESS", "ANGER", "DISGUST", "FEAR", "NEUTRAL", "SADNESS", "SURPRISE"]
_W = {"HAPPINESS": 1, "ANGER": -1, "DISGUST": -1, "FEAR": -1, "NEUTRAL": 0, "SADNESS": -1, "SURPRISE": 0}
_terms = " + ".join(
    f"CASE WHEN event_id % 10 = 0 AND (event_id // 10) % 7 = {i} THEN 0 ELSE {_W[e]} * ((k * {i + 1} + event_id) % 100) "
    f"/ 100.0 END" for i, e in enumerate(_EMO))
oracle("emotion_reward", f"""
    SELECT event_id AS sentence_id, round(CAST({_terms} AS DOUBLE), 6) + 0.0 AS reward
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
oracle("emotion_codes", """
    SELECT event_id, coalesce(m.label, CAST(e.code AS VARCHAR)) AS label,
           coalesce(CAST(m2.code AS VARCHAR), coalesce(m.label, CAST(e.code AS VARCHAR))) AS emotion_out
    FROM (SELECT event_id, CAST(10001 + event_id % 8 AS INTEGER) AS code FROM events) e
    LEFT JOIN (VALUES (10001, 'Happiness'), (10002, 'Anger'), (10003, 'Disgust'), (10004, 'Fear'),
                      (10005, 'Neutral'), (10006, 'Sadness'), (10007, 'Surprise')) m(code, label) ON m.code = e.code
    LEFT JOIN (VALUES (10001, 'Happiness'), (10002, 'Anger'), (10003, 'Disgust'), (10004, 'Fear'),
                      (10005, 'Neutral'), (10006, 'Sadness'), (10007, 'Surprise')) m2(code, label)
      ON m2.label = coalesce(m.label, CAST(e.code AS VARCHAR))""")


def _pair_key(c: str, t: str) -> str:
    cs = f"CAST({c} AS VARCHAR)"
    parent = (f"CASE WHEN {t} = 0 THEN 't3_' || {cs} ELSE 't1_' || {cs} || '_' || "
              f"CAST({t} - 1 - CASE WHEN {t} % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR) END")
    return f"'t3_' || {cs} || ',' || {parent} || ',' || 't1_' || {cs} || '_' || CAST({t} AS VARCHAR)"


_MULTIREF = TS.instances_ctes(**THREAD) + [
    ("data", """SELECT sid || ',' || pid || ',' || cid AS rid, replace(replace(context, '“', '"'), '”', '"') AS src,
                       replace(replace(response, '“', '"'), '”', '"') AS tgt FROM inst WHERE skip_reason IS NULL"""),
    ("items", f"""SELECT conv_id || '_' || turn AS line_no, 0 AS pos, '0.5' AS score, {_pair_key('conv_id', 'turn')} AS rid
                  FROM conversations UNION ALL
                  SELECT conv_id || '_' || turn, 1, '0.4', {_pair_key('conv_id', 'turn - 1')} FROM conversations UNION ALL
                  SELECT conv_id || '_' || turn, 2, '0.3', 'none,' || {_pair_key('conv_id', 'turn')} FROM conversations"""),
    ("j", "SELECT i.*, d.src, d.tgt FROM items i LEFT JOIN data d ON d.rid = i.rid"),
    ("anchor", "SELECT line_no, src AS asrc FROM j WHERE pos = 0 AND src IS NOT NULL"),
    ("mr", """SELECT j.line_no, a.asrc AS src, string_agg(j.score || '|' || j.tgt, chr(9) ORDER BY j.pos) AS refs
    FROM j JOIN anchor a ON a.line_no = j.line_no WHERE j.src = a.asrc GROUP BY j.line_no, a.asrc""")]
oracle("multiref", S.ctes(_MULTIREF, "SELECT line_no, src, refs FROM mr"))
# lines are numbered in the order in which the file has them
oracle("multiref_file", S.ctes(_MULTIREF + [("num", "SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS k FROM (SELECT DISTINCT line_no FROM items)")],
                               "SELECT num.k AS line_no, src, refs FROM mr JOIN num ON num.line_no = mr.line_no"))

# --- metrics -------------------------------------------------------------------
from convkit.plans import metric_sql as MS  # noqa: E402

_EV = dict(n_refs=6, vshuman=1, clean=True)
oracle("hyp_refs", MS.hyp_refs_sql(**_EV))
oracle("bleu_corpus", MS.bleu_corpus_sql(**_EV))
oracle("bleu_corpus_lengths", MS.bleu_lengths_sql(**_EV))
oracle("bleu_pool_mean", MS.bleu_pool_sql(**_EV))
oracle("bleu_sentence", MS.bleu_sentence_sql(**_EV))
oracle("nist", MS.nist_sql(**_EV))
oracle("cider", MS.cider_sql(**_EV))
oracle("rouge_l", MS.rouge_l_sql(**_EV))
oracle("system_report", MS.system_report_sql(**_EV))
oracle("system_report_head", MS.system_report_sql(**_EV, n_lines=50))

# --- features, batching, scoring --------------------------------------------------
from convkit.plans import feature_sql as FS  # noqa: E402

for _k, _v in FS.sqls().items():
    oracle(_k, _v)

# --- streaming: must equal the batch rule on the same input --------------------------
oracle("history_stream", ORACLE["history_final"])
oracle("history_store", ORACLE["history_final"])
oracle("thread_pairs_stream", ORACLE["thread_pairs_repeats"])
oracle("stream_admission", ORACLE["comment_admission"])
oracle("stream_quality", ORACLE["quality_filter"])

# --- file sources and sinks (same rows as the job they wrap) ------------------------
oracle("dump_scan", ORACLE["comment_admission"])
oracle("dump_scan_xz", ORACLE["comment_admission"])
oracle("extract_roundtrip", ORACLE["comment_admission"])
oracle("pair_sink_scan", f"SELECT sid, pid, cid, context, response FROM ({ORACLE['thread_pairs']})")
oracle("pairs_multiline", "SELECT concat_ws(':', conv_id, turn) AS key, role, coalesce(text, '') AS text FROM conversations")
oracle("key_scan", S.ctes(TS.base_ctes(), "SELECT DISTINCT link_id, comment_id, 'keep' AS kind FROM keys"))
oracle("blocklist_scan", S.ctes(TS.base_ctes(), """
    SELECT DISTINCT lower(split_part(permalink, '/', 3)) AS entry FROM submissions
    WHERE lower(split_part(permalink, '/', 3)) IN ('src3', 'src7')"""))
oracle("refs_scan", S.ctes([("r", A["references"]), ("h", A["hypotheses"])],
                           f"SELECT key, array_to_string(list_transform(refs, lambda x: {S.minimal_norm('x')}), chr(9)) AS refs "
                           "FROM r WHERE key IN (SELECT key FROM h)"))
oracle("multi_target_scan", S.ctes([("r", A["references"])], f"""
    SELECT {S.collapse('key')} AS src, CAST(i - 1 AS INTEGER) AS target_idx, {S.collapse(S.minimal_norm('refs[i]'))} AS tgt
    FROM r, LATERAL (SELECT unnest(range(1, len(r.refs) + 1)) AS i)"""))
oracle("feature_sink", S.ctes(FS.chunk_ctes(), f"SELECT row_id, chunk_id, {FS.ints(FS.flatten_eos('turn_ids'))} AS input_ids FROM ch"))
oracle("report_sink", ORACLE["system_report"])

# --- remaining inventory items ----------------------------------------------------
oracle("thread_pairs_title", TS.thread_pairs_sql(use_title=True, **THREAD))
oracle("bleu_sentence_mean", S.ctes(MS.base(**_EV) + MS.bleu_ctes() + [
    ("sb", "SELECT system, key, " + ", ".join(MS._bleu_expr("", digits=None)) + " FROM stats")],
    "SELECT system, " + ", ".join(f"round(avg(bleu{k}), 6) AS bleu{k}" for k in range(1, 5)) + " FROM sb GROUP BY system"))
oracle("kth_count", S.ctes(_SENT, "SELECT cnt AS threshold FROM freq ORDER BY cnt DESC, trigram LIMIT 1 OFFSET 100"))
oracle("ngram_entropy_head", MS.entropy_head_sql(50))
oracle("digest_targets", f"SELECT conv_id, turn, sha256({S.gpt_norm(S.minimal_norm('text'))}) AS hash FROM conversations")
_next = " + ".join(f"{_W[e]} * ((conv_id * {i + 1} + turn * 7) % 100) / 100.0" for i, e in enumerate(_EMO))
oracle("refined_rows", S.ctes(_SENT + [("tags", ORACLE_BLAND), ("ws", """
    SELECT s.conv_id, s.turn, list(CASE WHEN t.tag = '' THEN '1.0 ' ELSE '0.0 ' END || s.sentence ORDER BY s.pos) AS w
    FROM sent s JOIN tags t USING (conv_id, turn, pos) GROUP BY s.conv_id, s.turn""")], f"""
    SELECT w.conv_id, w.turn, array_to_string(w.w[1:len(w.w) - 2], ' EOS ') AS source, w.w[len(w.w) - 1] AS target, w.w[len(w.w)] AS next_state, r.reward
    FROM ws w JOIN (SELECT conv_id, turn - 2 AS turn, round(CAST({_next} AS DOUBLE), 6) + 0.0 AS reward FROM conversations WHERE turn >= 2) r
      ON r.conv_id = w.conv_id AND r.turn = w.turn"""))
oracle("hyp_scan", S.ctes([("hy", A["hypotheses"])], f"""
    SELECT system, row_number() OVER (PARTITION BY system ORDER BY line_no) - 1 AS line_no, key, {S.minimal_norm('hyp')} AS hyp FROM hy"""))
