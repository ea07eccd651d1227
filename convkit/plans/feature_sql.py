"""DuckDB oracle for featurisation, batching and scoring queries."""

from __future__ import annotations

from convkit.plans import sqlfrag as S
from convkit.sources.adapters import SQL as A

UNROLL = """SELECT conv_id, turn, ctx, text AS response FROM (
    SELECT conv_id, turn, text, list(text) OVER (PARTITION BY conv_id ORDER BY turn
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ctx
    FROM conversations) WHERE len(ctx) > 0"""


def ints(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def flatten_eos(x: str) -> str:
    f = f"flatten(list_transform({x}, lambda a: list_concat(a, [2])))"
    return f"({f})[1:len({f}) - 1]"


def vocab_ctes() -> list[tuple[str, str]]:
    return [
        ("vocab", f"""SELECT row_number() OVER (ORDER BY cnt DESC, word) AS rank, word FROM (
                        SELECT w AS word, count(*) AS cnt FROM (
                          SELECT unnest({S.words('text')}) AS w FROM conversations WHERE conv_id % 10 NOT IN (0, 1)) GROUP BY w)"""),
        ("vid", "SELECT word, CAST(rank + 2 AS INTEGER) AS id FROM vocab"),
    ]


def encode_ctes(src: str) -> list[tuple[str, str]]:
    """``src`` has row_id, turns; ends in ``enc`` (row_id, turn_ids) joined back as ``feat``."""
    return [
        ("tx", f"SELECT row_id, ti, turns[ti] AS t FROM {src}, LATERAL (SELECT unnest(range(1, len(turns) + 1)) AS ti)"),
        ("wx", f"""SELECT row_id, ti, pos, ws[pos] AS word FROM (SELECT row_id, ti, {S.words('t')} AS ws FROM tx) x,
                   LATERAL (SELECT unnest(range(1, len(x.ws) + 1)) AS pos)"""),
        ("wid", "SELECT w.row_id, w.ti, list(coalesce(v.id, 1) ORDER BY w.pos) AS ids "
                "FROM wx w LEFT JOIN vid v ON v.word = w.word GROUP BY w.row_id, w.ti"),
        ("tids", "SELECT t.row_id, t.ti, coalesce(i.ids, []::INTEGER[]) AS ids FROM tx t LEFT JOIN wid i USING (row_id, ti)"),
        ("enc", "SELECT row_id, list(ids ORDER BY ti) AS turn_ids FROM tids GROUP BY row_id"),
        ("feat", f"SELECT s.*, e.turn_ids FROM {src} s JOIN enc e USING (row_id)"),
    ]


def feature_ctes() -> list[tuple[str, str]]:
    return vocab_ctes() + [
        ("u", UNROLL),
        ("src", """SELECT conv_id || '_' || turn AS row_id, conv_id, turn, list_concat(ctx, [response]) AS turns,
                          CAST((conv_id + turn) % 3 - 1 AS DOUBLE) AS reward FROM u"""),
    ] + encode_ctes("src")


def _eval_ctes(max_len: int = 128) -> list[tuple[str, str]]:
    return feature_ctes() + [
        ("ev0", f"SELECT row_id, {flatten_eos('turn_ids[1:len(turn_ids) - 1]')} AS c, turn_ids[len(turn_ids)] AS r FROM feat"),
        ("ev1", "SELECT *, len(c) + len(r) + 2 AS n FROM ev0"),
        ("ev2", f"""SELECT row_id,
                      CASE WHEN n > {max_len} AND len(c) > n - {max_len} THEN c[n - {max_len} + 1:len(c)] ELSE c END AS c2,
                      CASE WHEN n > {max_len} AND NOT (len(c) > n - {max_len}) THEN r[1:greatest({max_len} - len(c) - 2, 0)]
                           ELSE r END AS r2,
                      n > {max_len} AND NOT (len(c) > n - {max_len}) AND {max_len} - len(c) - 2 < 0 AS dropped
                    FROM ev1"""),
        ("ev", """SELECT row_id, list_concat(c2, [2], r2, [2]) AS ids,
                         list_concat(list_transform(range(len(c2)), lambda x: -1), r2, [2, -1]) AS labels,
                         len(c2) AS context_len, len(r2) AS response_len
                  FROM ev2 WHERE NOT dropped"""),
    ]


def eval_features_sql() -> str:
    return S.ctes(_eval_ctes(), f"""SELECT row_id, {ints('ids')} AS input_ids, {ints('range(len(ids))')} AS position_ids,
        {ints('list_transform(ids, lambda x: 0)')} AS token_type_ids, {ints('labels')} AS lm_labels,
        context_len, response_len FROM ev""")


def left_truncate_sql(k: int = 64) -> str:
    def lt(x):
        return f"CASE WHEN len({x}) > {k} THEN {x}[len({x}) - {k - 1}:len({x})] ELSE {x} END"
    return S.ctes(_eval_ctes(), f"SELECT row_id, {ints(lt('ids'))} AS input_ids, {ints(lt('labels'))} AS lm_labels FROM ev")


def encode_features_sql() -> str:
    return S.ctes(feature_ctes(), f"SELECT row_id, {ints(flatten_eos('turn_ids'))} AS input_ids, reward FROM feat")


def feature_len_guard_sql(max_len: int = 128) -> str:
    return S.ctes(feature_ctes() + [
        ("g", """SELECT row_id, len(ids) AS l,
                        coalesce(sum(len(ids) + 1) OVER (PARTITION BY row_id ORDER BY ti
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
                 FROM tids""")],
        f"SELECT row_id, CAST(max(l > {max_len} OR b > {max_len}) AS INTEGER) AS rejected FROM g GROUP BY row_id")


def guarded_sql(max_len: int = 128) -> str:
    return S.ctes(feature_ctes() + [
        ("g", """SELECT row_id, len(ids) AS l,
                        coalesce(sum(len(ids) + 1) OVER (PARTITION BY row_id ORDER BY ti
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
                 FROM tids"""),
        ("ok", f"SELECT row_id FROM g GROUP BY row_id HAVING max(l) <= {max_len} AND max(b) <= {max_len}")],
        f"SELECT row_id, {ints(flatten_eos('turn_ids'))} AS input_ids FROM feat JOIN ok USING (row_id)")


def weighted_epochs_sql(exponents=(1.0, 0.6, 0.19999999999999996, 0.0), batch: int = 8, bucket: int = 40) -> str:
    ep = ", ".join(f"({i}, CAST({x!r} AS DOUBLE))" for i, x in enumerate(exponents))
    return S.ctes([
        ("u", UNROLL),
        ("r0", """SELECT conv_id || '_' || turn AS row_id, CAST((conv_id + turn) % 3 - 1 AS DOUBLE) AS reward, length(response) AS len FROM u"""),
        ("ch", "SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS chunk_id FROM r0"),
        ("rn", "SELECT *, row_number() OVER (PARTITION BY chunk_id, reward ORDER BY row_id) - 1 AS n FROM ch"),
        ("cc", "SELECT chunk_id, reward, count(*) AS cnt FROM ch GROUP BY ALL"),
        ("w0", f"""SELECT e.epoch, c.chunk_id, c.reward, c.cnt, pow(1.0::DOUBLE / c.cnt, e.x) AS w
                   FROM cc c CROSS JOIN (VALUES {ep}) AS e(epoch, x)"""),
        ("w1", """SELECT *, sum(cnt * w) OVER (PARTITION BY epoch, chunk_id ORDER BY reward) AS hi FROM w0"""),
        ("w2", "SELECT *, hi - cnt * w AS lo, row_number() OVER (PARTITION BY epoch, chunk_id ORDER BY reward DESC) = 1 AS is_last FROM w1"),
        ("ns", "SELECT epoch, chunk_id, max(hi) AS total, CAST(round_even(max(hi) / min(w), 0) AS BIGINT) AS num FROM w1 GROUP BY ALL"),
        ("dr", """SELECT epoch, chunk_id, draw, CAST('0x' || substr(md5('42|' || epoch || '|' || chunk_id || '|' || draw), 1, 13) AS BIGINT)
                         / 4503599627370496.0 * total AS x
                  FROM ns, LATERAL (SELECT unnest(range(1, num + 1)) AS draw)"""),
        ("pk", """SELECT d.epoch, d.chunk_id, d.draw, arg_min(w.reward, w.reward) AS reward,
                         arg_min(greatest(least(CAST(floor((d.x - w.lo) / w.w) AS BIGINT), w.cnt - 1), 0), w.reward) AS n
                  FROM dr d JOIN w2 w ON w.epoch = d.epoch AND w.chunk_id = d.chunk_id AND (w.hi > d.x OR w.is_last)
                  GROUP BY ALL"""),
        ("dw", """SELECT p.epoch, p.chunk_id, p.draw, r.row_id, r.len FROM pk p
                  JOIN rn r ON r.chunk_id = p.chunk_id AND r.reward = p.reward AND r.n = p.n"""),
        ("b1", f"SELECT *, (draw - 1) // {bucket} AS bucket FROM dw"),
        ("b2", f"""SELECT *, (row_number() OVER (PARTITION BY epoch, chunk_id, bucket ORDER BY len DESC, draw) - 1) // {batch} AS batch_in_bucket
                   FROM b1"""),
        ("b3", "SELECT *, count(*) OVER (PARTITION BY epoch, chunk_id, bucket, batch_in_bucket) AS size FROM b2")],
        f"""SELECT epoch, chunk_id, draw, row_id, bucket, batch_in_bucket,
                   md5('42|' || epoch || '|' || chunk_id || '|' || bucket || '|' || batch_in_bucket) AS batch_key
            FROM b3 WHERE size = {batch}""")


def two_turn_sql() -> str:
    return S.ctes(feature_ctes(), "SELECT row_id, array_to_string(CASE WHEN len(turns) > 2 THEN "
                                  "turns[len(turns) - 1:len(turns)] ELSE turns END, ' EOS ') AS turns FROM feat")


def prompt_prefix_sql() -> str:
    return S.ctes(feature_ctes(), "SELECT row_id, array_to_string(turns[1:least(3, len(turns) - 1)], ' EOS ') AS prompt FROM feat")


def reverse_turns_sql() -> str:
    body = flatten_eos("list_reverse(turn_ids)")
    return S.ctes(feature_ctes(), f"""SELECT row_id, {ints(f"CASE WHEN turn % 2 = 0 OR len(turn_ids) = 1 "
                                                              f"THEN list_concat({body}, [2]) ELSE {body} END")} AS reversed
                                      FROM feat""")


def last_turn_labels_sql(rev: bool) -> str:
    seq = f"CASE WHEN turn % 2 = 0 THEN list_concat({flatten_eos('turn_ids')}, [2]) ELSE {flatten_eos('turn_ids')} END"
    if rev:
        start = "coalesce(list_position(a, 2), 0)"
    else:
        start = """CASE WHEN a[len(a)] = 2 THEN (CASE WHEN len(ep) >= 2 THEN ep[len(ep) - 1] ELSE 0 END)
                        ELSE coalesce(ep[len(ep)], 0) END"""
    return S.ctes(feature_ctes() + [
        ("sq", f"SELECT row_id, {seq} AS a FROM feat"),
        ("sq2", "SELECT row_id, a, list_filter(range(1, len(a) + 1), lambda i: a[i] = 2) AS ep FROM sq"),
        ("sq3", f"SELECT row_id, a, {start} AS st FROM sq2")],
        f"""SELECT row_id, {ints('a[1:len(a) - 1]')} AS inputs,
                   {ints("CASE WHEN st = 0 THEN a[2:len(a)] ELSE list_concat(list_transform(range(st - 1), lambda x: -1), a[st + 1:len(a)]) END")} AS labels
            FROM sq3""")


def batched_ctes(batch: int = 8) -> list[tuple[str, str]]:
    bucket = 100 * batch
    return feature_ctes() + [
        ("fl", f"SELECT row_id, {flatten_eos('turn_ids')} AS input_ids FROM feat"),
        ("b0", f"""SELECT row_id, input_ids, len(input_ids) AS len,
                          row_number() OVER (ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) - 1 AS i FROM fl"""),
        ("b1", f"SELECT *, i // {bucket} AS bucket FROM b0"),
        ("b2", f"""SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY len DESC, i) - 1) // {batch} AS batch_in_bucket
                   FROM b1"""),
        ("bb", """SELECT *, count(*) OVER (PARTITION BY bucket, batch_in_bucket) AS batch_rows,
                         md5('42|' || CAST(bucket AS VARCHAR) || '|' || CAST(batch_in_bucket AS VARCHAR)) AS batch_key,
                         bucket || '_' || batch_in_bucket AS batch_id
                  FROM b2"""),
    ]


def pad(x: str, mx: str, v: int) -> str:
    return f"list_concat({x}, list_transform(range({mx} - len({x})), lambda q: {v}))"


def chunk_ctes() -> list[tuple[str, str]]:
    return feature_ctes() + [("ch", "SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS chunk_id FROM feat")]


def sqls() -> dict[str, str]:
    out = {
        "encode_features": encode_features_sql(),
        "feature_len_guard": feature_len_guard_sql(),
        "eval_features": eval_features_sql(),
        "eval_features_windowed": eval_features_sql(),
        "guarded_features": guarded_sql(),
        "weighted_epochs": weighted_epochs_sql(),
        "left_truncate": left_truncate_sql(),
        "two_turn": two_turn_sql(),
        "prompt_prefix": prompt_prefix_sql(),
        "reverse_turns": reverse_turns_sql(),
        "last_turn_labels": last_turn_labels_sql(False),
        "last_turn_labels_rev": last_turn_labels_sql(True),
        "bucket_batches": S.ctes(batched_ctes(), "SELECT row_id, bucket, batch_in_bucket, batch_rows, batch_key FROM bb"),
        "pad_batches": S.ctes(batched_ctes() + [("mx", "SELECT *, max(len) OVER (PARTITION BY batch_id) AS mx FROM bb")],
                              f"SELECT row_id, batch_id, {ints(pad('input_ids', 'mx', 0))} AS input_ids, "
                              f"{ints(pad('input_ids', 'mx', -1))} AS labels FROM mx"),
        "strip_pad": S.ctes(batched_ctes(), f"SELECT row_id, {ints('list_concat(list_filter(input_ids, lambda x: x <> 0), [2])')} "
                                            "AS input_ids FROM bb"),
        "padding_ratio": S.ctes(batched_ctes(), "SELECT batch_id, sum(len) AS real_tokens, count(*) * max(len) AS padded_tokens "
                                                "FROM bb GROUP BY batch_id"),
        "batch_count": S.ctes(batched_ctes(), "SELECT sum(n) AS rows, sum(n // 8) AS batches FROM "
                                              "(SELECT bucket, count(*) AS n FROM bb GROUP BY bucket)"),
        "last_batches": S.ctes(batched_ctes(), "SELECT row_id, batch_id FROM bb WHERE batch_id IN (SELECT batch_id FROM "
                                               "(SELECT DISTINCT batch_id, bucket, batch_in_bucket FROM bb) ORDER BY bucket DESC, batch_in_bucket DESC LIMIT 30)"),
        "same_len_batches": S.ctes(feature_ctes() + [
            ("sl", f"SELECT row_id, len({flatten_eos('turn_ids[1:len(turn_ids) - 1]')}) AS ctx_len FROM feat")],
            "SELECT row_id, ctx_len, (row_number() OVER (PARTITION BY ctx_len ORDER BY row_id) - 1) // 4 AS batch_in_len FROM sl"),
        "chunk_ids": S.ctes(chunk_ctes(), "SELECT row_id, chunk_id FROM ch"),
        "rank_slice": S.ctes(chunk_ctes(), "SELECT row_id, chunk_id FROM ch WHERE chunk_id % 4 = 1"),
        "class_weights": S.ctes(chunk_ctes() + [
            ("cc", "SELECT chunk_id, reward, count(*) AS cnt, 1.0 / count(*) AS weight FROM ch GROUP BY ALL")],
            """SELECT c.chunk_id, c.reward, c.cnt, round(c.weight, 6) AS weight, p.num_samples FROM cc c JOIN (
                 SELECT chunk_id, CAST(round_even(sum(cnt * weight) / min(weight), 0) AS BIGINT) AS num_samples
                 FROM cc GROUP BY chunk_id) p USING (chunk_id)"""),
        "weighted_sample": S.ctes(chunk_ctes() + [
            ("cc", "SELECT chunk_id, reward, count(*) AS cnt, 1.0 / count(*) AS weight FROM ch GROUP BY ALL"),
            ("ns", "SELECT chunk_id, CAST(round_even(sum(cnt * weight) / min(weight), 0) AS BIGINT) AS num FROM cc GROUP BY chunk_id"),
            ("iv", """SELECT chunk_id, row_id, sum(weight) OVER (PARTITION BY chunk_id ORDER BY row_id) AS hi, weight
                      FROM ch JOIN cc USING (chunk_id, reward)"""),
            ("dr", """SELECT chunk_id, draw, CAST('0x' || substr(md5('42|' || chunk_id || '|' || draw), 1, 13) AS BIGINT) / 4503599627370496.0
                             * (SELECT max(hi) FROM iv WHERE iv.chunk_id = ns.chunk_id) AS u
                      FROM ns, LATERAL (SELECT unnest(range(1, num + 1)) AS draw)""")],
            "SELECT d.chunk_id, d.draw, (SELECT arg_max(row_id, row_id) FROM iv WHERE iv.chunk_id = d.chunk_id AND iv.hi - iv.weight <= d.u) AS row_id FROM dr d"),
        "concat_candidates": S.ctes(vocab_ctes() + [
            ("src", "SELECT conv_id || '_' || turn AS row_id, conv_id, turn, [text] AS turns FROM conversations")]
            + encode_ctes("src") + [("e", "SELECT conv_id, turn, turn_ids[1] AS ids FROM feat")],
            f"""SELECT c.conv_id, c.turn, {ints('list_concat(list_filter(x.ids, lambda q: q <> 0), [2], '
                                                'list_filter(c.ids, lambda q: q <> 0))')} AS input_ids
                FROM e c JOIN e x ON x.conv_id = c.conv_id AND x.turn = 0 WHERE c.turn > 0"""),
        "rerank_best": S.ctes([("c", A["candidates"]),
                               ("s", "SELECT context_id, cand_id, (0.5 - 1) * (0.5 * fwd_loss + 0.5 * rev_loss) "
                                     "+ 0.5 * q_value AS score FROM c")],
                              """SELECT context_id, list(cand_id ORDER BY score DESC, cand_id)[1] AS cand_id,
                                        round(max(score), 6) AS score FROM s GROUP BY context_id"""),
        "macro_f1": S.ctes(_f1_ctes(A["value_predictions"], ""), "SELECT round(macro_f1, 6) AS macro_f1, round(mae, 6) AS mae FROM f1"),
        "checkpoint_eval": S.ctes(_f1_ctes(
            "SELECT CAST(regexp_extract('GP2-pretrain-step-' || CAST(step * 1000 AS VARCHAR) || '.pkl', 'step-(\\d+)', 1) "
            f"AS BIGINT) AS step, pred, truth FROM ({A['value_predictions']})", "step"),
            "SELECT step, round(macro_f1, 6) AS macro_f1, round(mae, 6) AS mae FROM f1"),
        "checkpoint_report": S.ctes(_f1_ctes(
            "SELECT CAST(step * 1000 AS BIGINT) AS step, pred, truth FROM (" + A['value_predictions'] + ")", "step") + [
            ("tl", f"SELECT (batch_id % 5) * 1000 AS step, batch_id, seq_id, loss, label FROM ({A['token_losses']})"),
            ("sq", "SELECT step, batch_id, seq_id, sum(loss) AS s, count(*) AS n FROM tl WHERE label <> -1 GROUP BY ALL"),
            ("lp", "SELECT step, round(sum(s) / sum(n), 6) AS loss, round(exp(avg(s / n)), 6) AS ppl FROM sq GROUP BY step")],
            "SELECT coalesce(f1.step, lp.step) AS step, round(macro_f1, 6) AS macro_f1, round(mae, 6) AS mae, loss, ppl "
            "FROM f1 FULL JOIN lp ON f1.step = lp.step"),
        "corpus_ppl": S.ctes([("t", A["token_losses"]),
                              ("sq", "SELECT batch_id, seq_id, sum(loss) AS s, count(*) AS n FROM t WHERE label <> -1 GROUP BY ALL")],
                             "SELECT round(sum(s) / sum(n), 6) AS loss, round(exp(avg(s / n)), 6) AS ppl FROM sq"),
        "history_final": S.ctes([("m", f"""SELECT conv_id AS uid, turn AS ts, len({S.words('text')}) + 1 AS n_tokens
                                           FROM conversations WHERE text <> ''"""),
                                 ("r", """SELECT *, sum(n_tokens) OVER (PARTITION BY uid ORDER BY ts DESC) AS rs,
                                                 row_number() OVER (PARTITION BY uid ORDER BY ts DESC) AS ri FROM m""")],
                                """SELECT uid, min(ts) AS from_ts, count(*) AS n_kept, sum(n_tokens) AS tokens
                                   FROM r WHERE rs <= 64 OR ri = 1 GROUP BY uid
                                   UNION ALL SELECT conv_id, NULL, 0, 1 FROM conversations GROUP BY conv_id
                                   HAVING max(coalesce(text, '')) = ''"""),
        "history_window": S.ctes([("m", f"""SELECT conv_id AS uid, turn AS ts, len({S.words('text')}) + 1 AS n_tokens,
                                                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
                                            FROM conversations WHERE text <> ''"""),
                                  ("pr", """SELECT a.uid, a.ts, sum(b.n_tokens) OVER (PARTITION BY a.uid, a.ts ORDER BY b.i DESC) AS cum
                                            FROM m a JOIN m b ON a.uid = b.uid AND b.i BETWEEN a.i - 64 AND a.i""")],
                                 """SELECT uid, ts, greatest(count(*) FILTER (WHERE cum <= 64), 1) AS n_kept,
                                           coalesce(max(cum) FILTER (WHERE cum <= 64), min(cum)) AS tokens
                                    FROM pr GROUP BY uid, ts"""),
    }
    return out


def _f1_ctes(src: str, key: str) -> list[tuple[str, str]]:
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    cls = lambda v: f"CASE WHEN {v} < -1.0 / 3 THEN 1 WHEN {v} > 1.0 / 3 THEN 2 ELSE 0 END"
    j = f"USING ({key}, c)" if key else "USING (c)"
    return [
        ("d", f"SELECT {k}{cls('pred')} AS p, {cls('truth')} AS t, abs(pred - truth) AS ae FROM ({src})"),
        ("conf", f"SELECT {k}t, p, count(*) AS n FROM d GROUP BY ALL"),
        ("pc", f"SELECT {k}p AS c, sum(n) AS np FROM conf GROUP BY ALL"),
        ("tc", f"SELECT {k}t AS c, sum(n) AS nt FROM conf GROUP BY ALL"),
        ("tp", f"SELECT {k}t AS c, sum(n) AS tp FROM conf WHERE t = p GROUP BY ALL"),
        ("per", f"""SELECT {('coalesce(pc.' + key + ', tc.' + key + ') AS ' + key + ', ') if key else ''}
                           coalesce(pc.np, 0) AS np, coalesce(tc.nt, 0) AS nt,
                           coalesce((SELECT x.tp FROM tp x WHERE x.c = coalesce(pc.c, tc.c)
                                     {('AND x.' + key + ' = coalesce(pc.' + key + ', tc.' + key + ')') if key else ''}), 0) AS tp
                    FROM pc FULL JOIN tc {j}"""),
        ("pf", f"""SELECT {k}CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS pp, CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END AS rr
                   FROM per"""),
        ("f1", f"""SELECT {k}avg(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END) AS macro_f1,
                          (SELECT avg(ae) FROM d d2 {('WHERE d2.' + key + ' = pf.' + key) if key else ''}) AS mae
                   FROM pf {g}"""),
    ]
