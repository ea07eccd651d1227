"""DuckDB oracle for the thread-extraction queries (unrolled joins, the
same rule as the Spark plan, written independently in SQL)."""

from __future__ import annotations

from convkit.plans import sqlfrag as S
from convkit.sources.adapters import SQL as A
from convkit.sources.adapters import sql_repeated


def base_ctes(dep_keys: bool = False, repeats: bool = False) -> list[tuple[str, str]]:
    """``repeats``: the dumps that repeat ids; the last line of an id wins."""
    last = " QUALIFY row_number() OVER (PARTITION BY month, {} ORDER BY line_no DESC) = 1" if repeats else "{:.0}"
    out = [
        ("comments", sql_repeated("comments", "body") if repeats else A["comments"]),
        ("submissions", sql_repeated("submissions", "title") if repeats else A["submissions"]),
        ("subs", f"SELECT * REPLACE ({S.minimal_norm('title')} AS title), 't3_' || id AS sid "
                 f"FROM submissions WHERE num_comments >= 2" + last.format("id")),
        ("keys", "SELECT link_id, 't1_' || id AS comment_id FROM comments "
                 "WHERE CAST(substr(link_id, 4) AS BIGINT) % 5 <> 0"),
    ]
    dep = ("AND EXISTS (SELECT 1 FROM keys k WHERE k.link_id = c.link_id AND k.comment_id = 't1_' || c.id)"
           if dep_keys else "")
    out += [
        ("adm0", f"""SELECT c.month, c.link_id, c.parent_id, 't1_' || c.id AS name, c.score, {"c.line_no" if repeats else "0"} AS line_no,
                            CAST(length(c.body) AS INTEGER) AS n_char, {S.minimal_norm('c.body')} AS body
                     FROM comments c
                     WHERE c.body <> '[deleted]' AND strpos(c.body, '>') = 0 AND strpos(c.body, '&gt;') = 0
                       AND EXISTS (SELECT 1 FROM subs s WHERE s.month = c.month AND s.sid = c.link_id) {dep}"""),
        ("adm", f"SELECT * FROM adm0 WHERE {S.n_words('body')} >= 2" + last.format("name")),
    ]
    return out


def chain_ctes(cand: str, max_depth: int, max_len: int) -> list[tuple[str, str]]:
    out = [
        ("nodes", f"SELECT month, link_id, name, parent_id, body, {S.n_words('body')} <= {max_len} AS ok FROM adm"),
        ("l1", f"""SELECT c.*, CASE WHEN n.ok THEN [c.body] ELSE []::VARCHAR[] END AS turns,
                          CASE WHEN n.ok THEN c.parent_id END AS top_parent, n.ok AS open
                   FROM {cand} c JOIN nodes n ON n.month = c.month AND n.link_id = c.link_id AND n.name = c.name"""),
    ]
    for k in range(2, max_depth + 1):
        out.append((f"l{k}", f"""
            SELECT l.* EXCLUDE (turns, top_parent, open),
                   CASE WHEN p.name IS NOT NULL AND p.ok THEN list_concat([p.body], l.turns) ELSE l.turns END AS turns,
                   CASE WHEN p.name IS NOT NULL AND p.ok THEN p.parent_id ELSE l.top_parent END AS top_parent,
                   coalesce(p.name IS NOT NULL AND p.ok, false) AS open
            FROM l{k-1} l LEFT JOIN nodes p
              ON l.open AND starts_with(l.top_parent, 't1_') AND p.month = l.month
             AND p.link_id = l.link_id AND p.name = l.top_parent"""))
    return out


def instances_ctes(max_len: int = 100, max_depth: int = 5, min_depth: int = 2, min_score: int = 1,
                   keep_keys: bool = False, leaves_only: bool = False, block_subs: bool = False,
                   discard: bool = False, clean: bool = True, use_title: bool = False, repeats: bool = False,
                   block_words: list[str] | None = None) -> list[tuple[str, str]]:
    """CTEs ending in ``inst``: month, sid, pid, cid, subreddit, domain,
    skip_reason, context, response (use_title = 0)."""
    defs = base_ctes(dep_keys=keep_keys, repeats=repeats)
    conds = []
    if keep_keys:
        conds.append("EXISTS (SELECT 1 FROM keys k WHERE k.link_id = c.link_id AND k.comment_id = c.name)")
    if leaves_only:
        conds.append("NOT EXISTS (SELECT 1 FROM adm a WHERE a.month = c.month AND a.link_id = c.link_id "
                     "AND a.parent_id = c.name)")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    block = ("WHEN subreddit = '' THEN 'missing' WHEN subreddit IN ('src3', 'src7') THEN 'bad_subreddit'"
             if block_subs else "")
    defs.append(("meta", f"""
        SELECT c.*, coalesce(lower(split_part(s.permalink, '/', 3)), '') AS subreddit,
               coalesce(lower(s.domain), '') AS domain
        FROM adm c LEFT JOIN subs s ON s.month = c.month AND s.sid = c.link_id {where}"""))
    defs.append(("meta2", f"""SELECT *, CASE {block} WHEN coalesce(score, 0) < {min_score} THEN 'low_score' END
                                     AS reason0 FROM meta"""))
    defs.append(("cand", "SELECT * FROM meta2 WHERE reason0 IS NULL"))
    defs += chain_ctes("cand", max_depth, max_len)
    chain = f"l{max_depth}"
    if use_title:
        defs.append(("titled0", f"""SELECT l.*, s.title AS stitle, s.sid IS NOT NULL AS has_sub,
                                          coalesce(starts_with(l.top_parent, 't3_'), false) AS at_root
                                   FROM {chain} l LEFT JOIN subs s ON s.month = l.month AND s.sid = l.link_id"""))
        defs.append(("titled", """SELECT * REPLACE (CASE WHEN at_root AND has_sub THEN list_concat(['title: ' || stitle], turns)
                                                         ELSE turns END AS turns),
                                         CASE WHEN at_root AND NOT has_sub THEN 'exception' END AS reason_t
                                  FROM titled0"""))
        chain = "titled"
    rt = "reason_t, " if use_title else ""
    defs.append(("normed", f"""SELECT month, link_id AS sid, parent_id AS pid, name AS cid, subreddit, domain,
                                     coalesce({rt}CASE WHEN len(turns) < {min_depth} THEN 'min_depth' END) AS reason1,
                                     list_transform(turns, lambda t: {S.gpt_norm('t')}) AS turns
                              FROM {chain}"""))
    src = "normed"
    if leaves_only and clean:
        disc = "FALSE"
        if discard:
            defs.append(("discard", f"""SELECT DISTINCT sha256({S.gpt_norm(S.minimal_norm('text'))}) AS h
                                        FROM conversations WHERE (conv_id + turn) % 13 = 0"""))
            disc = "d.h IS NOT NULL"
        defs.append(("tx", """SELECT n.cid, i, n.turns[i] AS t FROM normed n,
                               LATERAL (SELECT unnest(range(1, len(n.turns) + 1)) AS i)"""))
        dj = "LEFT JOIN discard d ON d.h = sha256(x.t)" if discard else ""
        defs.append(("tw", f"""SELECT x.cid, list(CASE WHEN {disc} THEN '0.0 ' ELSE '1.0 ' END || x.t ORDER BY x.i)
                                      AS wturns FROM tx x {dj} GROUP BY x.cid"""))
        defs.append(("weighted", """SELECT n.* REPLACE (coalesce(w.wturns, []::VARCHAR[]) AS turns)
                                    FROM normed n LEFT JOIN tw w ON w.cid = n.cid"""))
        src = "weighted"
    defs.append(("pairs", f"""SELECT *, array_to_string(turns[1:len(turns) - 1], ' EOS ') AS context,
                                     turns[len(turns)] AS response FROM {src}"""))
    defs.append(("toks", f"SELECT *, {S.words('context')} AS st, {S.words('coalesce(response, ' + chr(39) * 2 + ')')} AS tt FROM pairs"))
    pf6 = f"({S.skip_reason('context', 'coalesce(response, ' + chr(39) * 2 + ')', 'st', 'tt')})" if clean else "NULL"
    if block_words and not leaves_only:
        hit = S.block_match("coalesce(response, '')", block_words)
        pf6 = f"CASE WHEN {hit} THEN 'offensive' ELSE {pf6} END"
    defs.append(("inst", f"""
        SELECT month, sid, pid, cid, subreddit, domain, coalesce(reason1, {pf6}) AS skip_reason, context, response
        FROM toks
        UNION ALL
        SELECT month, link_id, parent_id, name, subreddit, domain, reason0, NULL, NULL FROM meta2
        WHERE reason0 IS NOT NULL"""))
    return defs


def thread_pairs_sql(**kw) -> str:
    return S.ctes(instances_ctes(**kw),
                  "SELECT month, sid, pid, cid, context, response FROM inst WHERE skip_reason IS NULL")
