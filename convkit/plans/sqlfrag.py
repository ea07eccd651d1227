"""DuckDB SQL fragments mirroring the Column functions, used to write the
oracle queries. Each helper takes a SQL expression string and returns one.
"""

from __future__ import annotations

from convkit.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def collapse(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def minimal_norm(x: str) -> str:
    return f"replace(replace(replace(replace({x}, chr(92), ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"


def tokenise(x: str, pattern: str = T.TOKEN_PATTERN) -> str:
    return f"regexp_extract_all({x}, {q(pattern)})"


def _cut_url(w: str, lw: str) -> str:
    return (f"trim(CASE WHEN strpos({lw}, 'http') > 0 THEN substr({w}, 1, strpos({lw}, 'http') - 1) "
            f"|| ' __url__' ELSE {w} END)")


def gpt_norm(x: str) -> str:
    t = (f"array_to_string(list_transform(list_filter({words(x)}, lambda w: NOT starts_with(w, '#')), "
         f"lambda w: {_cut_url('w', 'lower(w)')}), ' ')")
    t = f"replace({t}, chr(92), '')"
    for a, b in T.SLANG:
        t = f"replace({t}, {q(a)}, {q(b)})"
    t = f"replace(replace({t}, '__mention__', 'MENTION'), '__url__', 'URL')"
    t = f"regexp_replace({t}, {q(T.GPT_KEEP_CLASS)}, ' ', 'g')"
    t = f"replace(replace({t}, 'MENTION', '__mention__'), 'URL', '__url__')"
    return f"array_to_string({tokenise(t)}, ' ')"


def eval_clean(x: str, pattern: str = T.TOKEN_PATTERN) -> str:
    t = f"array_to_string(list_transform({words(f'lower({x})')}, lambda w: {_cut_url('w', 'w')}), ' ')"
    t = f"regexp_replace({t}, {q(r'\[([^\]]*)\] \( *__url__ *\)')}, '\\1', 'g')"
    t = f"replace({t}, '__url__', 'URL')"
    t = f"regexp_replace({t}, {q(T.EVAL_KEEP_CLASS)}, ' ', 'g')"
    t = f"replace({t}, 'URL', '__url__')"
    t = f"' ' || array_to_string({tokenise(f'lower({t})', pattern)}, ' ') || ' '"
    t = f"replace({t}, ' won''t ', ' will n''t ')"
    t = f"replace({t}, ' can''t ', ' can n''t ')"
    for a in T.CONTRACTIONS:
        t = f"replace({t}, {q(a + ' ')}, {q(' ' + a + ' ')})"
    return collapse(t)


def block_match(x: str, phrases: list[str]) -> str:
    """Whole-phrase, any-case containment: phrases are literal and stand
    between characters that are no letters, digits or underscores."""
    quoted = "|".join("".join(ch if ch.isalnum() or ch in " _" else "\\" + ch for ch in p.lower()) for p in phrases)
    return f"regexp_matches(lower({x}), {q('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + quoted + ')([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')})"


def skip_reason(src: str, tgt: str, st: str, tt: str) -> str:
    """PF6 given precomputed word lists ``st`` / ``tt`` (column names)."""
    srctgt = f"({src} || ' ' || {tgt})"
    return f"""CASE
      WHEN len({tt}) <= 1 THEN 'emptytarget'
      WHEN len(list_filter({tt}, lambda w: length(w) > 30)) > 0 THEN 'longword'
      WHEN len({st}) + len({tt}) > 200 THEN 'toolong'
      WHEN strpos({srctgt}, '__url__') > 0 THEN 'url'
      WHEN regexp_matches({srctgt}, '[\\[\\]\\(\\)]') THEN 'tags'
      WHEN regexp_matches({srctgt}, '[A-Z]{{5,}}') THEN 'allcaps'
      WHEN len({tt}) >= 3 AND len(list_filter(range(3, len({tt}) + 1),
           lambda i: {tt}[i - 2] = {tt}[i] AND {tt}[i - 1] = {tt}[i])) > 0 THEN 'repetitions'
      END"""


def ctes(defs: list[tuple[str, str]], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in defs) + "\n" + body
