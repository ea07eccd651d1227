"""String functions (F1-F11) as Column expressions.

All of them stay inside whole-stage codegen: no Python UDFs. Whitespace
handling follows Python's ``str.split()`` (Unicode whitespace, empties
dropped), hence the ``(?U)`` flag on every whitespace regex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
EOS = " EOS "                      # turn separator inside a context string
URL_TOKEN = "__url__"
MENTION_TOKEN = "__mention__"
# slang expansions, applied in this order
SLANG = [("b/c", "because"), ("j/k", "just kidding"), ("w/o", "without"), ("w/", "with")]
# characters kept by the training normaliser (everything else becomes a space)
GPT_KEEP_CLASS = "[^A-Za-z0-9()\\[\\]:,.!?'\u201c\u201d ]"
# characters kept by the evaluation normaliser
EVAL_KEEP_CLASS = "[^A-Za-z0-9():,.!?\"']"
# contractions split off by the evaluation normaliser
CONTRACTIONS = ["'s", "'m", "'re", "n't", "'ll", "'ve", "'d", "'em"]
# punctuation tokens removed before caption metrics
PUNCTUATIONS = ["''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-",
                ".", "?", "!", ",", ":", "-", "--", "...", ";"]
# ---------------------------------------------------------------------------

# Social-media style tokeniser used after normalisation: reserved tokens,
# dot runs, numbers with inner separators, words with an inner apostrophe or
# hyphen, otherwise one non-space character. (Our own rule; the original
# relies on an external tokeniser.) No look-around, so DuckDB can run it too.
TOKEN_PATTERN = r"__[a-z]+__|\.{2,}|[0-9]+(?:[.,:][0-9]+)+|[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*|\S"

_WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def words(col) -> Column:
    """Python ``str.split()``: Unicode whitespace, no empty tokens."""
    return F.filter(F.split(_c(col), _WS), lambda w: w != F.lit(""))


def n_words(col) -> Column:
    return F.regexp_count(_c(col), F.lit(r"(?U)\S+"))


def collapse_ws(col) -> Column:
    """``' '.join(s.split())``."""
    return F.array_join(words(col), " ")


def minimal_norm(col) -> Column:
    """drop backslashes; newline, CR and tab become spaces."""
    return F.translate(_c(col), "\n\r\t\\", "   ")


def tokenise(col, pattern: str = TOKEN_PATTERN) -> Column:
    """Regex tokeniser -> array<string>."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), 0)


# A tokeniser is a function from a text Column to an array<string> Column:
# built-in functions, or an Arrow-batched UDF around a library.
Tokeniser = Callable[[Column], Column]


def _cut_url(w: Column, lower_first: bool) -> Column:
    pos = F.locate("http", F.lower(w) if not lower_first else w)
    return F.when(pos > 0, F.concat(F.substring(w, F.lit(1), pos - 1), F.lit(" " + URL_TOKEN))).otherwise(w)


def gpt_norm(col, tokeniser: Tokeniser = tokenise) -> Column:
    """normaliser for training text."""
    ws = F.filter(words(col), lambda w: ~w.startswith("#"))
    txt = F.array_join(F.transform(ws, lambda w: F.trim(_cut_url(w, False))), " ")
    txt = F.translate(txt, "\\", "")
    for a, b in SLANG:
        txt = F.replace(txt, F.lit(a), F.lit(b))
    txt = F.replace(txt, F.lit(MENTION_TOKEN), F.lit("MENTION"))
    txt = F.replace(txt, F.lit(URL_TOKEN), F.lit("URL"))
    txt = F.regexp_replace(txt, GPT_KEEP_CLASS, " ")
    txt = F.replace(txt, F.lit("MENTION"), F.lit(MENTION_TOKEN))
    txt = F.replace(txt, F.lit("URL"), F.lit(URL_TOKEN))
    return F.array_join(tokeniser(txt), " ")


def eval_clean(col, tokeniser: Tokeniser = tokenise) -> Column:
    """normaliser applied to hypotheses and references before metrics."""
    ws = words(F.lower(_c(col)))
    txt = F.array_join(F.transform(ws, lambda w: F.trim(_cut_url(w, True))), " ")
    # markdown link "[x] ( __url__ )" -> x
    txt = F.regexp_replace(txt, r"\[([^\]]*)\] \( *__url__ *\)", "$1")
    txt = F.replace(txt, F.lit(URL_TOKEN), F.lit("URL"))
    txt = F.regexp_replace(txt, EVAL_KEEP_CLASS, " ")
    txt = F.replace(txt, F.lit("URL"), F.lit(URL_TOKEN))
    txt = F.concat(F.lit(" "), F.array_join(tokeniser(F.lower(txt)), " "), F.lit(" "))
    txt = F.replace(txt, F.lit(" won't "), F.lit(" will n't "))
    txt = F.replace(txt, F.lit(" can't "), F.lit(" can n't "))
    for a in CONTRACTIONS:
        txt = F.replace(txt, F.lit(a + " "), F.lit(" " + a + " "))
    return collapse_ws(txt)


def unescape_line(col) -> Column:
    """backslashes before a quote -> doubled quote (unless a newline
    follows); before an apostrophe removed; every other backslash removed."""
    s = F.regexp_replace(_c(col), r'\\+"([^\n])', '""$1')
    s = F.regexp_replace(s, r"\\+'", "'")
    return F.regexp_replace(s, r"\\", "")


def straight_quotes(col) -> Column:
    """curly double quotes -> straight."""
    return F.translate(_c(col), "\u201c\u201d", '""')


def ws_norm(col, collapse: bool = True) -> Column:
    """strip + collapse whitespace, or strip only."""
    if collapse:
        return collapse_ws(col)
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def subreddit_of(permalink) -> Column:
    """third path part of the permalink, lower-cased ('' if absent)."""
    return F.lower(F.coalesce(F.get(F.split(_c(permalink), "/"), 2), F.lit("")))


def detokenise(pieces, specials=("<unk>", "<s>", "</s>")) -> Column:
    """F8: join sub-word pieces; the piece marker becomes a space, no space
    before ! . ? , ; special tokens dropped; first character dropped."""
    def fix(p):
        p = F.replace(p, F.lit("\u2581"), F.lit(" "))
        for ch in ["!", ".", "?", ","]:
            p = F.replace(p, F.lit(" " + ch), F.lit(ch))
        for sp in specials:
            p = F.replace(p, F.lit(sp), F.lit(""))
        return p
    s = F.array_join(F.transform(_c(pieces), fix), "")
    return F.substring(s, 2, 1 << 30)


def strip_punct(tokens) -> Column:
    """drop punctuation tokens."""
    bad = F.array(*[F.lit(p) for p in PUNCTUATIONS])
    return F.filter(_c(tokens), lambda t: ~F.array_contains(bad, t))


def split_turns(col) -> Column:
    """' EOS ' separated string -> array of turns ('' -> [])."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, EOS))


def join_turns(col) -> Column:
    return F.array_join(_c(col), EOS)
