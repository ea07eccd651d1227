"""Hand-computed micro-fixtures for the string functions."""

from pyspark.sql import functions as F

from convkit.functions import text as T


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_minimal_norm(spark):
    assert run(spark, T.minimal_norm, ["a\tb\nc\rd\\e", "b\\/c"]) == ["a b c de", "b/c"]


def test_gpt_norm_quirks(spark):
    out = run(spark, T.gpt_norm, [
        "#tag keep this",
        "see(http://x.y now",
        "b\\/c j/k w/o w/ friends",
        "URL and MENTION stay reserved",
        "he said \u201chi\u201d ok",
        "caf\u00e9 costs 3.50 ... wow!!",
    ])
    assert out[0] == "keep this"
    assert out[1] == "see ( __url__ now"
    assert out[2] == "because just kidding without with friends"
    assert out[3] == "__url__ and __mention__ stay reserved"
    assert out[4] == "he said \u201c hi \u201d ok"
    assert out[5] == "caf costs 3.50 ... wow ! !"


def test_eval_clean(spark):
    """One input per rule: case, addresses, link brackets, kept signs, contractions, white space."""
    cases = {
        "Docs live at https://docs.example.net/v2?x=1 now": "docs live at __url__ now",
        "Start with [guide] ( http://guide.example.net ) today": "start with guide today",
        "WAIT, what; no: stop": "wait , what no : stop",
        "Price - 5 (five) dollars": "price 5 ( five ) dollars",
        "Shouldn't he've called? You'll know": "should n't he 've called ? you 'll know",
        "It won't start and she can't push": "it will n't start and she can n't push",
        "tabs\tand  gaps": "tabs and gaps",
    }
    assert run(spark, T.eval_clean, list(cases)) == list(cases.values())


def test_unescape_and_quotes(spark):
    assert run(spark, T.unescape_line, ['say \\"hi\\"!', "it\\'s", "a\\\\b", '\\"\n']) == \
        ['say ""hi""!', "it's", "ab", '"\n']
    assert run(spark, T.straight_quotes, ["\u201cx\u201d"]) == ['"x"']


def test_ws_norm_unicode(spark):
    # NBSP and other Unicode spaces split like Python's str.split()
    assert run(spark, T.ws_norm, ["  a\u00a0 b\u2003c  "]) == ["a b c"]
    assert run(spark, lambda c: T.ws_norm(c, collapse=False), ["  a  b \n"]) == ["a  b"]
    assert run(spark, lambda c: F.size(T.words(c)), ["", "   "]) == [0, 0]


def test_subreddit_of(spark):
    assert run(spark, T.subreddit_of, ["/r/AskX/comments/abc", "bad"]) == ["askx", ""]


def test_detokenise(spark):
    pieces = F.split(F.col("s"), " ")
    out = run(spark, lambda c: T.detokenise(F.split(c, " ")),
              ["<s> \u2581hello \u2581world \u2581! \u2581ok </s>"])
    assert out == ["hello world! ok"]


def test_strip_punct(spark):
    out = run(spark, lambda c: F.array_join(T.strip_punct(F.split(c, " ")), " "), ["a , b -LRB- c ... d ;"])
    assert out == ["a b c d"]


def test_split_turns(spark):
    assert run(spark, lambda c: F.size(T.split_turns(c)), ["", "a", "a EOS b"]) == [0, 1, 2]
