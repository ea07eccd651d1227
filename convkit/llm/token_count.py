"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

Aho-Corasick lists the vocabulary pieces that end at each character; the
dynamic programme keeps, per character, the best score and the number of
pieces on the path that has it. Ties follow the ``tokenizers`` library:
a path replaces another only if its score is strictly higher, and longer
last pieces are tried first. A character that is no piece by itself may be
unknown, for ten less than the lowest score; unknown characters count their
UTF-8 bytes under byte fallback (if all byte pieces exist), else one per run.

White space is marked as the library's Metaspace does: blanks become U+2581,
one is put in front unless there is one, and a word starts at each mark.

Defined results: null and empty texts have 0 tokens; rows are counted one by
one, so ties, repeats and null ids each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from convkit.llm.pretokens import per_process

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000       # memory bound of a worker's word cache
CACHE_CHARS = 40            # longer words are counted but not kept


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order of a sentencepiece model file."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size())]


class Counter(dict):
    """Pieces of a word (without its mark), counted on first use."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        import ahocorasick
        scores = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, s in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in scores for b in range(256))

    def __missing__(self, word: str) -> int:
        n = self.pieces(MARK + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def pieces(self, s: str) -> int:
        best, count, unknown_last = [0.0], [0], [False]
        matches = self.automaton.iter(s) if len(self.automaton) else iter(())
        ahead = next(matches, None)
        for end in range(1, len(s) + 1):
            top, n, single = -math.inf, 0, False
            while ahead is not None and ahead[0] == end - 1:        # longest first
                size, score = ahead[1]
                v = score + best[end - size]
                if v > top:
                    top, n = v, count[end - size] + 1
                single = single or size == 1
                ahead = next(matches, None)
            unknown = False
            if not single and self.unknown + best[end - 1] > top:
                top, unknown = self.unknown + best[end - 1], True
                if self.bytes:
                    n = count[end - 1] + len(s[end - 1].encode())
                else:
                    n = count[end - 1] + (not unknown_last[end - 1])
            best.append(top)
            count.append(n)
            unknown_last.append(unknown)
        return count[-1]

    def text(self, s: str | None) -> int:
        if not s:
            return 0
        words = s.replace(MARK, " ").split(" ")
        if words[0] == "":          # the text starts with a mark of its own
            del words[0]
        return sum(map(self.__getitem__, words))


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_tokens``. Map-only. The broadcast
    is the vocabulary, whose size doesn't depend on the corpus."""
    kept = [c for c in docs.columns if c not in (text, "n_tokens")]
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [f for f in docs.schema.fields if f.name in kept]

    def run(batches):
        counter = per_process(("unigram", hash(tuple(vocab.value))), lambda: Counter(vocab.value))
        for batch in batches:
            n = pa.array([counter.text(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], n],
                                             names=[*kept, "n_tokens"])

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
