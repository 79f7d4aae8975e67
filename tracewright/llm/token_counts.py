"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of all pieces finds, in one pass over a word, every piece that ends at
each character.  Dynamic programming carries the best score and the piece count of each prefix
and no path, as only the count is asked for.  The rules are those of the tokenizers library's Unigram model:
scores are added in double precision; a later candidate wins only if it is strictly better, and
candidates come by their start, so that of equals the longest last piece wins; a character that no
one-character piece covers may stand alone at the least score less 10; unknown characters that
follow one another are one token, or one token for each of their bytes with byte fallback.

A text becomes "▁" and itself with blanks as "▁".  If no piece holds "▁" after
another character, no piece goes over the start of a word, and the count of a text is the sum of its words'
counts; each distinct word is then worked out once in a task, in a cache of bounded size.  With
other vocabularies the whole text is one word.

The public vocabularies have no unigram model; the production parameter takes the pieces and
scores of the public sentencepiece file as one.

Defined results: null and empty texts have 0 tokens; an empty table gives no rows; repeated rows
are alike; a text of any length is counted whole, by one task; a column named like the result is
replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns

MARK = "▁"


@dataclass(frozen=True)
class UnigramParams:
    """``model`` is a sentencepiece file whose pieces and scores are used; empty: the public one.
    ``cache_words`` bounds the words that a task keeps."""

    model: str = ""
    byte_fallback: bool = True
    cache_words: int = 400_000


def read_pieces(model: str = "") -> list[tuple[str, float]]:
    """Pieces and scores in id order; the piece 0 is the unknown one."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]


class Counter:
    """Counts for one vocabulary in one task."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, cache_words: int) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        names = {p for p, _ in pieces}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.cache: dict[str, int] = {}
        self.cache_words = cache_words

    def viterbi(self, s: str) -> int:
        """Number of tokens of the best segmentation of ``s``."""
        best, count, gap = [0.0], [0], [False]  # by prefix; gap: its last token is unknown
        top, c, single = None, 0, False

        def close() -> None:
            """Settle the next prefix; an unknown character is its last candidate."""
            nonlocal top, c, single
            e, g = len(best), False
            if not single:
                v = best[e - 1] + self.unknown
                if top is None or v > top:
                    c = count[e - 1] + (len(s[e - 1].encode()) if self.bytes else int(not gap[e - 1]))
                    top, g = v, True
            best.append(top)
            count.append(c)
            gap.append(g)
            top, c, single = None, 0, False

        for end, (length, score) in self.auto.iter(s):  # by end; of one end the longest first
            while len(best) <= end:
                close()
            if length == 1:
                single = True
            v = best[end + 1 - length] + score
            if top is None or v > top:
                top, c = v, count[end + 1 - length] + 1
        while len(best) <= len(s):
            close()
        return count[len(s)]

    def text(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.viterbi(MARK + text.replace(" ", MARK))
        total, cache = 0, self.cache
        run = 1  # blanks before the next word, the first mark included
        for word in text.replace(MARK, " ").split(" "):
            if not word:
                run += 1
                continue
            word = MARK * run + word
            got = cache.get(word)
            if got is None:
                if len(cache) >= self.cache_words:
                    cache.clear()
                got = cache[word] = self.viterbi(word)
            total += got
            run = 1
        return total + (self.viterbi(MARK * (run - 1)) if run > 1 else 0)


def count_tokens(documents: DataFrame, params: UnigramParams = UnigramParams(), text_col: str = "text", out_col: str = "n_tokens", drop_text: bool = False) -> DataFrame:
    """Append the number of tokens of each whole text; no shuffle."""

    def make():
        counter = Counter(read_pieces(params.model), params.byte_fallback, params.cache_words)
        return lambda texts: [np.array([counter.text(t or "") for t in texts.to_pylist()], np.int64)]

    return append_columns(documents, text_col, [T.StructField(out_col, T.LongType())], make, drop_text)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, drop_text=True).select("doc_id", F.col("n_tokens"))
