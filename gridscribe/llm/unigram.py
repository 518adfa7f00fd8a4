"""Token counts of a unigram tokenizer: Aho-Corasick finds the pieces, a count-only Viterbi adds them up."""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import appending, chunks, table

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words that a worker remembers within a partition; beyond it the memory starts anew.
REMEMBERED = 400_000


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, log probability) from a public piece list; the first entry is the unknown piece.

    The public files hold no unigram model, so the pieces of a SentencePiece file get Zipf's probabilities by their rank in the
    file: a fixed rule, nothing is trained. Control and byte pieces take no part.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    norm = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [("<unk>", 0.0), *((p, -math.log(i + 1) - norm) for i, p in enumerate(pieces))]


class Counter:
    """Counts the pieces of the best segmentation of each word.

    Tie rules of the tokenizers library: starts are tried in ascending order and a later one must be strictly better, so of
    equal scores the longest last piece stays; a character without a piece of its own may be unknown at 10 below the lowest
    score, tried last; adjoining unknown pieces are one. Words begin at spaces, which count as U+2581 before the word.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        n = len(word)
        best, count, was_unknown = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        at = 0  # ends up to here are settled

        def settle(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if not single[at]:
                    score = best[at - 1] + self.unknown
                    if best[at] is None or score > best[at]:
                        best[at], was_unknown[at] = score, True
                        count[at] = count[at - 1] + (not was_unknown[at - 1])

        single = [False] * (n + 1)
        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            settle(end - 1)
            if size == 1:
                single[end] = True
            start = end - size
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end], was_unknown[end] = score, count[start] + 1, False
        settle(n)
        return count[n]

    def count_texts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out, known = [], self.known
        for text in texts:
            if not text:
                out.append(0)
                continue
            text = text.replace(" ", SPACE)
            words = text.split(SPACE)
            if text[0] == SPACE:
                words = words[1:]
            for w in set(words).difference(known):
                known[w] = self.count_word(SPACE + w)
            out.append(sum(map(known.__getitem__, words)))
        return out


@lru_cache(maxsize=2)
def counter(path: str | None) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with _n_tokens (long), of whole texts. Null and empty texts have none.

    Each row by itself, without a shuffle; ties, repeated rows and empty tables need nothing special, and a very long text is a slice of its own. Further columns stay; a column
    named like the result is replaced. A worker holds one batch and a bounded memory of words.
    """
    docs = docs.drop("_n_tokens")

    def run(batches):
        c = counter(path)
        try:
            for batch in batches:
                for part in chunks(batch, text_col):
                    n = pa.array(np.array(c.count_texts(part.column(text_col).to_pylist()), np.int64))
                    yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, "_n_tokens"])
        finally:
            c.known = {}

    return appending(docs, run, "_n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "_n_tokens").withColumnRenamed("_n_tokens", "n_tokens")
