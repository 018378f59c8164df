"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi.

An Aho-Corasick automaton lists, for every place of a word, the vocabulary pieces that end
there. Dynamic programming keeps two numbers per place: the best score of a path to it and
the number of tokens on that path. Ties follow the tokenizer: candidates for a place come in
order of their start, and a later one replaces an earlier only if its score is higher, so the
longest last piece wins. A character that no single piece covers is an unknown, at the lowest
score less a penalty of 10; a run of unknowns is one token, or with byte fallback one token per byte.

Words are the runs between white space, each with the word mark in front. Counts of distinct
words are kept in a bounded cache of the worker, since a text's count is the sum over its words.

Edge cases: a null or empty text has 0 tokens; repeated rows are counted each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .text import map_rows, pieces, whole_texts

MARK = "▁"
#: How far below the lowest score an unknown character lies (fixed by the tokenizer).
UNKNOWN = 10.0
CACHE = 300_000


class Counter:
    """Token and unknown counts of words for a vocabulary [(piece, score)]."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool) -> None:
        self._pieces = ahocorasick.Automaton()
        known = {}
        for piece, score in vocabulary:
            known[piece] = float(score)  # the last of equal pieces counts, as in the tokenizer
        for piece, score in known.items():
            if piece:
                self._pieces.add_word(piece, (len(piece), score))
        self._pieces.make_automaton()
        self._unknown = min(known.values(), default=0.0) - UNKNOWN
        self._bytes = byte_fallback and {b for b in range(256) if f"<0x{b:02X}>" in known}
        self._cache: dict[bytes, tuple[int, int]] = {}

    def word(self, text: str) -> tuple[int, int]:
        """(tokens, unknown characters) on the best path over a text."""
        size = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, found in self._pieces.iter(text):
            ending[last + 1].append(found)
        # Per place: score, tokens, unknown characters, and where the run of unknowns that ends here began.
        best: list[tuple[float, int, int, int]] = [(0.0, 0, 0, 0)]
        for at in range(1, size + 1):
            top, new, single = None, None, False
            for length, score in ending[at]:  # the automaton lists the longest, so the earliest start, first
                single = single or length == 1
                before = best[at - length]
                value = score + before[0]
                if top is None or value > top:
                    top, new = value, (value, before[1] + 1, before[2], at)
            if not single:
                before = best[at - 1]
                value = self._unknown + before[0]
                if top is None or value > top:
                    begun = before[3]  # the place where the run began: at - 1 if none was open
                    added = self._run(text[begun:at]) - (self._run(text[begun:at - 1]) if begun < at - 1 else 0)
                    new = (value, before[1] + added, before[2] + 1, begun)
            best.append(new)
        return best[size][1], best[size][2]

    def _run(self, unknown: str) -> int:
        """Tokens of a run of unknown characters."""
        data = unknown.encode()
        return len(data) if self._bytes and self._bytes.issuperset(data) else 1

    def text(self, text: bytes) -> tuple[int, int]:
        """(tokens, unknown characters) of a whole text."""
        tokens = unknown = 0
        cache = self._cache
        for piece in pieces(text):
            for word in piece.split():
                found = cache.get(word)
                if found is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    found = cache[word] = self.word(MARK + word.decode())
                tokens += found[0]
                unknown += found[1]
        return tokens, unknown


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(path: str, byte_fallback: bool) -> Counter:
    """One counter per worker and file."""
    return Counter(read_vocabulary(path), byte_fallback)


def token_counts(docs: DataFrame, path: str, byte_fallback: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_unknown (characters outside the vocabulary)."""

    def per_batch(rows: list[dict]) -> list[dict]:
        count = counter(path, byte_fallback).text
        return [dict(zip(("doc_id", "n_tokens", "n_unknown"), (r["doc_id"], *count(r["text"])))) for r in rows]

    return map_rows(whole_texts(docs), per_batch, "doc_id long, n_tokens long, n_unknown long")
