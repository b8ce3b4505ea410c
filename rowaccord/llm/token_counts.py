"""Token counts of a unigram tokenizer without building its tokens.

For every word an Aho-Corasick automaton enumerates the vocabulary pieces that end at each place, and a
dynamic programme carries only the best score and the number of pieces so far. The rules are those of the
public unigram tokenizers (``tokenizers`` with a ``Metaspace`` pre-tokenizer): the text's first word and every
space become the word mark, the sum of scores in double precision is maximal, among equal sums the longer last
piece wins, a character without a piece of its own costs ten below the lowest score, and such a character counts
as its UTF-8 bytes where the vocabulary holds byte pieces, otherwise neighbouring ones count together as one.

Words repeat, so each task remembers the counts of words it has seen; the memory has a bound and is
emptied when full, which costs time only.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from .common import by_batch, id_and_text

MARK = "▁"
#: Fixed value of the public tokenizers: what an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    """A vocabulary: scores by piece, and whether unknown characters fall back to byte pieces."""

    path: str

    def pieces(self) -> tuple[list[tuple[str, float]], bool]:
        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = range(model.get_piece_size())
        special = [i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        hidden = set(special)
        own = [(model.id_to_piece(i), model.get_score(i)) for i in n if i not in hidden]
        return own, sum(model.is_byte(i) for i in special) == 256


class Counter(dict):
    """Counts by word, filled on first use. Keys are words as they stand between spaces.

    Where no piece holds a line end, a line's first word has a key of its own that begins with one.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool, remember: int = 1_000_000):
        super().__init__()
        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.characters = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.remember = byte_fallback, remember
        self.by_line = byte_fallback and not any("\n" in p for p, _ in vocabulary)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.remember:
            self.clear()
        n = self.count(word[1:] if self.by_line and word[:1] == "\n" else MARK + word)
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of one marked word."""
        size = len(text)
        if self.characters.issuperset(text):
            # Matches come by their end, the longest first: of equal sums the first one stays.
            sums, counts = [0.0] + [-math.inf] * size, [0] * (size + 1)
            for last, (length, value) in self.trie.iter(text):
                start, end = last + 1 - length, last + 1
                if sums[start] + value > sums[end]:
                    sums[end], counts[end] = sums[start] + value, counts[start] + 1
            return counts[size]
        return self._with_unknown(text, size)

    def _with_unknown(self, text: str, size: int) -> int:
        score, pieces = [0.0] * (size + 1), [0] * (size + 1)
        unknown_before = [False] * (size + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.trie.iter(text):
            ends[end].append(match)
        for end in range(size):
            best, start_of = None, -1
            for length, value in ends[end]:
                start = end + 1 - length
                s = score[start] + value
                if best is None or s > best or s == best and start < start_of:
                    best, start_of = s, start
            by_unknown = False
            if text[end] not in self.characters:
                s = score[end] + self.unknown
                if best is None or s > best:
                    best, start_of, by_unknown = s, end, True
            score[end + 1] = best
            if not by_unknown:
                pieces[end + 1] = pieces[start_of] + 1
            elif self.byte_fallback:
                pieces[end + 1] = pieces[end] + len(text[end].encode())
            else:
                pieces[end + 1] = pieces[end] + (not unknown_before[end])
            unknown_before[end + 1] = by_unknown
        return pieces[size]

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        # The mark replaces each space, and the first word gets one unless the text begins with a space.
        words = (text[1:] if text[0] == " " else text).split(" ")
        if self.by_line and "\n" in text:
            # A line end is one byte piece, and no piece goes across it.
            n = text.count("\n")
            words = (text[1:] if text[0] == " " else text).replace("\n", " \n").split(" ")
            return n + sum(map(self.__getitem__, words))
        return sum(map(self.__getitem__, words))


@functools.lru_cache(maxsize=4)
def counter(vocabulary: Unigram) -> Counter:
    return Counter(*vocabulary.pieces())


def token_counts(docs: DataFrame, vocabulary: Unigram, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_chars, n_tokens) per document, over whole texts, without a shuffle.

    Null and empty texts have 0 tokens. Null ids, repeated rows and other columns do not matter; an empty
    table gives no rows. The vocabulary's file must have the same path on every machine.
    """

    def count(batch: dict[str, list]) -> dict[str, list]:
        c = counter(vocabulary)
        texts = batch["text"]
        return {"id": batch["id"], "n": [len(t or "") for t in texts], "t": [c.of_text(t) for t in texts]}

    df = id_and_text(docs, id_col, text_col)
    out = by_batch(df, count, f"id {df.schema['id'].dataType.simpleString()}, n_chars bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
