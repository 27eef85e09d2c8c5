"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over word-initial pieces, joined with a trie over
inner pieces.  Each state has a failure link (where the match goes on once the
longest pieces of the prefix read so far are popped) and the number of pieces
popped on that way, so a word's count comes from one pass over its characters
and no piece is built.

Words are runs of letters, digits and underscores, and single other characters
(combining marks among them), as lower-cased.  A word that no pieces cover is
one unknown token.  Null and empty texts have no words, very long ones are read
whole.  Repeated rows each get their row.  An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

WORD = re.compile(r"\w+|[^\w\s]")
#: How the piece vocabulary marks a word's beginning (a fixed value of the file).
WORD_MARK = "▁"
#: Words whose counts a task keeps, and the longest word that is kept.
CACHE_WORDS, CACHE_LETTERS = 300_000, 64


class Automaton:
    """States are numbers; 0 is a word's beginning, 1 the beginning of an inner piece."""

    def __init__(self, initial: set[str], inner: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][c]
                ends[at] = True
        # Breadth first, so that links of shorter prefixes are known.
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for at in queue:
            for c, to in self.next[at].items():
                queue.append(to)
                if ends[to]:
                    # The whole prefix is a piece: pop it and begin an inner piece.
                    self.link[to], self.popped[to] = 1, 1
                    continue
                back, pops = self.link[at], self.popped[at]
                while back >= 0 and c not in self.next[back]:
                    pops += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[to], self.popped[to] = self.next[back][c], pops

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match, or 0 if there is none."""
        step, link, popped = self.next, self.link, self.popped
        at, n = 0, 0
        for c in word:
            while c not in step[at]:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = step[at][c]
        # What is left must be popped whole.
        while at != 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 0
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """The automaton of a piece vocabulary: marked pieces begin words, the others are inner."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Automaton({p[1:] for p in pieces if p[0] == WORD_MARK and len(p) > 1}, {p for p in pieces if WORD_MARK not in p})


def count_tokens(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: n_words, n_tokens (an unknown word is one) and n_unknown."""
    path = path or tokens.vocabulary("piece_bpe_32k.model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, cache = automaton(path).count, {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text.lower()) if text else []
                total = unknown = 0
                for w in words:
                    n = cache.get(w)
                    if n is None:
                        n = match(w)
                        if len(w) <= CACHE_LETTERS:
                            if len(cache) >= CACHE_WORDS:
                                cache.clear()
                            cache[w] = n
                    if n:
                        total += n
                    else:
                        unknown += 1
                rows.append((len(words), total + unknown, unknown))
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
