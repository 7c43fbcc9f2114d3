"""Token counts by a linear longest-match automaton (operator 7).

A trie of the vocabulary has a failure link at each node, and the number of
tokens that are popped on following it. A word's greedy longest-match length is
then one pass over its bytes; pieces are never built, and no byte is read twice.

A word is a run of bytes outside space and U+0009 to U+000D, with a space before
it, as the vocabulary's word-initial pieces have it. A word that the vocabulary
can't spell is one (unknown) token.

Defined results: null and empty texts have 0 words and 0 tokens; rows are
independent; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import codec, vocabulary_path
from .common import bounded_batches

#: Words whose lengths a worker keeps; a full table is emptied.
KNOWN_WORDS = 1_000_000
KNOWN_LENGTH = 64


class LongestMatch:
    """The automaton of a vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for b in piece:
                nxt = step[at].get(b)
                if nxt is None:
                    nxt = step[at][b] = len(step)
                    step.append({})
                    whole.append(False)
                at = nxt
            whole[at] = bool(piece)
        #: node -> node after popping, -1 if nothing can be popped; tokens popped
        fail, pops = [-1] * len(step), [0] * len(step)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in step[u].items():
                    below.append(v)
                    if whole[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in step[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = step[z][b], n
            level = below
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Greedy pieces of ``word``, 1 if it can't be spelt."""
        step, fail, pops = self.step, self.fail, self.pops
        at = n = 0
        for b in word:
            nxt = step[at].get(b)
            while nxt is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = step[at].get(b)
            at = nxt
        while at:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


class WordLengths(dict):
    """Length of each word in tokens, worked out when first asked for."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def word_lengths(path: str) -> WordLengths:
    return WordLengths(LongestMatch(codec(path).pieces))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens) of every whole text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = word_lengths(path)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                found = (text.as_py() or b"").split()
                n_words.append(len(found))
                n_tokens.append(sum(map(lengths.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [id_col, "n_words", "n_tokens"])

    bounded_batches(df.sparkSession)
    picked = df.select(id_col, df[text_col].cast("string").cast("binary").alias("text"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(picked.dtypes)[id_col]}, n_words bigint, n_tokens bigint")
