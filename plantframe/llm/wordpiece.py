"""Token counts by a linear longest-match automaton: the pieces of a word are counted, never built.

A trie node knows where the match goes on when no child fits (its failure link) and how many tokens are certain by
then (its popped tokens). So each character is read once, and longest matches are never tried again from their start.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LONG_WORD, vocabulary
from .pretokens import pretokens
from .tries import Trie
from .words import pieces, text_bytes

DEAD = -1
COUNTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


class Pieces:
    """Automaton of a vocabulary. Tokens that begin with ``marker`` continue a word, the others begin one; with an
    empty marker every token does both. A word that cannot be cut counts as one unknown token."""

    def __init__(self, tokens: Iterable[bytes], marker: bytes = b""):
        tokens = list(tokens)
        if marker:
            # continuing tokens hang below a node of their own, reached by a byte that no text holds
            self.trie = Trie({(b"\xff" + t[len(marker) :] if t.startswith(marker) else t): i for i, t in enumerate(tokens) if t != marker})
        else:
            self.trie = Trie({t: i for i, t in enumerate(tokens)})
        children, token = self.trie.children, self.trie.token
        if marker and 0xFF not in children:  # nothing continues a word
            token = self.trie.token = np.append(token, -1)
        self.on = children.get(0xFF, len(token) - 1) if marker else 0
        self.marked = bool(marker)
        self.fail = np.full(len(token), DEAD, np.int64)
        self.pops = np.zeros(len(token), np.int64)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, child in children.items():
            if not (marker and key == 0xFF):
                below.setdefault(key >> 8, []).append((key & 0xFF, child))
        queue = [0] if self.on == 0 else [0, self.on]
        fail, pops = self.fail.tolist(), self.pops.tolist()
        for node in queue:
            for byte, child in below.get(node, ()):
                queue.append(child)
                if token[child] >= 0:
                    fail[child], pops[child] = self.on, 1
                    continue
                at, popped = fail[node], pops[node]
                while at != DEAD and (at << 8 | byte) not in children:
                    popped, at = popped + pops[at], fail[at]
                if at != DEAD:
                    fail[child], pops[child] = children[at << 8 | byte], popped
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def count_one(self, word: bytes) -> int:
        """Pieces of one word."""
        node, n, children = 0, 0, self.trie.children
        for byte in word:
            while (child := children.get(node << 8 | byte)) is None or self.marked and byte == 0xFF:
                if self.fail[node] == DEAD:
                    return 1
                n, node = n + int(self.pops[node]), int(self.fail[node])
            node = child
        while node not in (0, self.on):
            if self.fail[node] == DEAD:
                return 1
            n, node = n + int(self.pops[node]), int(self.fail[node])
        return n

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[offsets[i]:offsets[i + 1]]``, all words a step at a time."""
        size = np.diff(offsets)
        out = np.zeros(len(size), np.int64)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = self.count_one(data[offsets[i] : offsets[i + 1]].tobytes())
        word = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        at, stop, node = offsets[word], offsets[word + 1], np.zeros(len(word), np.int64)
        while len(word):
            more = at < stop
            child = np.full(len(word), -1, np.int64)
            child[more] = self.trie.child(node[more] << 8 | data[at[more]])
            down = child >= 0
            stuck = ~down & (self.fail[node] == DEAD)
            out[word] += np.where(down | stuck, 0, self.pops[node])
            out[word[stuck]] = 1
            node = np.where(down, child, self.fail[node])
            at = at + down
            keep = ~stuck & ((at < stop) | (node != self.on))
            word, at, stop, node = word[keep], at[keep], stop[keep], node[keep]
        return out


@cache
def automaton(path: str) -> Pieces:
    return Pieces(vocabulary(path).tokens)


def token_counts(text: Column, path: str) -> Column:
    """Struct of ``n_words`` (pre-tokens) and ``n_tokens`` (their greedy longest-match pieces) of a text.

    ``path`` is a tokenizers file of kind byte-level BPE, whose tokens are the pieces; every single byte is one, so no
    word is unknown. Null counts as empty: no words, no tokens.
    """

    @F.arrow_udf(COUNTS)
    def of(texts: pa.Array) -> pa.Array:
        found = automaton(path)
        data, offsets = text_bytes(texts)
        values, rows = [], []
        for low, high in pieces(offsets):
            words, number = pretokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            values.append(words)
            rows.append(np.diff(number))
        n_words = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        coded = pa.chunked_array(values, pa.binary()).dictionary_encode().unify_dictionaries()
        total = np.zeros(1, np.int64)
        if len(coded):
            length = found.counts(*text_bytes(coded.chunk(0).dictionary.view(pa.string())))
            total = np.append(0, np.cumsum(np.concatenate([length[c.indices.to_numpy()] for c in coded.chunks])))
        ends = total[np.append(0, np.cumsum(n_words))]
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(np.diff(ends), pa.int64())], ["n_words", "n_tokens"])

    return of(text)
