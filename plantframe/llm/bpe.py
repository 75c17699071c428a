"""Byte-level BPE by speculation: greedy longest matches, checked pair by pair, merged exactly only where they fail.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are what BPE makes of their joint
bytes. The check of two neighbours undoes merges from the latest on and looks for an earlier merge across the border.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pretokens import pretokens
from .tries import Lookup, Trie
from .words import pieces, slices, text_bytes

#: Bytes of text that are encoded at once.
PART_BYTES = 8 << 20
#: Ids that are put together as bytes at once when decoding.
DECODE_IDS = 1 << 20
#: Words of more bytes are merged one by one, each in time n log n.
LONG_WORD = 64


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = byte_characters()
        self.tokens = {bytes(byte[c] for c in text): number for text, number in spec["model"]["vocab"].items()}
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if spec["normalizer"] is not None or any(t[f] for t in spec["added_tokens"] for f in flags):
            raise ValueError("normalizers and added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        encoded = lambda text: self.tokens[bytes(byte[c] for c in text)]
        left, right = (np.array([encoded(p[i]) for p in pairs], np.int64) for i in (0, 1))
        made = np.array([encoded(p[0] + p[1]) for p in pairs], np.int64)
        if (np.diff(made) <= 0).any() or (made <= np.maximum(left, right)).any():
            raise ValueError("token ids must be in the order of the merges")
        self.width = int(max(max(self.tokens.values()), max(self.special.values(), default=0))) + 1
        self.merge = Lookup(left * self.width + right, made)
        self.merges = dict(zip((left * self.width + right).tolist(), made.tolist()))
        #: parts of each token; single bytes are their own
        self.left, self.right = np.arange(self.width), np.arange(self.width)
        self.left[made], self.right[made] = left, right
        self.trie = Trie(self.tokens)
        of = {number: text for text, number in self.tokens.items()} | {n: t.encode() for t, n in self.special.items()}
        self.bytes = pa.array([of.get(i, b"") for i in range(self.width)], pa.binary())
        self.byte = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between each pair of tokens."""
        out = np.ones(len(first), bool)
        on = np.arange(len(first))
        one, two, limit = first.copy(), second.copy(), np.full(len(first), self.width + 1)
        while len(on):
            joined = self.merge(one * self.width + two)
            bad = (joined >= 0) & (joined < limit)
            out[on[bad]] = False
            # undo the later merge; if that token is a single byte, the other's
            by_one = one > two
            single_one, single_two = self.right[one] == one, self.left[two] == two
            undo_one = np.where(by_one, ~single_one, single_two & ~single_one)
            undo_two = np.where(by_one, single_one & ~single_two, ~single_two)
            limit = np.where(undo_one, one, np.where(undo_two, two + 1, limit))
            one, two = np.where(undo_one, self.right[one], one), np.where(undo_two, self.left[two], two)
            keep = ~bad & (undo_one | undo_two)
            on, one, two, limit = on[keep], one[keep], two[keep], limit[keep]
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact BPE of one word: the earliest merge first, leftmost first."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, width = self.merges.get, self.width
        heap = [(m, i) for i in range(len(ids) - 1) if (m := get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or get(ids[i] * width + ids[j]) != m:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (k := get(m * width + ids[after[j]])) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := get(ids[before[i]] * width + m)) is not None:
                heapq.heappush(heap, (k, before[i]))
        return [x for x in ids if x >= 0]

    def merged_all(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once, one merge of every word in each round: ids, and numbers of their words."""
        n = end - begin
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        ids = self.byte[data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        never = self.width + 1
        rank = np.full(len(ids), never)
        inner = np.flatnonzero(of[1:] == of[:-1])
        found = self.merge(ids[inner] * self.width + ids[inner + 1])
        rank[inner] = np.where(found >= 0, found, never)
        done_ids, done_of = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            still = np.repeat(least < never, size)
            done_ids.append(ids[~still])
            done_of.append(of[~still])
            spot = np.flatnonzero(still & (rank == np.repeat(least, size)))
            spot = spot[np.append(True, of[spot[1:]] != of[spot[:-1]])] if len(spot) else spot
            ids[spot] = rank[spot]
            still[spot + 1] = False
            place = np.cumsum(still) - 1
            ids, of, rank = ids[still], of[still], rank[still]
            # the pairs on both sides of each new token
            new = place[spot]
            near = np.concatenate([new, new[new > 0] - 1])
            last = near == len(ids) - 1
            after = np.where(last, near, near + 1)
            found = np.where(last | (of[near] != of[after]), -1, self.merge(ids[near] * self.width + ids[after]))
            rank[near] = np.where(found >= 0, found, never)
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def words(self, distinct: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and where each word's begin (and all end)."""
        data, offsets = text_bytes(distinct.view(pa.string()))
        n, size = len(distinct), np.diff(offsets)
        short, long = np.flatnonzero(size <= LONG_WORD), np.flatnonzero(size > LONG_WORD)
        ids, of = self.trie.longest(data, offsets[short], offsets[short + 1])
        border = np.flatnonzero(of[1:] == of[:-1])
        pair, where = np.unique(ids[border] * self.width + ids[border + 1], return_inverse=True)
        bad = ~self.fits(pair // self.width, pair % self.width)[where]
        fails = np.zeros(len(short), bool)
        fails[of[border[bad]]] = True
        failed, good = short[fails], ~fails[of]
        exact, exact_of = self.merged_all(data, offsets[failed], offsets[failed + 1])
        single = [np.array(self.merged(data[offsets[i] : offsets[i + 1]].tobytes()), np.int64) for i in long]
        ids = np.concatenate([ids[good], exact, *single])
        of = np.concatenate([short[of[good]], failed[exact_of], np.repeat(long, [len(x) for x in single])])
        lengths, ids = np.bincount(of, minlength=n), ids[np.argsort(of, kind="stable")]
        return ids, np.append(0, np.cumsum(lengths))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(texts: pa.Array, encode_words: Callable[[pa.BinaryArray], tuple[np.ndarray, np.ndarray]], special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other (int32), and where each text's begin (and all end).

    Texts fall into pre-tokens; ``encode_words`` gives the ids of the distinct ones of the batch.
    """
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    has = [pc.match_substring(texts, s) for s in special]
    if any(pc.any(h).as_py() for h in has):
        return _with_special(texts, encode_words, special)
    data, offsets = text_bytes(texts)
    values, counts = [], []
    for low, high in pieces(offsets):
        found, rows = pretokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        values.append(found)
        counts.append(np.diff(rows))
    words_of = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    coded = pa.chunked_array(values, pa.binary()).dictionary_encode().unify_dictionaries()
    if coded.num_chunks == 0 or len(coded) == 0:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    ids, begin = encode_words(coded.chunk(0).dictionary)
    ids, length, out = ids.astype(np.int32), np.diff(begin), []
    number = np.concatenate([np.zeros(1, np.int64), np.cumsum(words_of)])
    n_ids = [np.zeros(1, np.int64)]
    for chunk in coded.chunks:
        index = chunk.indices.to_numpy()
        n = length[index]
        ends = np.cumsum(n)
        out.append(ids[np.repeat(begin[index] - (ends - n), n) + np.arange(n.sum())])
        n_ids.append(n)
    total = np.cumsum(np.concatenate(n_ids))
    return np.concatenate(out), total[number]


def _with_special(texts: pa.Array, encode_words, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    import regex

    parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
    split = [parts.split(t) for t in texts.to_pylist()]
    plain = pa.array([x for s in split for x in s[::2]], pa.string())
    ids, at = encode_texts(plain, encode_words, {})
    out, lengths, k = [], [], 0
    for s in split:
        row = []
        for i, part in enumerate(s):
            if i % 2:
                row.append(np.array([special[part]], np.int32))
            else:
                row.append(ids[at[k] : at[k + 1]])
                k += 1
        out += row
        lengths.append(sum(map(len, row)))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.append(0, np.cumsum(lengths)).astype(np.int64)


def encode(text: Column, path: str) -> Column:
    """Token ids (array of int) of a text; special tokens' own strings give their ids. Null counts as empty: no ids.

    ``path`` is a tokenizers file of kind byte-level BPE that every executor can read.
    """

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        words, parts = vocabulary(path), []
        for part in slices(texts, PART_BYTES):
            ids, at = encode_texts(part, words.words, words.special)
            parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
        return pa.concat_arrays(parts)

    return of(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included. Bytes that are no UTF-8 become U+FFFD; null and unknown ids are
    left out; null gives the empty text."""

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        known = vocabulary(path)
        at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        flat = pc.list_flatten(rows)
        flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, known.width)), flat, None)
        out = []
        for low, high in pieces(at, DECODE_IDS):
            part = flat.slice(at[low], at[high] - at[low])
            taken = pc.fill_null(known.bytes.take(part), b"")
            data, offsets = text_bytes(taken.view(pa.string())) if len(taken) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            ends = offsets[at[low : high + 1] - at[low]].astype(np.int32)
            text = pa.StringArray.from_buffers(high - low, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
            try:
                text.validate(full=True)
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in text.view(pa.binary()).to_pylist()], pa.string())
            out.append(text)
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return of(ids)
