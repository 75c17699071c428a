"""Look-up tables and byte tries that are walked by many words at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """A fixed map from whole numbers to numbers, looked up for whole arrays; missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.most = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(np.asarray(keys, np.int64))
        while len(left):
            free = self.keys[slot[left]] == -1
            _, one = np.unique(slot[left][free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.most

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], -1)
        on = np.flatnonzero((seen != keys) & (seen != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & self.most
            seen = self.keys[slot[on]]
            hit = seen == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (seen != -1)]
        return out


class Trie:
    """Byte trie of tokens. Node 0 is the root; ``token[node]`` is the id that ends there or -1."""

    def __init__(self, tokens: dict[bytes, int]):
        children: dict[int, int] = {}
        token = [-1]
        for text, number in tokens.items():
            node = 0
            for byte in text:
                child = children.get(node << 8 | byte)
                if child is None:
                    child = children[node << 8 | byte] = len(token)
                    token.append(-1)
                node = child
            token[node] = number
        self.children = children
        self.token = np.array(token, np.int64)
        self.child = Lookup(np.fromiter(children.keys(), np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)))

    def longest(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of words ``data[begin:end]``: all ids in order, and the words they belong to."""
        word = np.flatnonzero(end > begin)
        at = begin[word].copy()
        stop, node = end[word], np.zeros(len(word), np.int64)
        best, best_at = np.full(len(word), -1, np.int64), at.copy()
        of, ids = [], []
        while len(word):
            more = at < stop
            child = np.full(len(word), -1, np.int64)
            child[more] = self.child(node[more] << 8 | data[at[more]])
            down = child >= 0
            node = np.where(down, child, 0)
            at = at + down
            known = np.where(down, self.token[node], -1)
            hit = known >= 0
            best, best_at = np.where(hit, known, best), np.where(hit, at, best_at)
            dead = ~down
            if dead.any():
                if (best[dead] < 0).any():
                    raise ValueError("the vocabulary lacks a single byte")
                of.append(word[dead])
                ids.append(best[dead])
                at = np.where(dead, best_at, at)
                best = np.where(dead, -1, best)
                keep = ~dead | (at < stop)
                word, at, stop, node, best, best_at = (x[keep] for x in (word, at, stop, node, best, best_at))
        if not of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, ids = np.concatenate(of), np.concatenate(ids)
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]
