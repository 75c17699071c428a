"""Keys of the binary Golay code (23, 12, 7) for words that may differ in two bits.

Every 23-bit word lies within three bits of exactly one code word. The keys of a word are the indices of all code
words within four bits of it: one if the nearest is at most two bits away, six if it is three bits away. Words that
differ in at most two bits share a key: the word halfway between them has a code word within three bits, which is
within four of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

# fixed values: the code's length and its generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECK_BITS, GENERATOR = 23, 11, 0xAE3
RADIUS, MOST_KEYS = 4, 6


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << bit - CHECK_BITS), rest)
    return rest


def _errors() -> np.ndarray:
    """For each syndrome the error patterns of up to four bits that lead to a code word, padded with -1."""
    table = np.full((1 << CHECK_BITS, MOST_KEYS), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(RADIUS + 1):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)
        for pattern, s in zip(patterns, syndrome(patterns)):
            table[s, filled[s]] = pattern
            filled[s] += 1
    return table


ERRORS = _errors()


def code_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the code words within four bits of each word, one row each, padded with -1."""
    errors = ERRORS[syndrome(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> CHECK_BITS)
