"""Pre-tokens of byte-level BPE over whole Arrow batches.

They are the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+, found by the
classes of neighbouring characters of all texts at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

# fixed values: the contractions that the pattern splits off
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


@cache
def _splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


_KINDS = np.full(0x110000, EDGE, np.uint8)


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point. It is asked of the library once for each: versions of Unicode differ."""
    kind = _KINDS[points]
    if (kind == EDGE).any():
        joined = lambda text: len(_splitter().pre_tokenize_str(text)) == 1
        for point in np.unique(points[kind == EDGE]).tolist():
            c = chr(point)
            _KINDS[point] = LETTER if joined("a" + c) else NUMBER if joined("1" + c) else OTHER if joined("!" + c) else SPACE
        kind = _KINDS[points]
    return kind


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens begin. Rows are the spans of ``offsets``; none crosses a row."""
    if len(data) == 0:
        return np.zeros(0, np.int64)
    if data.max() < 0x80:
        at, points = None, data
    else:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        offsets = np.searchsorted(at, offsets)
    kind = classes(points)
    n = len(kind)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    row, end = row[:-1], row[1:]  # first and last character of a row
    begin = row.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space, blank = kind == SPACE, points == 0x20
    # the last of several spaces before something else stands alone, and a single blank joins what follows
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~row[1:]
    begin |= before
    joins = np.zeros(n, bool)
    joins[1:] = before[:-1] & blank[:-1]
    begin &= ~joins
    # contractions begin at an apostrophe where a pre-token begins
    marks = np.flatnonzero((points == 0x27) & begin & ~end)
    if len(marks):
        padded = np.append(points, [0, 0])
        one = np.isin(padded[marks + 1], [ord(c) for c in ONE_LETTER])
        inside = marks[~end[marks + 1]] if len(marks) else marks
        two = np.zeros(len(inside), bool)
        for pair in TWO_LETTERS:
            two |= (padded[inside + 1] == ord(pair[0])) & (padded[inside + 2] == ord(pair[1]))
        for found, length in ((marks[one], 2), (inside[two], 3)):
            begin[found + 1] = False
            begin[np.minimum(found + length, n - 1)] |= found + length < n
    found = np.flatnonzero(begin)
    return found if at is None else at[found]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All pre-tokens as binary values, and the number of them before each row and at the end."""
    first = starts(data, offsets)
    at = np.append(first, len(data)).astype(np.int32)
    values = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    return values, np.searchsorted(first, offsets)
