"""Words and pre-tokens of whole Arrow batches: positions in one byte buffer, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; a longer single text is taken whole.
PIECE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes together, or a single row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Parts of a string array that hold at most ``limit`` bytes of text each, or a single text; one part at least."""
    _, offsets = text_bytes(texts)
    for low, high in pieces(offsets, limit) if len(texts) else [(0, 0)]:
        yield texts.slice(low, high - low)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a range of rows, optionally with A-Z in lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[:-1][offsets[:-1] < len(data)]
        first[rows] = inside[rows]
        starts = np.flatnonzero(first)
        self.chars = data[inside]
        of_byte = np.cumsum(first)[inside] - 1
        self.lengths = np.bincount(of_byte, minlength=len(starts)).astype(np.int64)
        self.of_byte = of_byte
        #: words before each row; the last is their number
        self.rows = np.searchsorted(starts, offsets)

    def __len__(self) -> int:
        return len(self.lengths)

    def array(self) -> pa.StringArray:
        at = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.lengths, out=at[1:])
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(self.chars)))

    def spaced(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins and ends."""
        out = np.full(len(self.chars) + len(self), 0x20, np.uint8)
        out[np.arange(len(self.chars)) + self.of_byte] = self.chars
        ends = np.cumsum(self.lengths) + np.arange(len(self))
        return out.tobytes(), ends - self.lengths, ends
