"""Words of ASCII-folded texts as spans of bytes, found with array operations, in pieces of bounded size.

A word is a run of digits, ASCII letters and bytes beyond ASCII; every other byte separates. As no
byte of a character beyond ASCII is below 0x80, runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20

# Byte classes of the pattern [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, and the folding of A-Z.
IN_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IN_WORD[_low : _high + 1] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
# For bytes.translate: folded words, each separator a space.
TO_WORDS = bytes(int(FOLD[b]) if IN_WORD[b] else 0x20 for b in range(256))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, folded, and the offsets of its rows; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def pieces(data: np.ndarray, bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """Cuts of the rows: (first row, begin, end and bounds of the rows in the piece), none cutting a word.

    A piece holds whole rows up to ``size`` bytes, or part of one longer row, which ends where a word does.
    """
    row, n = 0, len(bounds) - 1
    while row < n:
        last = int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1
        if last > row:
            last = min(last, n)
            yield row, int(bounds[row]), bounds[row : last + 1]
            row = last
            continue
        at, end = int(bounds[row]), int(bounds[row + 1])
        while at < end:
            cut = min(at + size, end)
            while cut < end:
                gap = np.flatnonzero(~IN_WORD[data[cut : min(cut + size, end)]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(cut + size, end)
            yield row, at, np.array([at, cut])
            at = cut
        row += 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word between the bounds, and the row (from 0) that holds it."""
    low, high = int(bounds[0]), int(bounds[-1])
    inside = IN_WORD[data[low:high]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1] - low
    edges = edges[(edges > 0) & (edges < high - low)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(bounds, begins + low, side="right") - 1
    return begins + low, ends + low, row
