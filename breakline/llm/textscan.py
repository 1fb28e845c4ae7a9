"""Words of many texts at once, with numpy over Arrow's own bytes.

A block is a run of texts of bounded size. Word bounds come from a table of word bytes; the 64-bit
hash of a word is the difference of a running polynomial, finished by a mixer, so equal words of
different texts and blocks have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Freed batches go back to the system: a worker lives on through other stages.
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes and texts of a block; a single longer text makes a block of its own.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 2048
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher; x is uint64 and is not changed."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    key = hex(base)
    if len(_POWERS.get(key, ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        _POWERS[key] = np.multiply.accumulate(made)
    return _POWERS[key][:n]


def word_bytes(gaps: bytes | None = None) -> np.ndarray:
    """Table of word bytes: all but `gaps`; without `gaps`, ASCII letters, digits and all above 127."""
    table = np.ones(256, bool)
    if gaps is None:
        table[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        table[list(gaps)] = False
    return table


#: White space of the class [\x20\x09-\x0D].
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """`first[d]:first[d + 1]` are the words of text d; start and stop are byte positions in `data`."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the first n bytes of every word that is longer."""
        long = np.flatnonzero(self.stop - self.start > n)
        start = self.start[long]
        code = (self.total[start + n] - self.total[start]) * powers(_INVERSE, len(self.data) + 1)[start]
        return mix(code + np.uint64(n)), self.text[long]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, kinds: np.ndarray | None = None) -> Words:
    """data: the UTF-8 bytes of the texts one after another; offsets: len(texts) + 1 from 0.

    A word also ends between bytes of different kinds, for kinds that are not 0.
    """
    low = _LOWER[data]
    inside = table[low]
    joined = inside[1:] & inside[:-1]  # both sides of a place inside a word
    if kinds is not None:
        kind = kinds[low]
        joined &= (kind[1:] == kind[:-1]) | (kind[1:] == 0) | (kind[:-1] == 0)
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    joined[heads[1:] - 1] = False
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~joined
    end[:-1] &= ~joined
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[low] * powers(_BASE, len(data)), out=total[1:])
    code = (total[stop] - total[start]) * powers(_INVERSE, len(data) + 1)[start]
    return Words(low, start, stop, mix(code), np.searchsorted(start, offsets), total)


def lists(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    """The lists of a list column in the rows' `order`, as views of its own memory; null is empty."""
    out = []
    for chunk in column.chunks:
        flat, cuts = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [out[i] for i in order]


def blocks(text: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most `most` bytes or of one text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), row + BLOCK_TEXTS, n)
        yield row, stop, everything[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop
