"""CIGAR and MD strings of many alignments at once, as prefix sums with numpy.

`Operations` holds the operations of a batch one after another, with running sums of what they use of the
reference, of the read and of MD. A place is looked up by one binary search in such a sum, so time and
memory go by operations and places asked for, not by bases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Where a reference base has no read base: deleted, skipped.
DELETED, SKIPPED = -1, -2


def _mask(kinds: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(kinds)] = True
    return out


_DIGIT, _LETTER = _mask(b"0123456789"), _mask(bytes([*range(65, 91), *range(97, 123)]))
# Fixed values of the format: what an operation uses.
_REFERENCE, _READ, _MD, _BASES = _mask(b"MDN=X"), _mask(b"MIS=X"), _mask(b"MD=X"), _mask(b"M=X")


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, offsets - offsets[0]


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _weights(data: np.ndarray, ends: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """What each digit is worth in its number; `ends`: the places, in order, that no number goes beyond."""
    at = np.flatnonzero(digit)
    out = np.zeros(len(data), np.int64)
    out[at] = (data[at] - 48).astype(np.int64) * 10 ** (ends[np.searchsorted(ends, at, side="right")] - at - 1)
    return out


class Operations:
    """`first[i]:first[i + 1]` are the operations of alignment i: `length` and `kind` (a byte)."""

    def __init__(self, cigars: pa.Array):
        data, offsets = _text(cigars)
        is_op = ~_DIGIT[data] & (data != 42)
        at = np.flatnonzero(is_op)
        worth = _sums(_weights(data, np.append(at, len(data)), _DIGIT[data]))
        self.kind = data[at]
        self.length = worth[at] - worth[np.concatenate(([0], at[:-1]))] if len(at) else np.zeros(0, np.int64)
        self.first = np.searchsorted(at, offsets)
        using = lambda mask: _sums(np.where(mask[self.kind], self.length, 0))
        self.reference, self.read, self.md = using(_REFERENCE), using(_READ), using(_MD)

    def _select(self, sums: np.ndarray, row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(operation, bases into it) of the offset-th base that `sums` counts in each row; it must exist."""
        key = sums[self.first[row]] + offset
        op = np.searchsorted(sums, key, side="right") - 1
        return op, key - sums[op]

    def width(self) -> np.ndarray:
        """Reference bases of each alignment."""
        return np.diff(self.reference[self.first])

    def read_at(self, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The read base at a reference offset (from 0) of its row; DELETED or SKIPPED where there is none."""
        op, into = self._select(self.reference, row, offset)
        kind = self.kind[op]
        base = self.read[op] - self.read[self.first[row]] + into
        return np.where(_BASES[kind], base, np.where(kind == ord("D"), DELETED, SKIPPED))

    def of_md(self, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Reference offsets of offsets that do not count skipped bases."""
        op, into = self._select(self.md, row, offset)
        return self.reference[op] - self.reference[self.first[row]] + into

    def md_width(self) -> np.ndarray:
        return np.diff(self.md[self.first])

    def bases_of(self, kind: str, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, reference offset) of every base of the operations of a kind, in the rows marked."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        keep = self.kind == ord(kind)
        if rows is not None:
            keep &= rows[owner]
        op = np.flatnonzero(keep)
        n = self.length[op]
        into = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(owner[op], n), np.repeat(self.reference[op] - self.reference[self.first[owner[op]]], n) + into


def mismatches(mds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the mismatches of MD strings; offsets count matched, mismatched and deleted bases."""
    data, offsets = _text(mds)
    digit, letter = _DIGIT[data], _LETTER[data]
    ends = np.union1d(np.flatnonzero(~digit), offsets)
    worth = _sums(_weights(data, np.append(ends, len(data)), digit) + letter)
    # Letters behind '^' are deleted; the last place that holds no letter tells.
    place = np.maximum.accumulate(np.where(letter, -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    at = np.flatnonzero(letter)
    row = np.searchsorted(offsets, at, side="right") - 1
    before = place[at]
    gone = (before >= offsets[row]) & (data[np.maximum(before, 0)] == ord("^"))
    return row[~gone], (worth[at] - worth[offsets[row]])[~gone]


def md_matches(mds: pa.Array) -> np.ndarray:
    """Sum of the numbers of each MD string."""
    data, offsets = _text(mds)
    digit = _DIGIT[data]
    ends = np.union1d(np.flatnonzero(~digit), offsets)
    return np.diff(_sums(_weights(data, np.append(ends, len(data)), digit))[offsets])


def _ahead(values: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each value the sum of those before it in its row."""
    sums = _sums(values)
    return sums[:-1] - sums[first[owner]]


def chunks(cigars: pa.Array, mds: pa.Array, flag: np.ndarray, pos0: np.ndarray, least: int, count_cut: bool = False) -> dict[str, np.ndarray]:
    """The stretches of alignments between D and I operations of at least `least`, in order, one more than there are of those.

    row, chunk: the alignment and the number of the stretch in it; pos, stop, length, clip, clip_2; and what
    identity is made of: matches (of the whole alignment's MD), equal, plain (bases of = and M).
    """
    ops = Operations(cigars)
    n = len(ops.first) - 1
    owner = np.repeat(np.arange(n), np.diff(ops.first))
    long = ((ops.kind == ord("D")) | (ops.kind == ord("I"))) & (ops.length >= least)
    before = _sums(long)
    many = before[ops.first[1:]] - before[ops.first[:-1]] + 1
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(n), many)
    of = first[owner] + before[:-1] - before[ops.first[owner]]
    total = lambda kinds, keep: np.bincount(of, np.where(_mask(kinds)[ops.kind] & keep, ops.length, 0), len(row)).astype(np.int64)
    length, span, equal, plain = total(b"MI=X", ~long), total(b"MD=X", ~long), total(b"=", ~long), total(b"M", ~long)
    gone, put_in = total(b"D", long), total(b"I", long)
    # Before each chunk: reference bases with cut-out deletions, read bases, cut-out insertions.
    ref, read, ins = (_ahead(x, first, row) for x in (span + gone, length, put_in))
    whole = np.bincount(row, length + put_in, n).astype(np.int64)[row]
    some = np.diff(ops.first) > 0
    clip = lambda at: np.where(some & _mask(b"SH")[ops.kind[at]], ops.length[at], 0) if len(ops.kind) else np.zeros(n, np.int64)
    last = max(len(ops.kind) - 1, 0)
    lead, trail = clip(np.minimum(ops.first[:-1], last)), clip(np.clip(ops.first[1:] - 1, 0, last))
    back = (flag & 16 != 0)[row]
    lead, trail = lead[row], trail[row]
    rest = whole - read - length
    near, far = np.where(back, trail, lead), np.where(back, lead, trail)
    behind = (np.where(back, read + ins, rest - ins)) if count_cut else np.where(back, read, rest)
    start = pos0[row] + ref
    return {
        "row": row, "chunk": np.arange(len(row)) - first[row], "pos": start + 1, "stop": start + span, "length": length,
        "clip": near + np.where(back, rest - ins, read + ins), "clip_2": far + behind, "matches": md_matches(mds)[row], "equal": equal, "plain": plain,
    }


def gathered_bytes(column: pa.Array, row: np.ndarray, at: np.ndarray) -> pa.Array:
    """The byte at each place of a binary column as a string of one character; empty where `at` is not inside."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    inside = (at >= 0) & (at < offsets[row + 1] - offsets[row])
    found = np.frombuffer(data, np.uint8)[(offsets[row] + at)[inside]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(row), pa.py_buffer(_sums(inside).astype(np.int32)), pa.py_buffer(found.tobytes()))


def gathered_numbers(column: pa.Array, row: np.ndarray, at: np.ndarray) -> pa.Array:
    """The element at each place of a column of number lists or of bytes; null where there is none."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        values = pa.array(np.frombuffer(data, np.uint8).astype(np.int32) if data is not None else np.zeros(0, np.int32))
    else:
        offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.cast(pa.int32())
    known = column.is_valid().to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, bool)
    inside = known & (at >= 0) & (at < offsets[row + 1] - offsets[row])
    return values.take(pa.array(np.where(inside, offsets[row] + at, 0), mask=~inside))
