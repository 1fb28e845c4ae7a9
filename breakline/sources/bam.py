"""Alignments from BAM files, as a Python data source.

    bam.register(spark)
    spark.read.format("bam").option("path", "reads.bam").load().where("rname = 'chr2' and pos0 between 500 and 900")

A BAM file is a chain of BGZF blocks, which are gzip members of at most 64 KB that tell their own
length. A file is cut into stretches of `split` bytes. A record belongs to the stretch in which its
first block starts, so each is read once; a reader finds the first record of its stretch by the fixed
fields, name and CIGAR of a record and of the one behind it, and reads on across the end of the stretch
as far as a record goes. Records of any length, and CIGARs of the CG tag, are read whole. Fields are
unpacked for many records at once and handed to Spark as Arrow batches; qual is binary.

Filters on rname (=, in, is not null) and pos0 (=, <, <=, >, >=) are pushed into the scan: other records are
passed over before they are unpacked, in a sorted file reading stops behind the last wanted one, and with a
.bai file beside the BAM only the blocks are read that its bins and linear index name for the region.

Options: `path` (files or folders, commas between them, in any store that pyarrow opens), `split`,
`sequence` (false leaves seq and qual null), `contigs` (names joined by commas, as a filter on rname).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from breakline.shared import filesystem

SCHEMA = "qname string, flag int, rname string, pos0 long, mapq int, cigar string, seq string, qual binary, md string"
# Fixed values of the format: CIGAR operations and base codes, in the order of their numbers.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_CODES = np.array([(ord(BASES[b >> 4]), ord(BASES[b & 15])) for b in range(256)], np.uint8).view(np.uint16)[:, 0]
_READS = np.array([op in "MIS=X" for op in OPERATIONS])
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
#: Bytes asked of the store at a time; no record is larger than LARGEST.
CHUNK, LARGEST = 1 << 20, 1 << 30
#: Records and bytes of a batch; a longer record is a batch of its own.
BATCH, BATCH_BYTES = 5000, 8 << 20


def open_file(path: str):
    store, at = filesystem(path)
    return store.open_input_file(at)


def size_of(path: str) -> int:
    store, at = filesystem(path)
    return store.get_file_info(at).size


def blocks(f, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(file position, data) of the BGZF blocks from the one at `start`."""
    f.seek(start)
    held = b""
    while True:
        if len(held) < 1 << 16:
            held += f.read(CHUNK)
        if not held:
            return
        if len(held) < 18 or held[:4] != b"\x1f\x8b\x08\x04" or held[12:14] != b"BC":
            raise ValueError(f"no BGZF block at {start}")
        size, extra = struct.unpack_from("<H", held, 16)[0] + 1, struct.unpack_from("<H", held, 10)[0]
        if len(held) < size:
            raise ValueError(f"the BGZF block at {start} is cut short")
        yield start, zlib.decompress(held[12 + extra : size - 8], -15)
        held, start = held[size:], start + size


def first_block(f, start: int) -> int | None:
    """Position of the first block at or behind `start`."""
    if start == 0:
        return 0
    f.seek(start)
    near = f.read(1 << 17)
    at = near.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        try:
            if near[at + 12 : at + 14] == b"BC" and next(blocks(f, start + at))[1] is not None:
                return start + at
        except (ValueError, zlib.error, struct.error, StopIteration):
            pass
        at = near.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


@dataclass
class Header:
    text: str
    contigs: list[tuple[str, int]]
    #: Where the first record is: file position of its block, offset inside.
    first: tuple[int, int] = (0, 0)

    @property
    def sorted(self) -> bool:
        """False only where the header names an order other than by coordinate."""
        return all("SO:coordinate" in x for x in self.text.split("\n") if x.startswith("@HD"))

    def sample(self, path: str) -> str:
        """SM of the first read group, else the file's name."""
        for line in self.text.split("\n"):
            if line.startswith("@RG"):
                for part in line.split("\t"):
                    if part.startswith("SM:"):
                        return part[3:]
        return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".bam").removesuffix(".sorted")


class Stream:
    """The unpacked bytes from a block on; `data[here:]` is unread, `block` the position of here's block."""

    def __init__(self, f, start: int) -> None:
        self.chain, self.data, self.here, self.ended = blocks(f, start), bytearray(), 0, False
        self.bounds: list[tuple[int, int]] = []  # (offset in data, file position) of blocks

    def more(self) -> bool:
        for where, got in self.chain:
            self.bounds.append((len(self.data), where))
            self.data += got
            return True
        self.ended = True
        return False

    def hold(self, n: int) -> bool:
        """Whether `n` unread bytes are there, after reading on for them."""
        while len(self.data) < self.here + n and self.more():
            pass
        return len(self.data) >= self.here + n

    def place(self, offset: int) -> tuple[int, int]:
        """(file position of the block of data[offset], offset in the block)."""
        at = max(i for i, (off, _) in enumerate(self.bounds) if off <= offset)
        return self.bounds[at][1], offset - self.bounds[at][0]

    def skip(self, n: int) -> None:
        self.here += n
        if self.here > 4 * CHUNK:
            at = max(i for i, (off, _) in enumerate(self.bounds) if off <= self.here)
            self.bounds = [(off - self.here, where) for off, where in self.bounds[at:]]
            del self.data[: self.here]
            self.here = 0


def read_header(path: str) -> Header:
    with open_file(path) as f:
        s = Stream(f, 0)

        def need(n: int) -> None:
            if not s.hold(n):
                raise ValueError(f"{path} is cut short")

        need(12)
        if s.data[:4] != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        length = struct.unpack_from("<i", s.data, 4)[0]
        need(12 + length)
        text = bytes(s.data[8 : 8 + length]).rstrip(b"\0").decode()
        count, at, contigs = struct.unpack_from("<i", s.data, 8 + length)[0], 12 + length, []
        for _ in range(count):
            need(at + 4)
            n = struct.unpack_from("<i", s.data, at)[0]
            need(at + 8 + n)
            contigs.append((bytes(s.data[at + 4 : at + 3 + n]).decode(), struct.unpack_from("<i", s.data, at + 4 + n)[0]))
            at += 8 + n
        if len(s.data) == at:
            s.more()
        return Header(text, contigs, s.place(at))


def flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of n[i] places each, one after another."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def strings(kind: pa.DataType, data: np.ndarray | bytes, n: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Strings or bytes of n[i] bytes each; those marked `null` have none."""
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    known = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(n), [known, pa.py_buffer(ends), pa.py_buffer(data)])


def cigar_strings(steps: np.ndarray, ops: np.ndarray) -> pa.Array:
    """Text of packed operations, ops[i] of them in each record; '*' for none."""
    value, digits = (steps >> 4).astype(np.int64), np.ones(len(steps), np.int64)
    for k in range(1, 9):
        digits += value >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = np.frombuffer(OPERATIONS.encode().ljust(16, b"?"), np.uint8)[steps & 15]
    for k in range(9):
        has = digits > k
        out[ends[has] - 2 - k] = 48 + value[has] // 10**k % 10
    first = np.cumsum(ops) - ops
    before = np.concatenate(([0], ends))
    size = before[first + ops] - before[first]
    # A '*' for each record without operations.
    bare = size == 0
    whole = np.full(int(size.sum()) + int(bare.sum()), 42, np.uint8)
    starts_ = np.cumsum(size + bare) - (size + bare)
    whole[flat(starts_, size)] = out
    return strings(pa.string(), whole, size + bare)


def tags(data: bytes, at: int, end: int) -> tuple[str | None, np.ndarray | None]:
    """(MD, operations of CG) among the tags data[at:end]."""
    md = steps = None
    while at < end:
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(b"\0", at)
            if tag == b"MD":
                md = data[at:stop].decode()
            at = stop + 1
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            if tag == b"CG" and inner == "I":
                steps = np.frombuffer(data, "<u4", n, at + 5)
            at += 5 + n * _SIZES[inner]
        else:
            at += _SIZES[kind]
    return md, steps


def unpacked(records: list[bytes], contigs: pa.Array, sequence: bool) -> pa.RecordBatch:
    """Records, without their lengths, as a batch of SCHEMA."""
    data = b"".join(records)
    size = np.array([len(r) for r in records], np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    head = raw[at[:, None] + np.arange(20)]
    ref, pos, length = (np.ascontiguousarray(head[:, k : k + 4]).view("<i4")[:, 0].astype(np.int64) for k in (0, 4, 16))
    ops, flag = (np.ascontiguousarray(head[:, k : k + 2]).view("<u2")[:, 0].astype(np.int64) for k in (12, 14))
    name, mapq = head[:, 8].astype(np.int64), head[:, 9].astype(np.int32)
    names = strings(pa.string(), raw[flat(at + 32, name - 1)], name - 1)
    first = at + 32 + name
    steps = np.ascontiguousarray(raw[flat(first, 4 * ops)]).view("<u4")
    packed = (length + 1) // 2
    bases = first + 4 * ops
    rest = bases + packed + length
    found = [tags(data, a, b) for a, b in zip(rest.tolist(), (at + size).tolist(), strict=True)]
    # A CIGAR of over 65,535 operations: the field holds kSmN, the tag the operations.
    begin = np.cumsum(ops) - ops
    long = [i for i, (_, cg) in enumerate(found) if cg is not None and ops[i] == 2 and steps[begin[i]] == length[i] << 4 | 4 and steps[begin[i] + 1] & 15 == 3]
    if long:
        parts = np.split(steps, begin[1:])
        for i in long:
            parts[i] = found[i][1]
        steps, ops = np.concatenate(parts), np.array([len(p) for p in parts])
    seq = qual = pa.nulls(len(records))
    if sequence:
        # Long stretches are joined as slices; only the codes of bases are looked up.
        codes = b"".join([data[a:b] for a, b in zip(bases.tolist(), (bases + packed).tolist(), strict=True)])
        pairs = memoryview(_CODES[np.frombuffer(codes, np.uint8)].view(np.uint8))
        begin = (2 * (np.cumsum(packed) - packed)).tolist()
        seq = strings(pa.string(), b"".join([pairs[a : a + n] for a, n in zip(begin, length.tolist(), strict=True)]), length, length == 0)
        start = bases + packed
        bare = (length == 0) | (raw[np.minimum(start, len(raw) - 1)] == 255)
        kept = np.where(bare, 0, length)
        qual = strings(pa.binary(), b"".join([data[a : a + n] for a, n in zip(start.tolist(), kept.tolist(), strict=True)]), kept, bare)
    rname = contigs.take(pa.array(np.maximum(ref, 0), mask=ref < 0)) if len(contigs) else pa.nulls(len(records), pa.string())
    columns = [names, pa.array(flag.astype(np.int32)), rname, pa.array(pos), pa.array(mapq), cigar_strings(steps, ops), seq.cast(pa.string()), qual.cast(pa.binary()), pa.array([m for m, _ in found], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["qname", "flag", "rname", "pos0", "mapq", "cigar", "seq", "qual", "md"])


def plausible(data: bytearray, at: int, contigs: list[tuple[str, int]]) -> bool | None:
    """Whether a record can start at this place; None where its head goes beyond the data."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name, _mapq, _bin, ops, _flag, length, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    n = len(contigs)
    fixed = 32 + name + 4 * ops + (length + 1) // 2 + length
    if not (-1 <= ref < n and -1 <= next_ref < n and -1 <= pos and -1 <= next_pos and name >= 2 and length >= 0 and fixed <= size <= LARGEST):
        return False
    if ref >= 0 and pos > contigs[ref][1]:
        return False
    end = at + 36 + name
    if end + 4 * ops > len(data):
        return None
    if data[end - 1] != 0 or not all(33 <= c <= 126 for c in data[at + 36 : end - 1]):
        return False
    steps = np.frombuffer(bytes(data[end : end + 4 * ops]), "<u4")
    kinds = steps & 15
    if ops and (kinds.max() > 8 or (length and int((steps >> 4)[_READS[kinds]].sum()) != length)):
        return False
    return True


def starts(data: bytearray, low: int, contigs: int) -> np.ndarray:
    """Places from `low` on whose fixed fields can be those of a record."""
    raw = np.frombuffer(bytes(data[low:]), np.uint8)
    n = len(raw) - 36
    if n <= 0:
        return np.zeros(0, np.int64)
    word = lambda k: (raw[k : k + n].astype(np.int64) | raw[k + 1 : k + 1 + n].astype(np.int64) << 8 | raw[k + 2 : k + 2 + n].astype(np.int64) << 16 | raw[k + 3 : k + 3 + n].astype(np.int64) << 24)
    signed = lambda k: (word(k) ^ 0x80000000) - 0x80000000
    size, ref = signed(0), signed(4)
    ok = (size >= 34) & (size <= LARGEST) & (ref >= -1) & (ref < contigs)
    for test in (lambda: signed(8) >= -1, lambda: raw[12 : 12 + n] >= 2, lambda: signed(20) >= 0, lambda: (signed(24) >= -1) & (signed(24) < contigs), lambda: signed(28) >= -1):
        ok &= test()
    return low + np.flatnonzero(ok)


def first_record(s: Stream, contigs: list[tuple[str, int]], stop: int) -> bool:
    """Move to the first record of the stretch; False if none starts before file position `stop`."""
    tried = 0
    while True:
        for i in starts(s.data, tried, len(contigs)).tolist():
            if s.place(i)[0] >= stop:
                return False
            got = _chained(s, i, contigs)
            if got:
                s.here = i
                return True
        tried = max(tried, len(s.data) - 36)
        if s.place(max(0, min(tried, len(s.data) - 1)))[0] >= stop or not s.more():
            return False


def _chained(s: Stream, at: int, contigs: list[tuple[str, int]]) -> bool:
    """Whether a record starts at `at` and another one, or the end, follows it."""
    for _ in range(2):
        while (got := plausible(s.data, at, contigs)) is None:
            if not s.more():
                return at == len(s.data)
        if not got:
            return False
        at += 4 + struct.unpack_from("<i", s.data, at)[0]
        while len(s.data) < at and s.more():
            pass
        if len(s.data) < at:
            return False
    return True


@dataclass
class Stretch(InputPartition):
    """Records whose first byte lies in a block that starts in [start, stop); `first` is that of the first record
    where it is known, `last` ends the stretch: (file position of a block, offset inside)."""

    path: str
    start: int
    stop: int
    first: tuple[int, int] | None = None
    last: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start))


@dataclass(frozen=True)
class Wanted:
    """Records to read: of these contigs (None: all; with `placed` those with one), from low to high."""

    names: frozenset[str] | None = None
    placed: bool = False
    low: int | None = None
    high: int | None = None

    def narrowed(self, f: Filter) -> Wanted | None:
        """With another filter, which is then wholly obeyed; None where it can't be."""
        column = getattr(f, "attribute", None)
        if column == ("rname",):
            if isinstance(f, IsNotNull):
                return replace(self, placed=True)
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None:
                return replace(self, placed=True, names=frozenset(x for x in names if x is not None and (self.names is None or x in self.names)))
        if column == ("pos0",):
            if isinstance(f, IsNotNull):
                return self
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                low = high = None
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                most = lambda pick, a, b: b if a is None else a if b is None else pick(a, b)
                return replace(self, low=most(max, self.low, low), high=most(min, self.high, high))
        return None

    @property
    def everything(self) -> bool:
        return self == Wanted()


def batches(part: Stretch, sequence: bool = True, wanted: Wanted = Wanted()) -> Iterator[pa.RecordBatch]:
    """The wanted records of a stretch."""
    header = read_header(part.path)
    contigs = header.contigs
    names = pa.array([n for n, _ in contigs], pa.string())
    keep = None if wanted.names is None else {i for i, (name, _) in enumerate(contigs) if name in wanted.names}
    in_order = any("SO:coordinate" in x for x in header.text.split("\n") if x.startswith("@HD"))
    low, high = -(1 << 40) if wanted.low is None else wanted.low, 1 << 40 if wanted.high is None else wanted.high
    held: list[bytes] = []
    bytes_held = 0
    with open_file(part.path) as f:
        first = part.first
        if first is None and part.start <= header.first[0]:
            if header.first[0] >= part.stop:
                return
            first = header.first
        if first is not None:
            s = Stream(f, first[0])
            s.more()
            s.here = first[1]
        else:
            at = first_block(f, part.start)
            if at is None or at >= part.stop:
                return
            s = Stream(f, at)
            s.more()
            if not first_record(s, contigs, part.stop):
                return
        end = part.last or (part.stop, 0)
        while s.hold(4):
            if s.bounds[-1][1] >= end[0] and s.place(s.here) >= end:
                break
            size = struct.unpack_from("<i", s.data, s.here)[0]
            if not s.hold(4 + size):
                raise ValueError(f"{part.path} is cut short")
            ref, pos = struct.unpack_from("<ii", s.data, s.here + 4)
            if (ref in keep if keep is not None else ref >= 0 or not wanted.placed) and low <= pos <= high:
                held.append(bytes(s.data[s.here + 4 : s.here + 4 + size]))
                bytes_held += size
                if len(held) >= BATCH or bytes_held >= BATCH_BYTES:
                    yield unpacked(held, names, sequence)
                    held, bytes_held = [], 0
            elif in_order and keep is not None and (not keep or ref < 0 or ref > max(keep) or ref == max(keep) and pos > high):
                break
            s.skip(4 + size)
    if held:
        yield unpacked(held, names, sequence)


def bins_of(low: int, high: int) -> Iterator[int]:
    """Numbers of the index's bins that meet [low, high]: six levels, each eight times as fine as the one above."""
    first = 0
    for depth in range(6):
        shift = 29 - 3 * depth
        yield from range(first + (low >> shift), first + (high >> shift) + 1)
        first += 1 << 3 * depth


def index_chunks(path: str, wanted: Wanted) -> list[tuple[int, int]] | None:
    """Stretches of the file, as virtual offsets of records, that hold all wanted ones; None without a .bai file."""
    for name in (f"{path}.bai", f"{path.removesuffix('.bam')}.bai"):
        store, at = filesystem(name)
        if store.get_file_info(at).is_file:
            break
    else:
        return None
    with store.open_input_file(at) as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{name} is not a BAI file")
    low, high = max(0, wanted.low or 0), min((1 << 29) - 1, (1 << 29) - 1 if wanted.high is None else wanted.high)
    asked = set(bins_of(low, high)) if low <= high else set()
    contigs = read_header(path).contigs
    count, at, out = struct.unpack_from("<i", raw, 4)[0], 8, []
    for i in range(count):
        bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        spans: list[tuple[int, int]] = []
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            at += 8
            if number in asked:
                both = struct.unpack_from(f"<{2 * chunks}Q", raw, at)
                spans += zip(both[::2], both[1::2], strict=True)
            at += 16 * chunks
        windows = struct.unpack_from("<i", raw, at)[0]
        # No record that reaches this window begins before its entry.
        window = low >> 14
        least = struct.unpack_from("<Q", raw, at + 4 + 8 * window)[0] if window < windows else 0
        at += 4 + 8 * windows
        if contigs[i][0] in wanted.names:
            out += [(max(a, least), b) for a, b in spans if b > least]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split = [], int(options.get("split", 64 << 20))
        self.sequence = str(options.get("sequence", "true")).lower() != "false"
        # Contigs to read, joined by commas (no contig's name may hold one); all by default.
        asked = options.get("contigs")
        self.wanted = Wanted() if asked is None else Wanted(frozenset(str(asked).split(",")), True)
        for path in options["path"].split(","):
            store, at = filesystem(path)
            if store.get_file_info(at).is_file:
                self.paths.append(path)
            else:
                from pyarrow import fs

                names = [x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".bam")]
                self.paths += [f"{path.rstrip('/')}/{x}" for x in sorted(names)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def partitions(self) -> list[Stretch]:
        out = []
        for p in self.paths:
            chunks = index_chunks(p, self.wanted) if self.wanted.names is not None else None
            if chunks is None:
                out += [Stretch(p, at, at + self.split) for at in range(0, size_of(p), self.split)]
                continue
            for a, b in chunks:
                (begin, inner), end = (a >> 16, a & 0xFFFF), (b >> 16, b & 0xFFFF)
                for at in range(begin, end[0] + 1, self.split):
                    final = at + self.split > end[0]
                    out.append(Stretch(p, at, end[0] + 1 if final else at + self.split, (begin, inner) if at == begin else None, end if final else None))
        return out or [Stretch(p, 0, 0) for p in self.paths[:1]]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.sequence, self.wanted)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make format("bam") known to the session, and let its filters reach the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(BamSource)
