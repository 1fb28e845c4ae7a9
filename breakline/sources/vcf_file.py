"""One VCF file from ordered lines, as a Python data sink.

    vcf_file.register(spark)
    lines.write.format("vcf_file").option("path", "calls.vcf.gz").option("header", text).mode("append").save()

`lines` has a column `line` and is in order: its partitions follow one another. Every task writes its lines as
BGZF blocks to a file of its own in a folder beside the target and tells how long it is and where in it the
records of each bin and window of the index begin. The commit copies the files that succeeded, as
bytes, behind the header's blocks, and shifts what they told by the bytes ahead, so no line is read by the
driver; then it renames the whole to the target. Files of failed and repeated tasks are never named and go with
the folder; an abort leaves nothing.

Options: `path` (`.gz`: BGZF, else plain text; in any store that pyarrow opens), `header` (lines joined by
newlines), `index` (true: also `<path>.tbi`; the lines must be in order of contig and position).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from breakline.shared import filesystem

#: Bytes of a block before it is packed; bytes that are copied at a time.
BLOCK, COPY = 0xFF00, 8 << 20
#: The empty block that ends a file (a fixed value of the format).
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def smallest_bin(begin: int, end: int) -> int:
    """The finest of the index's bins that holds [begin, end)."""
    for depth in range(5, 0, -1):
        shift = 29 - 3 * depth
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * depth) - 1) // 7 + (begin >> shift)
    return 0


@dataclass
class Summary:
    """Of one contig: chunks of each bin, and the first record of each window, as virtual offsets."""

    bins: dict[int, list[list[int]]] = field(default_factory=dict)
    windows: dict[int, int] = field(default_factory=dict)

    def add(self, begin: int, end: int, at: int, after: int) -> None:
        chunks = self.bins.setdefault(smallest_bin(begin, end), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = after
        else:
            chunks.append([at, after])
        for w in range(begin >> 14, (end - 1 >> 14) + 1):
            self.windows.setdefault(w, at)

    def join(self, other: Summary, ahead: int) -> None:
        """Take in what stands behind, `ahead` bytes further on in the file."""
        move = lambda v: v + (ahead << 16)
        for number, chunks in other.bins.items():
            own = self.bins.setdefault(number, [])
            for a, b in chunks:
                if own and own[-1][1] == move(a):
                    own[-1][1] = move(b)
                else:
                    own.append([move(a), move(b)])
        for w, at in other.windows.items():
            self.windows.setdefault(w, move(at))


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    size: int
    contigs: dict[str, Summary]


def span(line: str) -> tuple[str, int, int]:
    """(contig, begin, end) of a record, from 0, end excluded; as long as REF, or up to END."""
    chrom, pos, _, ref, _, _, _, info = line.split("\t", 8)[:8]
    begin = int(pos) - 1
    told = next((x[4:] for x in info.split(";") if x.startswith("END=")), None)
    return chrom, max(begin, 0), max(begin + len(ref), int(told) if told else 0, 1)


class PartFile:
    """Lines as blocks of BLOCK bytes, or as they are; places of records are known once their block is out."""

    def __init__(self, out, gzip: bool, index: bool) -> None:
        self.out, self.gzip, self.index = out, gzip, index
        self.held, self.size, self.read = bytearray(), 0, 0
        self.starts = [0]
        self.waiting: list[tuple[str, int, int, int, int]] = []
        self.contigs: dict[str, Summary] = {}

    def add(self, line: str) -> None:
        data = line.encode() + b"\n"
        if self.index:
            self.waiting.append((*span(line), self.read, self.read + len(data)))
        self.held += data
        self.read += len(data)
        while len(self.held) >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, n: int) -> None:
        data = bytes(self.held[:n])
        del self.held[:n]
        data = packed(data) if self.gzip else data
        self.out.write(data)
        self.size += len(data)
        self.starts.append(self.size)
        self._settle((len(self.starts) - 1) * BLOCK)

    def _settle(self, known: int) -> None:
        done = 0
        for chrom, begin, end, at, after in self.waiting:
            if after > known:  # its end lies in a block that is not out yet
                break
            self.contigs.setdefault(chrom, Summary()).add(begin, end, self._place(at), self._place(after))
            done += 1
        del self.waiting[:done]

    def _place(self, offset: int) -> int:
        block, inner = divmod(offset, BLOCK)
        return self.starts[block] << 16 | inner

    def close(self) -> None:
        """The last block is short: its end is where the next part begins."""
        if self.held:
            last, self.read = self.waiting, -(-self.read // BLOCK) * BLOCK
            if last:
                last[-1] = (*last[-1][:4], self.read)
            self._flush(len(self.held))


class VcfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.header = options["path"], options.get("header", "")
        self.gzip = self.path.endswith(".gz")
        self.index = self.gzip and str(options.get("index", "false")).lower() == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        store, at = filesystem(self.path)
        if store.get_file_info(at).is_file:
            raise ValueError(f"{self.path} is there already")
        store.create_dir(filesystem(self.folder)[1])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, at = filesystem(self.folder)
        number, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        with store.open_output_stream(f"{at}/{name}", compression=None) as out:
            part = PartFile(out, self.gzip, self.index)
            for batch in batches:
                for line in batch["line"].to_pylist():
                    part.add(line)
            part.close()
        return Part(number, name, part.size, part.contigs)

    def commit(self, messages: list[Part | None]) -> None:
        store, at = filesystem(self.folder)
        whole, contigs = f"{at}/whole", {}
        with store.open_output_stream(whole, compression=None) as out:
            head = self.header.encode()
            size = 0
            for lo in range(0, len(head), BLOCK):
                data = packed(head[lo : lo + BLOCK]) if self.gzip else head[lo : lo + BLOCK]
                out.write(data)
                size += len(data)
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.number):
                for name, summary in part.contigs.items():
                    contigs.setdefault(name, Summary()).join(summary, size)
                with store.open_input_stream(f"{at}/{part.name}", compression=None) as f:
                    while data := f.read(COPY):
                        out.write(data)
                size += part.size
            if self.gzip:
                out.write(END)
        target = filesystem(self.path)[1]
        if self.index:
            with store.open_output_stream(f"{at}/index", compression=None) as out:
                data = index_bytes(contigs)
                for lo in range(0, len(data), BLOCK):
                    out.write(packed(data[lo : lo + BLOCK]))
                out.write(END)
            store.move(f"{at}/index", f"{target}.tbi")
        store.move(whole, target)
        store.delete_dir(at)

    def abort(self, messages: list[Part | None]) -> None:
        store, at = filesystem(self.folder)
        store.delete_dir(at)


def index_bytes(contigs: dict[str, Summary]) -> bytes:
    """A tabix index of VCF: contigs in the order of the file, their bins and 16 kb windows."""
    names = b"".join(n.encode() + b"\0" for n in contigs)
    out = [b"TBI\1", struct.pack("<8i", len(contigs), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
    for summary in contigs.values():
        out.append(struct.pack("<i", len(summary.bins)))
        for number, chunks in sorted(summary.bins.items()):
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        last, before = max(summary.windows, default=-1), 0
        out.append(struct.pack("<i", last + 1))
        line = []
        for w in range(last + 1):
            before = summary.windows.get(w, before)
            line.append(before)
        out.append(struct.pack(f"<{len(line)}Q", *line))
    return b"".join(out)


class VcfFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf_file"

    def writer(self, schema, overwrite: bool) -> VcfWriter:
        if "line" not in schema.fieldNames():
            raise ValueError("a column `line` is needed")
        return VcfWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VcfFile)
