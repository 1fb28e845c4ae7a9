"""Alignment files, written here by the format's description, and the command line."""

import random
import re
import struct
import zlib

import pyarrow as pa

from breakline.__main__ import main
from breakline.sources import bam, text

OPS, BASES = bam.OPERATIONS, bam.BASES


def _record(contigs, row):
    qname, flag, rname, pos0, mapq, cigar, seq, qual, md = row
    ops = [] if cigar == "*" else [int(n) << 4 | OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    seq = seq or ""
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    tags = b"NMC\x01" + (b"MDZ" + md.encode() + b"\0" if md else b"") + b"ZBBi" + struct.pack("<iii", 2, 1, 2)
    name = qname.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", contigs.index(rname) if rname else -1, pos0, len(name), mapq, 0, len(ops), flag, len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(qual if qual else [255] * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def _bgzf(data, size):
    out = b""
    for chunk in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(chunk) + z.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(chunk), len(chunk))
    return out


def write_bam(path, contigs, rows, block=3000, head="@HD\tVN:1.6\tSO:coordinate\n@RG\tID:1\tSM:me\n"):
    names = [c for c, _ in contigs]
    data = b"BAM\1" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", len(contigs))
    for name, length in contigs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    path.write_bytes(_bgzf(data + b"".join(_record(names, r) for r in rows), block))


def reads(n=300):
    """Reads of a sample with a deletion from 5,000 to 6,000 and an insertion of 60 at 9,000."""
    rng = random.Random(2)
    base = lambda k: "".join(rng.choices("ACGT", k=k))
    rows = []
    for i in range(n):
        kind = i % 3
        cut, pos = [(f"{400 + i % 5}M1000D400M", 4600 - i % 5), (f"{300 + i % 4}M60I300M", 8700 - i % 4), ("700M", 2000 + i)][kind]
        used = sum(int(k) for k, o in re.findall(r"(\d+)([MISX=])", cut))
        rows.append((f"read{i}", 0 if i % 2 else 16, "chr1", pos - 1, 60, cut, base(used), [30] * used, None))
    return sorted(rows, key=lambda r: r[3]) + [("lost", 4, None, -1, 0, "*", "ACG", None, None)]


def listed(r):
    """A row with its qualities as numbers."""
    return tuple(list(x) if isinstance(x, (bytes, bytearray)) else x for x in r)


def bin_number(begin, end):
    for depth in range(5, -1, -1):
        shift = 29 - 3 * depth
        if begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * depth) - 1) // 7 + (begin >> shift)


def write_bai(path, contigs, rows, block):
    """The index of a file of `write_bam`, from the places of its records."""
    names = [c for c, _ in contigs]
    head = read_first(path)
    raw, places, at = path.read_bytes(), [], 0
    while at < len(raw):  # file positions of the blocks
        places.append(at)
        at += struct.unpack_from("<H", raw, at + 16)[0] + 1
    offset, tables = head, {i: ({}, {}) for i in range(len(names))}
    where = lambda x: places[min(x // block, len(places) - 1)] << 16 | x % block
    for r in rows:
        n = len(_record(names, r))
        if r[2] is not None:
            bins, windows = tables[names.index(r[2])]
            end = r[3] + sum(int(k) for k, op in re.findall(r"(\d+)([MDN=X])", r[5]))
            bins.setdefault(bin_number(r[3], max(end, r[3] + 1)), []).append((where(offset), where(offset + n)))
            for w in range(r[3] >> 14, (max(end - 1, r[3]) >> 14) + 1):
                windows.setdefault(w, where(offset))
        offset += n
    out = b"BAI\1" + struct.pack("<i", len(names))
    for bins, windows in tables.values():
        out += struct.pack("<i", len(bins) + 1) + struct.pack("<Ii4Q", 37450, 2, 1, 1 << 60, 5, 0)
        for number, chunks in bins.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        last = max(windows, default=-1)
        line = [0] * (last + 1)
        for w in range(last + 1):
            line[w] = windows.get(w, line[w - 1] if w else 0)
        out += struct.pack("<i", last + 1) + struct.pack(f"<{last + 1}Q", *line)
    path.with_suffix(".bam.bai").write_bytes(out)


def read_first(path):
    """Unpacked bytes ahead of the first record."""
    header = bam.read_header(str(path))
    with bam.open_file(str(path)) as f:
        return sum(len(d) for p, d in bam.blocks(f) if p < header.first[0]) + header.first[1]


def test_pushed_region_equals_filtered_scan(spark, tmp_path):
    rng = random.Random(8)
    contigs = [("chr1", 400_000), ("chr2", 300_000), ("chr3", 1000)]
    rows = []
    for c, size in contigs[:2]:
        for _ in range(400):
            n = rng.choice([50, 120, 3000])
            rows.append((f"q{rng.random()}", rng.choice([0, 16]), c, rng.randint(0, size - 5000), 60, f"{n}M{rng.choice(['', '2D10M'])}", "A", [3], rng.choice([None, "12"])))
    rows = [(*r[:6], "A" * (k := sum(int(x) for x, op in re.findall(r"(\d+)([MIS=X])", r[5]))), [7] * k, r[8]) for r in rows]
    rows = sorted(rows, key=lambda r: (r[2], r[3])) + [("lost", 4, None, -1, 0, "*", "ACG", None, None)]
    write_bam(tmp_path / "a.bam", contigs, rows, 4000)
    bam.register(spark)
    tests = [
        ("rname = 'chr2' and pos0 between 100000 and 120000", lambda r: r[2] == "chr2" and 100_000 <= r[3] <= 120_000), ("rname in ('chr1', 'chr3') and pos0 < 9000", lambda r: r[2] == "chr1" and r[3] < 9000),
        ("rname = 'chr1' and pos0 > 390000 and mapq > 3", lambda r: r[2] == "chr1" and r[3] > 390_000), ("rname is not null and pos0 >= 250000", lambda r: r[2] and r[3] >= 250_000), ("rname = 'nowhere'", lambda r: False),
        ("rname = 'chr2' and rname = 'chr1'", lambda r: False), ("pos0 = -1", lambda r: r[3] == -1), ("rname is null", lambda r: r[2] is None), ("rname = 'chr2' and (pos0 < 500 or pos0 > 200000)", lambda r: r[2] == "chr2" and (r[3] < 500 or r[3] > 200_000)),
    ]
    for indexed in (False, True):
        if indexed:
            write_bai(tmp_path / "a.bam", contigs, rows, 4000)
        for split in (1 << 30, 15_000):
            read = spark.read.format("bam").option("path", str(tmp_path / "a.bam")).option("split", split).load()
            for test, plain in tests:
                got = sorted((listed(r) for r in read.where(test).collect()), key=str)
                assert got == sorted((r for r in rows if plain(r)), key=str), (indexed, split, test)
    plan = read.where(tests[0][0])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" in plan or "rname" in plan.split("BatchScan")[1]
    reader = bam.BamReader({"path": str(tmp_path / "a.bam")})
    assert list(reader.pushFilters([bam.EqualTo(("rname",), "chr2"), bam.GreaterThanOrEqual(("pos0",), 100_000), bam.LessThanOrEqual(("pos0",), 120_000), bam.EqualTo(("mapq",), 1)])) == [bam.EqualTo(("mapq",), 1)]
    size = (tmp_path / "a.bam").stat().st_size
    assert 0 < sum(min(p.stop, size) - p.start for p in reader.partitions()) < size / 4


def test_bam_round_trip(spark, tmp_path):
    rows = reads()
    write_bam(tmp_path / "a.bam", [("chr1", 20000), ("chr2", 500)], rows)
    bam.register(spark)
    for split in (1 << 30, 20_000, 3_000):
        got = [listed(r) for r in spark.read.format("bam").option("path", str(tmp_path / "a.bam")).option("split", split).load().collect()]
        assert sorted(got, key=str) == sorted(rows, key=str), split
    header = bam.read_header(str(tmp_path / "a.bam"))
    assert header.sorted and header.sample("x") == "me" and header.contigs == [("chr1", 20000), ("chr2", 500)]


def test_bam_records_over_many_blocks(spark, tmp_path):
    """Reads of 700 kb, one with a CIGAR in the CG tag, at splits below, at and above a record's size."""
    rng = random.Random(4)
    long = [(f"long{i}", 0, "chr1", 10 * i, 60, "700000M", "".join(rng.choices("ACGT", k=700_000)), None, None) for i in range(4)]
    write_bam(tmp_path / "a.bam", [("chr1", 900_000), ("chr2", 900)], [*long, ("other", 0, "chr2", 5, 60, "3M", "ACG", None, None)], 60_000)
    bam.register(spark)
    for split in (50_000, 400_000, 1_000_000):
        read = spark.read.format("bam").option("path", str(tmp_path / "a.bam")).option("split", split)
        got = read.load().select("qname", "pos0", "seq").collect()
        assert sorted(map(tuple, got)) == sorted([*((r[0], r[3], r[6]) for r in long), ("other", 5, "ACG")]), split
        assert [r.qname for r in read.option("contigs", "chr2").load().collect()] == ["other"]


def test_cigar_of_the_cg_tag():
    steps = [3 << 4, 2 << 4 | 1, 1 << 4]
    body = struct.pack("<iiBBHHHiiii", 0, 9, 2, 60, 0, 2, 0, 6, -1, -1, 0) + b"q\0" + struct.pack("<2I", 6 << 4 | 4, 4 << 4 | 3) + bytes(3) + bytes([255] * 6)
    other = struct.pack("<iiBBHHHiiii", 0, 9, 2, 60, 0, 2, 0, 6, -1, -1, 0) + b"r\0" + struct.pack("<2I", 2 << 4 | 4, 4 << 4) + bytes(3) + bytes([255] * 6)
    got = bam.unpacked([other, body + b"CGBI" + struct.pack("<i3I", 3, *steps), other], pa.array(["c"]), True)
    assert got["cigar"].to_pylist() == ["2S4M", "3M2I1M", "2S4M"] and got["seq"].to_pylist() == ["======"] * 3 and got["qual"].null_count == 3


def test_sample_name_from_path():
    assert bam.Header("", []).sample("/x/y.sorted.bam") == "y" and not bam.Header("@HD\tSO:queryname", []).sorted


def test_sam_equals_bam(spark, tmp_path):
    rows = reads(30)
    lines = ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:chr1\tLN:20000", "@SQ\tSN:chr2\tLN:500"]
    for q, f, c, p, m, cig, s, qual, md in rows:
        lines.append("\t".join([q, str(f), c or "*", str(p + 1), str(m), cig, "*", "0", "0", s or "*", "".join(chr(33 + x) for x in qual) if qual else "*", *([f"MD:Z:{md}"] if md else [])]))
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    assert sorted(map(tuple, text.read_sam(spark, str(tmp_path / "a.sam")).collect()), key=str) == sorted(rows, key=str)
    assert [tuple(r)[:2] for r in text.read_contigs(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()] == [("chr1", 20000), ("chr2", 500)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.bed").write_text("# x\nc\t0\t10\nd\t5\t6\tname\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "m.bed")).collect()] == [("c", 1, 10), ("d", 6, 6)]
    assert [r.pos for r in text.read_snps(spark, str(tmp_path / "m.bed")).collect()] == [1, 6]
    (tmp_path / "s.vcf").write_text("##x\n#CHROM\tPOS\nc\t17\tid\n")
    assert [tuple(r) for r in text.read_snps(spark, str(tmp_path / "s.vcf")).collect()] == [("c", 17)]
    (tmp_path / "g.txt").write_text("c\t100\nd\t50\n")
    assert [r.length for r in text.read_genome(spark, str(tmp_path / "g.txt")).orderBy("ord").collect()] == [100, 50]


def test_command_line(spark, tmp_path):
    write_bam(tmp_path / "a.bam", [("chr1", 20000), ("chr2", 500)], reads())
    (tmp_path / "p.bed").write_text("".join(f"chr1\t{p}\t{p + 1}\n" for p in range(1000, 12000, 100)))
    (tmp_path / "c.ini").write_text("[Filter]\nmin_pid = 0.5\n[Phasing]\nphasing_on = true\n")
    main([str(tmp_path / "a.bam"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.ini"), "-b", str(tmp_path / "p.bed"), "--single", str(tmp_path / "one.vcf")])
    lines = (tmp_path / "one.vcf").read_text().split("\n")
    records = [x.split("\t") for x in lines if x and not x.startswith("#")]
    assert [x for x in lines if x.startswith("#CHROM")][0].endswith("\tme")
    assert {r[4] for r in records} >= {"<INS>"} and all(len(r) == 10 for r in records)
    ins = next(r for r in records if r[4] == "<INS>")
    assert "SVLEN=60" in ins[7].split(";") and ins[9].split(":")[2] == "100,100"
    assert all(r[3] in ("A", "C", "G", "T") for r in records)
    assert any("SVLEN=1001" in r[7].split(";") for r in records)
