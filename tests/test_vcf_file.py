"""The single VCF file: whole content, seeks by its index, and nothing left of failed writes."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from breakline.sources import bam, vcf_file

HEAD = "##fileformat=VCFv4.1\n" + "##note=x\n" * 9000 + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def records(n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        chrom, pos = rng.choice(["chr1", "chr10", "chr2"]), rng.choice([rng.randint(1, 40_000), rng.randint(1, 3_000_000)])
        info = rng.choice(["IMPRECISE", f"SVTYPE=DEL;END={pos + rng.choice([0, 50, 30_000])};X=1", "END=5"]) + ";PAD=" + "y" * rng.randint(0, 300)
        rows.append((chrom, pos, f"{chrom}\t{pos}\t{i}\t{rng.choice(['N', 'ACG'])}\t<X>\t9\tPASS\t{info}\tGT\t0/1"))
    return sorted(rows)


def read_index(path):
    raw = gzip.open(path).read()
    assert raw[:4] == b"TBI\1"
    n, kind, seq, begin, end, meta, skip, names = struct.unpack_from("<8i", raw, 4)
    assert (kind, seq, begin, end, chr(meta), skip) == (2, 1, 2, 0, "#", 0)
    contigs, at, out = raw[36 : 36 + names].decode().split("\0")[:-1], 36 + names, {}
    for c in contigs:
        bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        own = {}
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            own[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * chunks
        windows = struct.unpack_from("<i", raw, at)[0]
        out[c] = (own, struct.unpack_from(f"<{windows}Q", raw, at + 4))
        at += 4 + 8 * windows
    assert at == len(raw) and len(out) == n
    return out


def fetch(path, index, chrom, low, high):
    """Lines that meet [low, high) by the index: seek to a block, read on to the chunk's end."""
    bins, windows = index.get(chrom, ({}, ()))
    least = windows[low >> 14] if low >> 14 < len(windows) else 0
    out = []
    with open(path, "rb") as f:
        for number in bam.bins_of(low, high - 1):
            for a, b in bins.get(number, ()):
                if b <= least:
                    continue
                data, stops = b"", None
                for where, block in bam.blocks(f, a >> 16):
                    if where == b >> 16:
                        stops = len(data) + (b & 0xFFFF)
                        break
                    data += block
                if stops is not None:
                    data += block
                text = data[a & 0xFFFF : stops].decode()
                assert text.endswith("\n")
                out += [x for x in text.split("\n")[:-1] if (s := vcf_file.span(x))[0] == chrom and s[1] < high and s[2] > low]
    return out


@pytest.mark.parametrize("parts", [1, 6])
def test_one_file_with_index(spark, tmp_path, parts):
    rows = records()
    path = tmp_path / "a.vcf.gz"
    vcf_file.register(spark)
    df = spark.createDataFrame(rows, "chrom string, pos long, line string").repartitionByRange(parts, "chrom", "pos", "line").sortWithinPartitions("chrom", "pos", "line")
    df.select("line").write.format("vcf_file").option("path", str(path)).option("header", HEAD).option("index", "true").mode("append").save()
    assert gzip.open(path, "rt").read() == HEAD + "".join(f"{r[2]}\n" for r in rows)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.vcf.gz", "a.vcf.gz.tbi"]
    index, rng = read_index(f"{path}.tbi"), random.Random(2)
    assert list(index) == ["chr1", "chr10", "chr2"]
    for _ in range(150):
        chrom, low = rng.choice(["chr1", "chr10", "chr2", "chr3"]), rng.randint(0, 3_000_000)
        high = low + rng.choice([1, 100, 20_000, 500_000])
        want = [r[2] for r in rows if r[0] == chrom and vcf_file.span(r[2])[1] < high and vcf_file.span(r[2])[2] > low]
        assert sorted(fetch(path, index, chrom, low, high)) == sorted(want)


def test_plain_text_empty_parts_and_no_rows(spark, tmp_path):
    vcf_file.register(spark)
    rows = records(20)
    df = spark.createDataFrame([(r[2],) for r in rows], "line string").coalesce(1)
    empty = df.limit(0)
    df.union(empty).write.format("vcf_file").option("path", str(tmp_path / "a.vcf")).option("header", "#h\n").mode("append").save()
    assert (tmp_path / "a.vcf").read_text() == "#h\n" + "".join(f"{r[2]}\n" for r in rows)
    empty.write.format("vcf_file").option("path", str(tmp_path / "b.vcf.gz")).option("header", "#h\n").option("index", "true").mode("append").save()
    assert gzip.open(tmp_path / "b.vcf.gz", "rt").read() == "#h\n" and read_index(tmp_path / "b.vcf.gz.tbi") == {}
    with pytest.raises(Exception, match="is there already"):
        df.write.format("vcf_file").option("path", str(tmp_path / "a.vcf")).mode("append").save()


def test_failed_write_leaves_nothing(spark, tmp_path):
    vcf_file.register(spark)
    rows = records(300)
    bad = F.when(F.col("line").contains("\t299\t"), F.raise_error(F.lit("lost"))).otherwise(F.col("line"))
    df = spark.createDataFrame([(r[2],) for r in rows], "line string").repartition(4).select(bad.alias("line"))
    with pytest.raises(Exception, match="lost"):
        df.write.format("vcf_file").option("path", str(tmp_path / "a.vcf.gz")).mode("append").save()
    assert list(tmp_path.iterdir()) == []


def test_file_of_a_repeated_attempt_is_not_read(tmp_path):
    """Only what a task's message names is joined."""
    writer = vcf_file.VcfWriter({"path": str(tmp_path / "a.vcf.gz"), "header": "#h\n"})
    (name,) = tmp_path.iterdir()
    data = vcf_file.packed(b"good\n")
    (name / "one").write_bytes(data)
    (name / "half").write_bytes(b"torn")
    writer.commit([None, vcf_file.Part(3, "one", len(data), {})])
    assert gzip.open(tmp_path / "a.vcf.gz", "rt").read() == "#h\ngood\n" and len(list(tmp_path.iterdir())) == 1


def test_blocks_are_whole_members():
    data = vcf_file.packed(b"x" * 1000) + vcf_file.END
    assert zlib.decompress(data, 31) == b"x" * 1000 and len(vcf_file.END) == 28 and gzip.decompress(data) == b"x" * 1000
