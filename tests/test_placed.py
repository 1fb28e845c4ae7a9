"""Prefix-sum lookups in CIGAR and MD strings against walks base by base."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from breakline.functions import placed
from breakline.operators import phasing, pileup


def walk(cigar):
    """For each reference base its read base, or the kind of gap."""
    out, read = [], 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
        n = int(n)
        if op in "M=X":
            out += range(read, read + n)
        elif op in "DN":
            out += [placed.DELETED if op == "D" else placed.SKIPPED] * n
        read += n * (op in "MIS=X")
    return out


def random_cigar(rng, kinds="MIDN=XP", long=60):
    ops = "".join(f"{rng.choice([0, 1, 2, rng.randint(1, long)])}{rng.choice(kinds)}" for _ in range(rng.randint(1, 12)))
    return f"{rng.choice(['', '5H', '7S', '2H3S'])}{ops}{rng.choice(['', '4S', '9H'])}"


def test_read_bases_equal_a_walk():
    rng = random.Random(1)
    cigars = [None, "*", "", *(random_cigar(rng) for _ in range(300)), "1000000M"]
    for column in (pa.array(cigars), pa.array(["9M", *cigars]).slice(1)):
        ops = placed.Operations(column)
        want = [walk(c) if c != "*" else [] for c in cigars]
        assert ops.width().tolist() == [len(w) for w in want]
        row = np.repeat(np.arange(len(want)), [len(w) for w in want])
        offset = np.concatenate([np.arange(len(w)) for w in want])
        assert ops.read_at(row, offset).tolist() == [x for w in want for x in w]
        for kind in "XD":
            got = list(zip(*(x.tolist() for x in ops.bases_of(kind)), strict=True))
            flat = []
            for i, c in enumerate(cigars):
                at = 0
                for n, op in re.findall(r"(\d+)([MIDNSHP=X])", c or ""):
                    flat += [(i, at + k) for k in range(int(n)) if op == kind]
                    at += int(n) * (op in "MDN=X")
            assert got == flat


def test_mismatches_equal_a_walk():
    rng = random.Random(2)
    piece = lambda: rng.choice([str(rng.randint(0, 30)), "A", "^ACG", "0", "c", "^T0"])
    mds = [None, "", "10", "5A^AC0T3", *("".join([str(rng.randint(0, 9)), *(piece() for _ in range(rng.randint(0, 9)))]) for _ in range(300))]
    want = []
    for i, md in enumerate(mds):
        at = 0
        for part in re.findall(r"\d+|\^[A-Za-z]+|[A-Za-z]", md or ""):
            if part.isalpha():
                want.append((i, at))
            at += int(part) if part.isdigit() else len(part.lstrip("^"))
    assert list(zip(*(x.tolist() for x in placed.mismatches(pa.array(mds))), strict=True)) == want


def test_md_offsets_skip_skipped_bases():
    cigars = ["5M10N5M2D3M", "3S4=2N1X", "8M"]
    ops = placed.Operations(pa.array(cigars))
    for i, c in enumerate(cigars):
        known = [k for k, x in enumerate(walk(c)) if x != placed.SKIPPED]
        assert ops.of_md(np.full(len(known), i), np.arange(len(known))).tolist() == known


READS = "qname string, flag int, rname string, pos0 long, mapq int, cigar string, md string, seq string, qual array<int>"


def reads(rng, n, kinds="MID=XN", long=60):
    rows = []
    for i in range(n):
        cigar = random_cigar(rng, kinds, long)
        size = sum(int(k) for k, op in re.findall(r"(\d+)([MIS=X])", cigar))
        seq = "".join(rng.choices("ACGT", k=size))
        qual = None if rng.random() < 0.1 else [rng.randint(0, 40) for _ in range(size)]
        rows.append((f"r{i}", rng.choice([0, 16, 4]), rng.choice(["c1", "c2"]), rng.randint(0, 300), rng.choice([10, 60]), cigar, None, seq, qual))
    return [*rows, rows[0], ("star", 0, "c1", 0, 60, "*", None, "ACGT", [1, 2, 3, 4]), ("none", 0, "c1", 0, 60, "4M", None, None, None), ("short", 0, "c1", 0, 60, "6M", None, "AC", [7])]


@pytest.mark.parametrize("binary", [False, True])
def test_pileup_equals_a_walk(spark, binary):
    rng = random.Random(3)
    rows = reads(rng, 80)
    df = spark.createDataFrame(rows, READS).repartition(3)
    if binary:
        df = spark.createDataFrame([(*r[:-1], None if r[-1] is None else bytearray(r[-1])) for r in rows], READS.replace("array<int>", "binary"))
    asked = [(c, p) for c in ("c1", "c2", "c3") for p in range(1, 700, 3)]
    want = []
    for q, flag, c, pos0, _, cigar, _, seq, qual in rows:
        if flag & 4 or cigar == "*" or seq is None:
            continue
        outer = re.search(r"^(\d+)[SH]", cigar) if not flag & 16 else re.search(r"(\d+)[SH]$", cigar)
        index = walk(cigar)
        for k, p in asked:
            if k == c and 0 <= p - pos0 - 1 < len(index):
                at = index[p - pos0 - 1]
                base = "-" if at == placed.DELETED else ">" if at == placed.SKIPPED else seq[at : at + 1]
                want.append((c, p, q, int(outer[1]) if outer else 0, base, qual[at] if qual and 0 <= at < len(qual) else None))
    # Copies of a row find each other, as many times as there are copies.
    copies = rows.count(rows[0])
    want = [w for w in want if w[2] != rows[0][0]] + [w for w in want if w[2] == rows[0][0]]
    got = [tuple(r) for r in pileup.pileup(df, spark.createDataFrame([*asked, asked[0]], "rname string, pos long")).collect()]
    assert copies == 2 and sorted(got, key=str) == sorted(want, key=str)


def test_few_positions_move_no_alignment(spark, monkeypatch):
    """Up to FEW positions no alignment is shuffled; beyond, and in slices of any size, the rows are the same."""
    rng = random.Random(9)
    df = spark.createDataFrame(reads(rng, 60), READS)
    asked = spark.createDataFrame([*((c, p) for c in ("c1", "c2") for p in range(1, 500, 2)), (None, 5)], "rname string, pos long")
    got = {}
    for few, size in ((1_000_000, 100_000), (1_000_000, 3), (10, 100_000)):
        monkeypatch.setattr(pileup, "FEW", few)
        monkeypatch.setattr(pileup, "SLICE", size)
        found = pileup.pileup(df, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (few == 10)
        got[few, size] = sorted((tuple(r) for r in found.collect()), key=str)
    assert len(set(map(str, got.values()))) == 1 and len(got[10, 100_000]) > 500
    assert pileup.pileup(df, asked.limit(0)).count() == 0


def test_snp_calls_equal_a_walk(spark):
    rng = random.Random(4)
    rows = [r for r in reads(rng, 200, "========XDIN", 25) if r[0] not in ("star", "none", "short")][:-1]
    rows = [(*r[:4], 60, *r[5:]) for r in rows if all(int(n) < 30 for n, op in re.findall(r"(\d+)([ID])", r[5]))]  # one segment each
    want = set()
    for q, flag, c, pos0, _, cigar, _, seq, qual in rows:
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        aligned = sum(n for n, op in ops if op in "MI=X")
        equal, plain = sum(n for n, op in ops if op == "="), sum(n for n, op in ops if op == "M")
        share = round((equal or plain) / aligned, 3) if aligned else 0
        if flag & 4 or qual is None or not aligned or share < 0.7:
            continue
        outer = re.search(r"^(\d+)[SH]", cigar) if not flag & 16 else re.search(r"(\d+)[SH]$", cigar)
        stop = pos0 + sum(n for n, op in ops if op in "MD=X")  # skipped bases are not in a segment's span
        at, read = pos0 + 1, 0
        for n, op in ops:
            for k in range(n if op in "XD" else 0):
                if at + k <= stop:
                    want.add((c, at + k, f"{q};{int(outer[1]) if outer else 0}", "-" if op == "D" else seq[read + k], None if op == "D" else qual[read + k]))
            at += n * (op in "MDN=X")
            read += n * (op in "MIS=X")
    got = phasing.snp_calls(spark.createDataFrame(rows, READS).repartition(3)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50
