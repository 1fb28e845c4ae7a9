"""Worked cases and properties of the structural-variant operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.functions import cigar as C
from breakline.functions.genotype import with_genotype
from breakline.operators import annotate, clusters, coverage, evidence, phasing, sampling, segments
from breakline.operators import junctions as J
from breakline.operators.range_join import binned_intervals, range_join
from breakline.sources import vcf
from breakline.streaming.sessions import position_sessions, sessions

SPLITS = [
    ("50S100M20H", [(1001, 1100, 100, 50, 20)], [(1001, 1100, 100, 20, 50)]),
    ("10S100M40I60M5S", [(1001, 1100, 100, 10, 105), (1101, 1160, 60, 150, 45)], [(1001, 1100, 100, 105, 10), (1101, 1160, 60, 5, 110)]),
    ("10S100M35D60M5S", [(1001, 1100, 100, 10, 65), (1136, 1195, 60, 110, 5)], [(1001, 1100, 100, 65, 10), (1136, 1195, 60, 5, 110)]),
    ("100M29D100M30D50M", [(1001, 1229, 200, 0, 50), (1260, 1309, 50, 200, 0)], [(1001, 1229, 200, 50, 0), (1260, 1309, 50, 0, 200)]),
    ("5H3S80M30I20M31D70M", [(1001, 1080, 80, 5, 120), (1081, 1100, 20, 115, 100), (1132, 1201, 70, 135, 30)], [(1001, 1080, 80, 120, 5), (1081, 1100, 20, 70, 85), (1132, 1201, 70, 0, 105)]),
]


def test_split_alignments(spark):
    rows = [(i, flag, "chr1", 1000, 60, c, None) for i, (c, _, _) in enumerate(SPLITS) for flag in (0, 16)] + [(99, 4, None, -1, 0, "*", None), (98, 0, "chr1", 1000, 60, "20M30D5S", None)]
    df = spark.createDataFrame(rows, "qname int, flag int, rname string, pos0 long, mapq int, cigar string, md string")
    got = {}
    for r in segments.split_alignments(df).orderBy("qname", "flag", "chunk").collect():
        got.setdefault((r.qname, r.flag), []).append((r.pos, r.stop, r.length, r.clip, r.clip_2))
    for i, (_, forward, back) in enumerate(SPLITS):
        assert got[i, 0] == forward and got[i, 16] == back
    assert (99, 4) not in got
    assert got[98, 0] == [(1001, 1020, 20, 0, 5)]  # the empty last chunk goes


def test_other_readings_of_quirks(spark):
    """Each switch changes what the register names, and nothing without it."""
    rows = [(i, flag, "chr1", 1000, 60, "10S100M40I60M5S", None) for i, flag in enumerate((0, 16))]
    df = spark.createDataFrame(rows, "qname int, flag int, rname string, pos0 long, mapq int, cigar string, md string")
    clips = lambda c: [(r.clip, r.clip_2) for r in segments.split_alignments(df, c).orderBy("qname", "chunk").collect()]
    assert clips(CallConfig()) == [(10, 65 + 0 * 40 + 40), (150, 45), (105, 10), (5, 110)]
    assert clips(CallConfig(count_cut_insertions=True)) == [(10, 105), (150, 5), (105, 10), (5, 150)]
    pair = spark.createDataFrame([("a", 100, 0, "b", 110, 0, 40)], "rname1 string, pos1 long, flag1 int, rname2 string, pos2 long, flag2 int, gap long")
    assert [J.typed(pair, c).first().svtype for c in (CallConfig(), CallConfig(one_contig_insertions=True))] == ["INS", "BND"]
    one = spark.createDataFrame([(1, "c", "c", 5, 9, 5, 9), (2, "c", "d", 5, 9, 5, 9)], "sv_id long, chr string, chr2 string, pos_lo long, pos_hi long, end_lo long, end_hi long")
    got = sorted((r.sv_id, r.bp_side) for r in evidence.breakends(one, CallConfig(merge_equal_breakends=True)).collect())
    assert got == [(1, 1), (2, 0), (2, 1)] and evidence.breakends(one).count() == 4


def test_split_keeps_read_bases(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        ops = "".join(f"{rng.randint(1, 60)}{rng.choice('MDI')}" for _ in range(rng.randint(1, 9)))
        rows.append((i, rng.choice([0, 16]), "c", 10, 50, f"{rng.randint(1, 30)}S{ops}{rng.randint(1, 30)}M", None))
    df = spark.createDataFrame(rows, "qname int, flag int, rname string, pos0 long, mapq int, cigar string, md string")
    ops = C.operations(F.col("cigar"))
    whole = {r.qname: (r.total, r.ins) for r in df.select("qname", C.total(ops, "MI=X").alias("total"), F.aggregate(F.filter(ops, lambda o: (o["op"] == "I") & (o["len"] >= 30)), F.lit(0).cast("long"), lambda a, o: a + o["len"]).alias("ins")).collect()}
    split = {r.qname: r.n for r in segments.split_alignments(df).groupBy("qname").agg(F.sum("length").alias("n")).collect()}
    for q, (total, ins) in whole.items():
        assert split.get(q, 0) + ins == total


def test_identity(spark):
    df = spark.createDataFrame([("50A49", "100M"), (None, "90=10X"), (None, "80M20I"), (None, "5S")], "md string, cigar string")
    ops = C.operations(F.col("cigar"))
    assert [r[0] for r in df.select(C.identity(F.col("md"), ops, C.total(ops, "MI=X"))).collect()] == [0.99, 0.9, 0.8, None]


GENOTYPES = [
    (0.0, 4.0, "1/1", [118, 10, 0], 10, 118),
    (4.0, 4.0, "0/1", [96, 0, 17], 17, 96),
    (20.0, 4.0, "0/1", [47, 0, 129], 47, 47),
    (10.5, 9.25, "0/1", [218, 0, 49], 49, 218),
    (9.9, 0.5, "0/0", [0, 16, 84], 16, 0),
    (40.0, 2.0, "0/0", [0, 66, 340], 66, 0),
    (2000.0, 2000.0, "0/1", [9999, 0, 9999], 9999, 9999),
]


def test_genotypes(spark):
    df = spark.createDataFrame([(i, r, a) for i, (r, a, *_) in enumerate(GENOTYPES)], "i int, ro double, vo double")
    for r in with_genotype(df, "ro", "vo").collect():
        assert (r.gt, r.pl, r.gq, r.qual) == GENOTYPES[r.i][2:]


def test_genotype_grows_with_support(spark):
    df = spark.range(0, 40).select((F.col("id") * 1.0).alias("vo"), F.lit(20.0).alias("ro"))
    order = ["0/0", "0/1", "1/1"]
    got = [order.index(r.gt) for r in with_genotype(df, "ro", "vo").orderBy("vo").collect()]
    assert got == sorted(got)


CANON = [
    (("chr1", 100, 0, "chr1", 500, 0, 0), ("BND", "chr1", 100, 0, "chr1", 500, 0)),
    (("chr1", 500, 0, "chr1", 100, 0, 0), ("BND", "chr1", 100, 16, "chr1", 500, 16)),
    (("chr2", 100, 0, "chr10", 50, 16, 0), ("BND", "chr10", 50, 0, "chr2", 100, 16)),
    (("chr1", 100, 0, "chr1", 101, 0, 40), ("INS", "chr1", 100, 0, "chr1", 101, 0)),
    (("chr1", 100, 0, "chr2", 105, 16, 40), ("INS", "chr1", 100, 0, "chr2", 101, 0)),
    (("chr1", 100, 0, "chr1", 140, 0, 40), ("BND", "chr1", 100, 0, "chr1", 140, 0)),
]


def test_canonical_and_typed(spark):
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(CANON)], "i int, rname1 string, pos1 long, flag1 int, rname2 string, pos2 long, flag2 int, gap long")
    for side in (1, 2):
        df = df.withColumns({f"{c}{side}": F.lit(1) for c in ("mapq", "pid", "plen")})
    for r in J.typed(J.canonical(df)).collect():
        assert (r.svtype, r.rname1, r.pos1, r.flag1, r.rname2, r.pos2, r.flag2) == CANON[r.i][1]


def _junctions(spark, points, **fixed):
    rows = [(q, 0, "BND", "c", a, 0, "c", b, 0) for q, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "qname int, clip int, svtype string, rname1 string, pos1 long, flag1 int, rname2 string, pos2 long, flag2 int")


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.c1, r.c2), set()).add((r.pos1, r.pos2))
    return sorted(map(sorted, out.values()))


def test_clusters(spark):
    assert _groups(clusters.cluster(_junctions(spark, [(p, 1) for p in (1, 11, 21, 32)]))) == [[(1, 1), (11, 1), (21, 1)], [(32, 1)]]
    assert _groups(clusters.cluster(_junctions(spark, [(1, 100), (5, 300), (9, 102)]))) == [[(1, 100), (9, 102)], [(5, 300)]]


def test_clusters_do_not_depend_on_order(spark):
    rng = random.Random(1)
    points = list({(rng.randint(0, 800), rng.randint(0, 800)) for _ in range(120)})
    one = _groups(clusters.cluster(_junctions(spark, points)))
    rng.shuffle(points)
    assert one == _groups(clusters.cluster(_junctions(spark, points)))
    assert sum(map(len, one)) == len(points)


def plain_runs(rows, distance):
    """{(key, position, tie): number} by a loop over sorted rows; None sorts first and ends a run."""
    out, last = {}, {}
    for k, p, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        before, n = last.get(k, (None, 0))
        n += not (before is not None and p is not None and p - before <= distance)
        out[k, p, t], last[k] = n, (p, n)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_gap_clusters_equal_a_loop(spark, partitions):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 900)]), i) for i in range(400)] + [("hot", 3 * i, i) for i in range(3000)] + [("hot", 10_000 + 20 * i, i) for i in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(rows, "k string, p long, t int").repartition(5)
        got = clusters.gap_clusters(df, ["k"], ["p", "t"], 10, "c").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {(r.k, r.p, r.t): r.c for r in got} == plain_runs(rows, 10) and len(got) == len(rows)
    assert clusters.gap_clusters(df.limit(0), ["k"], ["p", "t"], 10, "c").count() == 0


def test_one_endless_run_is_many_tasks(spark):
    """One key, one chain: no task has over two shares of the rows, and the chain is one cluster."""
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") * 2).alias("p"), "id")
        made = clusters.gap_clusters(rows, ["k"], ["p", "id"], 10, "c")
        plan = made._jdf.queryExecution().executedPlan().toString()
        tasks = spark.read.parquet(*made.inputFiles()).where("_run is not null").groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert "Window" not in plan.split("BroadcastExchange")[0]
    assert len(tasks) == 20 and max(r["count"] for r in tasks) <= 2 * 200_000 / 20
    assert [r.c for r in made.select("c").distinct().collect()] == [1]


def test_numbered(spark):
    df = spark.createDataFrame([("b", 5), ("a", 3_000_000), ("a", 1), ("b", 2), ("a", 2)], "k string, p long")
    assert [(r.k, r.p) for r in clusters.numbered(df, ["k"], ["p"], "n").orderBy("n").collect()] == [("a", 1), ("a", 2), ("a", 3_000_000), ("b", 2), ("b", 5)]


def test_range_join_equals_plain_join(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, rng.choice("ab"), rng.randint(-500, 500)) for i in range(200)], "i int, k string, p long")
    spans = spark.createDataFrame([(i, rng.choice("ab"), (a := rng.randint(-500, 500)), a + rng.randint(-20, 200)) for i in range(80)], "j int, k string, lo long, hi long")
    plain = points.alias("x").join(spans.alias("y"), F.expr("x.k = y.k and p between lo and hi")).select("i", "j")
    for width in (1, 37, 1000):
        assert sorted(range_join(points, "p", spans, "lo", "hi", ["k"], width).select("i", "j").collect()) == sorted(plain.collect())


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_range_join_of_short_and_very_long_intervals(spark, how):
    """Intervals of 1 to 10^7 bases against a plain join; each has two rows at most."""
    rng = random.Random(6)
    spots = [rng.randint(-1000, 20_000_000) for _ in range(60)]
    lengths = [1, 2, 3, 1999, 2000, 2001, 7999, 8000, 8001, 31_999, 32_001, 10**5, 10**6, 10**7]
    spans = [(i, rng.choice("ab"), (a := rng.choice(spots) - rng.randint(0, n)), a + n - 1) for i, n in enumerate(lengths * 9)] + [(900, "a", 5, 4), (901, None, 1, 10**7), (902, "a", None, 9)]
    points = [(i, rng.choice("ab"), p) for i, p in enumerate(spots * 3)] + [(500, None, spots[0]), (501, "a", None), *((600 + i, k, x) for i, (_, k, a, b) in enumerate(spans[:126]) for x in (a, b))]
    p, s = spark.createDataFrame(points, "i int, k string, p long"), spark.createDataFrame(spans, "j int, k string, lo long, hi long")
    joined = range_join(p, "p", s, "lo", "hi", ["k"], 2000, how)
    hit = [(i, j) for i, k, x in points for j, q, a, b in spans if None not in (k, x, q, a, b) and k == q and a <= x <= b]
    if how == "inner":
        assert sorted((r.i, r.j) for r in joined.collect()) == sorted(hit)
        sizes = binned_intervals(s, "lo", "hi", 2000).groupBy("j").count().collect()
        assert max(r["count"] for r in sizes) == 2 and len(sizes) == len(spans) - 2
    else:
        assert sorted(r.i for r in joined.collect()) == sorted(r[0] for r in points if (r[0] in {i for i, _ in hit}) == (how == "left_semi"))


def test_depth_and_test(spark):
    blocks = spark.createDataFrame([("c", 5, 14), ("c", 10, 30), ("c", 10, 10)], "rname string, pos long, stop long")
    runs = coverage.depth_runs(blocks, 8)
    at = spark.createDataFrame([("c", p) for p in range(1, 40)], "rname string, position long")
    got = {r.position: r.depth for r in coverage.depth_at(at, runs, 8).collect()}
    for p in got:
        assert got[p] == (5 <= p <= 14) + (10 <= p <= 30) + (p == 10)
    regions = spark.createDataFrame([(1, "c", 20, 1), (2, "c", 100, 120)], "id int, rname string, `from` long, `to` long")
    means = {r.id: r.mean_depth for r in coverage.region_depth(regions, runs, 8).collect()}
    assert means == {1: pytest.approx(sum(got[p] for p in range(1, 21)) / 20), 2: 0.0}
    sample = spark.createDataFrame([(d,) for d in (0, 1, 1, 2, 5)], "depth long")
    asked = spark.createDataFrame([(i, dup, m) for i, (dup, m) in enumerate([(True, 1.0), (True, 9.0), (False, 1.0), (False, 0.0), (False, 1.5), (True, 4.5), (False, 99.0)])], "id int, is_dup boolean, mean_depth double")
    assert [r.pval for r in coverage.depth_test(asked, coverage.histogram(sample)).orderBy("id").collect()] == [0.4, 0.0, 0.2, 0.0, 0.6, 0.2, 1.0]


def test_reference_base(spark):
    df = spark.createDataFrame([("c", 1, b) for b in "TTAAC"] + [("c", 2, "-")], "rname string, pos long, base string")
    assert [tuple(r) for r in coverage.aligned_bases(df).collect()] == [("c", 1, "A", 2)]


def _variants(spark):
    rows = [(1, "c", "c", 100, 900, 0, 0), (2, "c", "c", 110, 950, 16, 16), (3, "c", "c", 90, 905, 0, 0), (5, "c", "c", 120, 900, 16, 16), (6, "c", "d", 100, 900, 16, 16), (7, "c", "c", 5000, 9000, 0, 16)]
    return spark.createDataFrame([(*r, "BND", "0/1") for r in rows], "sv_id long, chr string, chr2 string, pos long, `end` long, flag1 int, flag2 int, svtype string, gt string")


def test_density_and_mates(spark):
    assert {r.sv_id: r.svcluster for r in annotate.density(_variants(spark)).collect()} == {1: 4, 2: 4, 3: 4, 5: 4, 6: 1, 7: 1}
    assert {r.sv_id: r.mate_id for r in annotate.mates(_variants(spark)).collect()} == {1: 5, 2: 3, 3: 5, 5: 3}


def test_alt_notation(spark):
    df = spark.createDataFrame([("BND", 16, 16), ("BND", 16, 0), ("BND", 0, 16), ("BND", 0, 0), ("INS", 0, 0)], "svtype string, flag1 int, flag2 int").withColumns({"chr2": F.lit("c"), "end": F.lit(7)})
    assert [r[0] for r in df.select(annotate.alt_notation(F.lit("N"))).collect()] == ["]c:7]N", "[c:7[N", "N]c:7]", "N[c:7[", "<INS>"]


def test_snp_calls(spark):
    row = [("r", 0, "c", 99, "2S3=1X2D2=", "ACGTATTG", list(range(8)), None), ("m", 0, "c", 99, "2S4M1I2D2M", "ACGTATTGC", list(range(9)), "1A2^GG0T1")]
    df = spark.createDataFrame(row, "qname string, flag int, rname string, pos0 long, cigar string, seq string, qual array<int>, md string")
    gone = lambda q: [("c", 104, q, "-", None), ("c", 105, q, "-", None)]
    got = sorted(map(tuple, phasing.snp_calls(df.withColumn("mapq", F.lit(60)), CallConfig(min_pid=0.0)).collect()), key=lambda r: (r[2], r[1]))
    assert got == [("c", 101, "m;2", "T", 3), *gone("m;2"), ("c", 106, "m;2", "G", 7), ("c", 103, "r;2", "T", 5), *gone("r;2")]


def test_snp_discovery_counts_matching_reads(spark):
    """20 reads over one position, half of them with another base: a heterozygous SNP; half of 4: not."""
    calls = spark.createDataFrame([("c", 103, f"r{i}", "T", 30) for i in range(10)] + [("d", 103, f"r{i}", "T", 30) for i in range(2)], "chr string, pos long, seg_key string, base string, qual int")
    rows = spark.createDataFrame([("c", 90 + i % 5, 200) for i in range(20)] + [("d", 90, 200)] * 4 + [("c", 104, 200)] * 7, "rname string, pos long, stop long")
    found = phasing.accepted(phasing.discovered(calls, rows)).collect()
    assert [(r.chr, r.pos, r.total, r.base1, r.n1, r.base2, r.n2) for r in found] == [("c", 103, 20, "=", 10, "T", 10)]


def test_phasing_scores(spark):
    cells = [(1, 0, f"s{i}", 1, snp, "A") for i in range(4) for snp in range(5)] + [(1, 0, f"r{i}", 0, snp, "C") for i in range(4) for snp in range(5)]
    cells += [(1, 1, x, int(x == "s"), 3, "A") for x in ("s", "r", "t")]
    df = spark.createDataFrame(cells, "sv_id long, bp_side int, seg_key string, is_sv int, snp long, base string")
    got = {r.bp_side: (r.purity, r.phasing, r.pvalue, r.snps_used) for r in phasing.scores(df).collect()}
    assert got[0] == (100, 100, pytest.approx(2 / 70), 5)
    assert got[1][3] == 1 and 0 < got[1][2] <= 1
    assert phasing.best_scores(phasing.scores(df)).first().purity == 100


def test_merge_reads_means():
    s = np.array([[0, 0.9, 0.2, 0.1], [0.9, 0, 0.4, 0.1], [0.2, 0.4, 0, 0.1], [0.1, 0.1, 0.1, 0]])
    assert sorted(map(sorted, phasing.merge_reads(s, 0.25))) == [[0, 1, 2], [3]]
    assert sorted(map(sorted, phasing.merge_reads(s, 0.35))) == [[0, 1], [2], [3]]


def test_judge_needs_two_clusters():
    assert phasing.judge([(1, 1)], 1, 1) == (0, 0, None)


def test_hanging_and_evidence_columns(spark):
    rows = [("r", "c", 0, 100, 199, 60, 0.9, 25, 0, 100, 400), ("r", "c", 16, 500, 599, 60, 0.9, 130, 30, 100, 400), ("x", "c", 0, 1, 9, 60, 0.9, 50, 50, 9, 100)]
    df = spark.createDataFrame(rows, "qname string, rname string, flag int, pos long, stop long, mapq int, pid double, clip long, clip_2 long, length long, rlength long")
    assert sorted((r.side, r.pos) for r in J.hanging_ends(df).collect()) == [("H", 100), ("H", 500)]


def test_sampling(spark):
    contigs = spark.createDataFrame([("1", 1000, 0), ("2", 500, 1)], "rname string, length long, ord int")
    mask = sampling.read_mask(spark.createDataFrame([("chr1", 1, 900), ("chrX", 1, 9), ("chrUn", 1, 9)], "rname string, start long, stop long"), contigs)
    assert [tuple(r) for r in mask.collect()] == [("1", 1, 900)]
    got = sampling.sample_positions(spark, contigs, mask, 200, seed=4).collect()
    assert len(set(got)) == 200
    assert all((r.rname == "1" and 901 <= r.position <= 1000) or (r.rname == "2" and 1 <= r.position <= 500) for r in got)
    assert sorted(got) == sorted(sampling.sample_positions(spark, contigs, mask, 200, seed=4).collect())


def test_config(tmp_path):
    (tmp_path / "a.ini").write_text("[Filter]\nmin_pid = 0.8\n[Detection]\ndepth_support = false\n")
    config = CallConfig.read(str(tmp_path / "a.ini"))
    assert (config.min_pid, config.depth_support, config.max_split) == (0.8, False, 10)
    (tmp_path / "b.ini").write_text("[Filter]\nnothing = 1\n")
    with pytest.raises(ValueError):
        CallConfig.read(str(tmp_path / "b.ini"))


def test_vcf_header():
    lines = vcf.header([("c", 10)], "s", date="x")
    assert lines[0] == "##fileformat=VCFv4.1" and lines[-1].endswith("FORMAT\ts") and sum("##INFO" in x for x in lines) == 22


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions(stream, "6 hours", "3650 days").writeStream.outputMode("complete").format("memory").queryName("stream_sessions").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    keep = lambda df: sorted((r.user_id, r.first_ts, r.last_ts, r.n) for r in df.collect())
    assert keep(spark.table("stream_sessions")) == keep(sessions(events, "6 hours"))


def test_position_sessions_equal_first_level(spark):
    points = [(p, 1) for p in (1, 11, 21, 32, 100, 105, 116)]
    got = sorted((r.cluster_start, r.cluster_end, r.cluster_size) for r in position_sessions(_junctions(spark, points), clusters.REGION, 10).collect())
    assert got == [(1, 21, 3), (32, 32, 1), (100, 105, 2), (116, 116, 1)]
    made = clusters.cluster(_junctions(spark, points)).groupBy("c1").agg(F.min("pos1"), F.max("pos1"), F.count("*"))
    assert got == sorted(tuple(r)[1:] for r in made.collect())


def test_breakends_count_both_sides(spark):
    df = spark.createDataFrame([(1, "c", "c", 5, 9, 5, 9)], "sv_id long, chr string, chr2 string, pos_lo long, pos_hi long, end_lo long, end_hi long")
    assert evidence.breakends(df).count() == 2
