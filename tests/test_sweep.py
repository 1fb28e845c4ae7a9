"""Streams over the genome equal batch, drop late rows, and go on from a checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.operators import clusters, phasing
from breakline.streaming import sweep

CONTIGS = [("c1", 50_000, 0), ("c2", 50_000, 1), ("end", 10**9, 2)]
JUNCTION = "svtype string, rname1 string, rname2 string, flag1 int, flag2 int, pos1 long, pos2 long, qname string, clip long"


@pytest.fixture(autouse=True)
def store(spark):
    sweep.prepare(spark)


def junctions(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        c = rng.choice(["c1", "c2"])
        rows.append(("BND", c, "c2", rng.choice([0, 16]), 0, rng.choice([rng.randint(1, 50_000), 1000 * rng.randint(1, 9) + rng.randint(0, 40)]), rng.randint(1, 60) * 7, f"q{i}", 0))
    return sorted(rows, key=lambda r: (r[1], r[5]))


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, folder, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(folder)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return query


def read(spark, folder, schema):
    return spark.read.schema(schema).parquet(str(folder)).collect()


def batch_clusters(spark, rows):
    made = clusters.cluster(spark.createDataFrame(rows, JUNCTION))
    level1 = made.groupBy(*clusters.REGION, "c1").agg(F.min("pos1").alias("cluster_start"))
    of = made.groupBy(*clusters.CLUSTER).agg(F.min("pos1"), F.max("pos1"), F.min("pos2"), F.max("pos2"), F.count("*").alias("dv"))
    return sorted(tuple(r) for r in of.join(level1, [*clusters.REGION, "c1"]).select(*clusters.REGION, "cluster_start", *of.columns[-5:]).collect())


def test_both_levels_of_clusters_with_restart_and_late_rows(spark, tmp_path):
    rows = junctions()
    contigs = spark.createDataFrame(CONTIGS, "rname string, length long, ord int")
    source, out, point = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    rng = random.Random(2)
    cuts = [0, 90, 200, 310, len(rows)]
    pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for piece in pieces[:2]:
        write(spark, source, rng.sample(piece, len(piece)), JUNCTION)
    stream = lambda: sweep.gap_clusters(spark.readStream.schema(JUNCTION).option("maxFilesPerTrigger", 1).parquet(str(source)), contigs, 10, 60_000)
    run(stream(), out, point)
    before = len(read(spark, out, sweep.CLUSTERS))
    late = ("BND", "c1", "c2", 0, 0, 3, 3, "late", 0)
    for piece in [*pieces[2:], [("BND", "end", "end", 0, 0, 10**8, 1, "far", 0)], [late], [("BND", "end", "end", 0, 0, 2 * 10**8, 1, "far", 1)]]:
        write(spark, source, rng.sample(piece, len(piece)), JUNCTION)
    query = run(stream(), out, point)  # goes on from the checkpoint
    got = sorted(tuple(r) for r in read(spark, out, sweep.CLUSTERS) if r.rname1 != "end")
    assert got == batch_clusters(spark, rows) and before < len(got)
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_snp_positions_are_final_when_the_sweep_has_passed(spark, tmp_path):
    rng = random.Random(3)
    segments, calls = [], []
    for i in range(250):
        c, pos = rng.choice(["c1", "c2"]), rng.randint(1, 40_000)
        stop = pos + rng.choice([50, 900, 15_000])
        segments.append((c, pos, stop, pos))
        calls += [(c, p, rng.choice("ACGT-"), rng.choice([None, 5, 30]), pos, f"{i}") for p in range(pos, stop + 1) if p % 100 == 0 and rng.random() < 0.5]
    contigs = spark.createDataFrame(CONTIGS, "rname string, length long, ord int")
    call, segment = "chr string, pos long, base string, qual int, start long, seg_key string", "rname string, pos long, stop long, start long"
    end = [("end", 10**8, 10**8 + 5, 10**8)]
    order = lambda r: (r[0], r[-2] if len(r) == 6 else r[3])
    for rows, schema, name in ((calls, call, "calls"), (segments, segment, "segments")):
        rows = sorted(rows, key=order)
        half = len(rows) // 2
        for piece in (rows[:half], rows[half:], *([end] if name == "segments" else [])):
            write(spark, tmp_path / name, rng.sample(piece, len(piece)), schema)
    source = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    config = CallConfig()
    run(sweep.snp_alleles(source("calls", call), source("segments", segment), contigs, config, 90_000, 7000), tmp_path / "out", tmp_path / "check")
    got = sorted((tuple(r) for r in read(spark, tmp_path / "out", sweep.ALLELES)), key=str)
    want = phasing.discovered(spark.createDataFrame(calls, call), spark.createDataFrame(segments, segment), config)
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and len(got) > 100
