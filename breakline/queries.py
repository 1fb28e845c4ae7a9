"""Registered queries over the driver's tables, each `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.functions import cigar as C
from breakline.operators import annotate, clusters, coverage, evidence, phasing, sampling, segments
from breakline.operators import junctions as J
from breakline.operators.pileup import pileup
from breakline.plans import calling, phase
from breakline.plans import fixtures as X
from breakline.shared import saved, scratch, tidy
from breakline.sources import vcf
from breakline.streaming.sessions import sessions

CONFIG = CallConfig()
SIDES = ["qname", "clip", "rname1", "pos1", "flag1", "mapq1", "pid1", "rname2", "pos2", "flag2", "mapq2", "pid2", "gap", "rlength"]
VARIANT = ["svtype", "chr", "chr2", "flag1", "flag2", "dv", "pos", "end"]


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments, written, for queries whose steps read them several times."""
    return saved(X.segments(spark, sf_dir), "segments")


def split_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segments.split_alignments(X.alignments(spark, sf_dir), CONFIG)
    return out.select("qname", "ln", F.col("chunk").cast("long").alias("chunk"), "pos", "stop", "length", "clip", "clip_2")


def clip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, trail = C.clips(F.col("cigar"), F.col("flag"))
    return X.alignments(spark, sf_dir).select("qname", "ln", lead.alias("clip"), trail.alias("clip_2"))


def pid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alignments(spark, sf_dir).withColumn("ops", C.operations(F.col("cigar")))
    rows = rows.withColumn("pid", C.identity(F.col("md"), F.col("ops"), C.total(F.col("ops"), "MI=X")))
    return segments.keep_segments(rows, CONFIG).select("qname", "ln", "mapq", "pid")


def dedup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "qname", "l_linenumber": "clip"})
    return segments.dedup_segments(rows, ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).select("qname", "clip", "l_partkey", "l_suppkey")


def read_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.read_segments(X.segments(spark, sf_dir), CONFIG).select("qname", "n_segments", "clip", "pos")


def read_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.adjacent(X.segments(spark, sf_dir), CONFIG).select(*SIDES)


def junction_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.canonical(J.adjacent(X.segments(spark, sf_dir), CONFIG)).select(*SIDES)


def junction_svtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.junctions(X.segments(spark, sf_dir), CONFIG).select("svtype", *SIDES)


def hanging_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.hanging_ends(X.segments(spark, sf_dir), CONFIG).select("rname", "side", "pos", "qname", "clip", "mapq", "rlength")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(J.junctions(X.segments(spark, sf_dir), CONFIG), CONFIG)


def gap_cluster_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(J.junctions(X.segments(spark, sf_dir), CONFIG), "junctions")
    made = clusters.gap_clusters(rows, clusters.REGION, ["pos1", "pos2", "qname", "clip"], CONFIG.cluster_distance, "c1")
    name = [*clusters.REGION, "c1"]
    of = made.groupBy(*name).agg(F.min("pos1").alias("cluster_start"), F.count(F.lit(1)).alias("cluster_size"))
    return made.join(of, name).select("qname", "clip", "svtype", "cluster_start", "cluster_size")


def gap_cluster_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _clustered(spark, sf_dir)
    of = made.groupBy(*clusters.CLUSTER).agg(F.min("pos1").alias("start1"), F.min("pos2").alias("start2"), F.count(F.lit(1)).alias("cluster_size"))
    return made.join(of, clusters.CLUSTER).select("qname", "clip", "svtype", "start1", "start2", "cluster_size")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.detect(X.segments(spark, sf_dir), CONFIG)[1]


def sv_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("svtype", "chr", "chr2", "flag1", "flag2", "dv", F.concat_ws(",", "alt_read_ids").alias("alt_read_ids"))


def _call(spark: SparkSession, sf_dir: str, depth: bool = True) -> calling.Call:
    rows = _segments(spark, sf_dir)
    if not depth:
        return calling.call(rows, CONFIG)
    runs, sample = _depths(spark, rows)
    return calling.call(rows, CONFIG, sample, runs)


def sv_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    made, found = calling.detect(rows, CONFIG)
    hung = evidence.hanging_support(found, J.hanging_ends(rows, CONFIG), CONFIG)
    out = found.join(evidence.side_medians(made, found, hung), "sv_id")
    rounded = [F.round(c, 6).alias(c) for c in ("pid_med1", "pid_med2", "plen_med1", "plen_med2")]
    return out.select("svtype", "chr", "chr2", "pos", "end", "mapq_med1", "mapq_med2", *rounded, "rlength_med", "gap")


def sv_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select(*VARIANT, "cipos_lo", "cipos_hi", "ciend_lo", "ciend_hi")


def sv_hanging_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    found = calling.detect(rows, CONFIG)[1]
    return evidence.hanging_support(found, J.hanging_ends(rows, CONFIG), CONFIG).select("sv_id", "bp_side", "rname", "side", "pos", "qname", "clip")


def ref_read_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return evidence.reference_reads(calling.detect(rows, CONFIG)[1], rows, CONFIG)


def sv_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    made, found = calling.detect(rows, CONFIG)
    out = evidence.support(made, found, evidence.hanging_support(found, J.hanging_ends(rows, CONFIG), CONFIG), evidence.reference_reads(found, rows, CONFIG))
    return out.select("sv_id", "dv", "hr_1", "hr_2", "dr_1", "dr_2", F.round("vo", 6).alias("vo"), F.round("ro", 6).alias("ro"), "gt", F.concat_ws(",", F.transform("pl", lambda x: x.cast("string"))).alias("pl"), "gq", "qual")


def sv_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call(spark, sf_dir).calls.select("sv_id", "svcluster")


def sv_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call(spark, sf_dir).calls.where("mate_id is not null").select("sv_id", "mate_id")


def sv_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call(spark, sf_dir).calls.select("sv_id", "svtype", F.concat_ws(";", "filters").alias("filters"))


def sv_alt_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call(spark, sf_dir).calls.select("sv_id", annotate.alt_notation(F.col("ref")).alias("alt"), annotate.sv_length().alias("svlen"))


def _depths(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of depth, and the histogram of depths at the sampled positions."""
    runs = saved(coverage.depth_runs(rows.select("rname", "pos", "stop")), "depth-runs")
    return runs, saved(coverage.histogram(coverage.depth_at(_positions(spark), runs)), "depth-sample")


def _positions(spark: SparkSession) -> DataFrame:
    grid = spark.range(X.SAMPLE_COUNT).select((10000 + F.col("id") * X.SAMPLE_STEP).alias("position"))
    return grid.select(F.explode(F.array(*(F.lit(f"chr{i}") for i in (1, 2, 3)))).alias("rname"), "position")


def coverage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = coverage.depth_runs(X.segments(spark, sf_dir).select("rname", "pos", "stop"))
    return coverage.depth_at(_positions(spark), runs).select("rname", "position", F.col("depth").cast("long").alias("depth"))


def coverage_hist_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    runs, sample = _depths(spark, rows)
    tested = coverage.retyped(calling.detect(rows, CONFIG)[1], runs, sample).where("depth_pval is not null")
    return tested.select("sv_id", (F.col("flag1") == 16).alias("is_dup"), F.round("mean_depth", 6).alias("mean_depth"), F.round("depth_pval", 9).alias("pval"))


def sv_depth_retype(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    runs, sample = _depths(spark, rows)
    return coverage.retyped(calling.detect(rows, CONFIG)[1], runs, sample).select("sv_id", "chr", "pos", "end", "svtype")


def ref_base_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.aligned_bases(X.pileup(spark, sf_dir).withColumnRenamed("chr", "rname"))


def pileup_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of the reads with sequences at the asked positions."""
    with tidy(spark):
        found = pileup(X.bases(spark, sf_dir), X.spots(spark, sf_dir))
    return found.select("rname", "pos", "qname", "clip", "base", F.col("qual").cast("long").alias("qual"))


def snp_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNPs of the reads with sequences: alleles of every called position, '=' among them, and whether it is accepted."""
    reads = saved(X.bases(spark, sf_dir), "reads")
    kept = segments.keep_segments(segments.split_alignments(reads, CONFIG), CONFIG)
    alleles = saved(phasing.discovered(saved(phasing.snp_calls(reads, CONFIG), "snp-calls"), kept.select("rname", "pos", "stop"), CONFIG), "alleles")
    taken = phasing.accepted(alleles, CONFIG).select("chr", "pos", F.lit(1).alias("accepted"))
    return alleles.join(taken, ["chr", "pos"], "left").na.fill(0, ["accepted"])


def bed_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bases of the intervals have each depth of mapped alignments."""
    runs = saved(coverage.depth_runs(segments.aligned_blocks(X.alignments(spark, sf_dir))), "depth-runs")
    return coverage.interval_histogram(_masks(spark, sf_dir), runs)


def _alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.top_alleles(phasing.allele_counts(X.pileup(spark, sf_dir), CONFIG))


def snp_allele_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alleles(spark, sf_dir)


def snp_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.accepted(_alleles(spark, sf_dir), CONFIG).select("chr", "pos", "total", "base1", "base2")


def _snps(calls: DataFrame) -> DataFrame:
    """Here a SNP is a grid position with two bases."""
    return calls.groupBy("chr", "pos").agg(F.countDistinct("base").alias("n")).where("n >= 2").select("chr", "pos")


def _read_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Genotyped calls, and reads by SNPs around every heterozygous one; what led to them is deleted."""
    with tidy(spark), scratch() as keep:
        rows = _segments(spark, sf_dir)
        calls = saved(X.pileup(spark, sf_dir, rows), "pileup")
        made = calling.genotyped(rows, CONFIG)  # retyping by depth changes neither genotypes nor cells
        return keep(made.calls), keep(saved(phase.read_rows(made, rows, saved(_snps(calls), "snps"), calls, CONFIG), "read-rows"))


def phase_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.cells(_read_rows(spark, sf_dir)[1])


def phase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read_rows(spark, sf_dir)[1]
    with tidy(spark):
        pairs = phasing.class_pairs(rows)
    return phasing.read_pairs(pairs.withColumn("similarity", F.round("similarity", 9)))


def phase_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the purer side of every heterozygous variant; 0 and no p-value where no SNP is near."""
    calls, rows = _read_rows(spark, sf_dir)
    scored = phase.scored(calls, rows, CONFIG).where("gt = '0/1'")
    return scored.select("sv_id", F.col("purity_score").alias("purity"), F.col("phasing_score").alias("phasing"), F.col("phasing_pvalue").alias("pvalue"), "snps_used")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), (key % 3 + 1).cast("string")).alias("rname"), (10000 + (key * 6151) % 790000).alias("position"), "o_orderkey")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.merged_masks(X.mask(spark, sf_dir, "repeats"), X.mask(spark, sf_dir, "gaps"))


def mask_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.without_masked(_points(spark, sf_dir), _masks(spark, sf_dir))


def union_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir)


def contig_asof_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = X.contigs(spark, sf_dir)
    total = contigs.agg(F.sum("length")).first()[0]
    offsets = X.table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % total).alias("offset"))
    return sampling.place(offsets, contigs, "offset").select("o_orderkey", "rname", "position")


def events_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(X.table(spark, sf_dir, "events"), "6 hours").select("user_id", "first_ts", "last_ts", "n", F.round("total", 6).alias("total"))


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.record_lines(_call(spark, sf_dir).calls)


def sv_call_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call: junctions, clusters, evidence, genotypes, depth, density, mates and filters."""
    measured = (F.round("depth_pval", 9).alias("depth_pval"), "svcluster", "mate_id", F.concat_ws(";", "filters").alias("filters"))
    return _call(spark, sf_dir).calls.select("sv_id", *VARIANT, "gt", "gq", "qual", "dr_1", "dr_2", "hr_1", "hr_2", *measured)


_LIST = (
    split_cigar, clip_extract, pid_filter, dedup_segments, read_split_filter, read_junctions, junction_canonical, junction_svtype, hanging_ends, gap_cluster_l1, gap_cluster_l2,
    sv_support, sv_medians, sv_ci, sv_hanging_join, ref_read_range_join, sv_genotype, sv_density, sv_mates, sv_filters, sv_alt_notation, coverage_depth, coverage_hist_pvalue,
    sv_depth_retype, bed_depth, pileup_bases, snp_discovery, ref_base_mode, snp_allele_top2, snp_accept, phase_matrix, phase_similarity, phase_cluster, mask_anti_join, contig_asof_offset, events_sessionize, union_masks,
    vcf_lines, sv_call_flagship,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _LIST}
