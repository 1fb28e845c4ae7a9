"""Command line: alignments to VCF, and random positions for the depth sample.

    python -m breakline reads.bam -o calls.vcf [-c config.ini] [-b positions.bed] [-f snps.vcf]
    python -m breakline positions genome.txt -o positions -n 1000000 [--mask repeats.bed] [--mask gaps.bed]

The output is a folder of text parts, as Spark writes them; `--single` also writes one file, which the tasks
write in parts and the commit joins: BGZF where its name ends on .gz, with an index if in order of positions.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.functions import cigar as C
from breakline.operators import coverage, phasing, sampling, segments
from breakline.operators.pileup import pileup
from breakline.plans.calling import Call, call
from breakline.plans.phase import phased
from breakline.shared import saved
from breakline.sources import bam, text, vcf

log = logging.getLogger("breakline")


def read_alignments(spark: SparkSession, path: str, sequence: bool = True) -> tuple[DataFrame, list[tuple[str, int]], str]:
    """(alignments, contigs, sample name) of a BAM or SAM file; BAM must not name another order."""
    if path.endswith(".sam"):
        contigs = [(r["rname"], r["length"]) for r in text.read_contigs(spark, path).orderBy("ord").collect()]
        head = "\n".join(r[0] for r in spark.read.text(path).where(F.col("value").startswith("@RG")).limit(1).collect())
        return text.read_sam(spark, path), contigs, bam.Header(head, contigs).sample(path.removesuffix(".sam"))
    header = bam.read_header(path)
    if not header.sorted:
        sys.exit(f"{path} is not sorted by coordinate")
    bam.register(spark)
    return spark.read.format("bam").option("path", path).option("sequence", sequence).load(), header.contigs, header.sample(path)


def to_segments(alignments: DataFrame, config: CallConfig) -> DataFrame:
    """Kept segments with read length, one for each read and clip.

    Where several share them the last counts, by position, strand, chunk, quality and a hash of the
    alignment's CIGAR.
    """
    ops = C.operations(F.col("cigar"))
    mapped = alignments.where(F.col("cigar") != "*").withColumns({"rlength": C.total(ops, "MISH=X"), "mark": F.xxhash64("cigar")})
    cut = segments.keep_segments(segments.split_alignments(mapped, config), config)
    return segments.dedup_segments(cut, ["rname", "pos", "flag", "chunk", "mapq", "mark"])


def used_snps(alignments: DataFrame, rows: DataFrame, given: DataFrame | None, config: CallConfig) -> tuple[DataFrame, DataFrame]:
    """(SNP positions, calls): given positions by a pileup, else positions discovered in the alignments."""
    if given is None:
        calls = saved(phasing.snp_calls(alignments, config), "snp-calls")
        found = phasing.accepted(phasing.discovered(calls, rows.select("rname", "pos", "stop"), config), config)
    else:
        ops = C.operations(F.col("cigar"))
        whole = alignments.where(F.col("seq").isNotNull() & (F.col("cigar") != "*"))
        kept = segments.keep_segments(whole.withColumn("pid", C.identity(F.col("md"), ops, C.total(ops, "MI=X"))), config)
        bases = pileup(kept, given.select(F.col("chr").alias("rname"), "pos")).where("base <> '>'")
        key = F.concat_ws(";", F.col("qname").cast("string"), F.col("clip").cast("string"))
        calls = saved(bases.select(F.col("rname").alias("chr"), "pos", key.alias("seg_key"), "base", "qual"), "snp-calls")
        found = phasing.accepted(phasing.top_alleles(phasing.allele_counts(calls, config)), config, given=True)
    return saved(found.select("chr", "pos"), "snps"), calls


def run(spark: SparkSession, path: str, config: CallConfig, bed: str | None = None, snps: str | None = None) -> tuple[Call, list[str], DataFrame | None]:
    """(call, VCF header, SNP positions used for phasing)."""
    alignments, contigs, sample_name = read_alignments(spark, path)
    plain = read_alignments(spark, path, sequence=False)[0]
    rows = saved(to_segments(plain, config), "segments")
    runs = hist = None
    if config.depth_support and bed is not None:
        # Depth counts every mapped alignment, kept or not, and every base of the intervals.
        runs = saved(coverage.depth_runs(segments.aligned_blocks(plain)), "depth-runs")
        hist = saved(coverage.interval_histogram(text.read_bed(spark, bed), runs), "depth-sample")
        if not hist.agg(F.sum("n")).first()[0]:
            sys.exit(f"{bed} holds no positions")
    made = call(rows, config, hist, runs, lambda at: coverage.aligned_bases(pileup(alignments, at)))
    used = None
    if config.phasing_on:
        used, calls = used_snps(alignments, rows, text.read_snps(spark, snps, False if config.bed_start_is_position else None) if snps else None, config)
        made.calls = phased(made, rows, used, calls, config)
    return made, vcf.header(contigs, sample_name, config, " ".join(sys.argv)), used


def positions(argv: list[str]) -> None:
    """Random positions outside masks as BED, for -b."""
    parser = argparse.ArgumentParser(prog="breakline positions", description="Draw random positions outside masks.")
    parser.add_argument("genome", help="two columns: contig, length")
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("-n", type=int, default=1_000_000)
    parser.add_argument("--mask", action="append", default=[], help="BED of intervals to leave out; may be repeated")
    parser.add_argument("--numbers", action="store_true", help="contigs are numbers: masks lose 'chr', X and Y become 23 and 24")
    parser.add_argument("--seed", type=int, default=1)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("breakline").getOrCreate()
    contigs = text.read_genome(spark, args.genome)
    masks = [text.read_bed(spark, m) for m in args.mask]
    mask = sampling.merged_masks(*masks) if masks else spark.createDataFrame([], "rname string, start long, stop long")
    if args.numbers:
        mask = sampling.read_mask(mask, contigs)
    drawn = sampling.sample_positions(spark, contigs, mask, args.n, args.seed)
    drawn.select("rname", F.col("position") - 1, "position").sort("rname", "position").write.csv(args.output, sep="\t")


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] == "positions":
        return positions(argv[1:])
    parser = argparse.ArgumentParser(prog="breakline", description="Call structural variants from long-read alignments.")
    parser.add_argument("alignments")
    parser.add_argument("-o", "--output", required=True, help="folder for the VCF parts")
    parser.add_argument("-c", "--config", help="INI file over the defaults")
    parser.add_argument("-b", "--bed", help="positions for the depth sample")
    parser.add_argument("-f", "--snp_file", help="SNP positions for phasing (VCF or BED)")
    parser.add_argument("-t", "--threads", default="*", help="local threads, if no master is set")
    parser.add_argument("--single", help="also write one file here")
    parser.add_argument("--by-position", action="store_true", help="order records by position")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("breakline").config("spark.master", f"local[{args.threads}]").getOrCreate()
    config = CallConfig.read(*([args.config] if args.config else []))
    log.info("calling")
    made, head, used = run(spark, args.alignments, config, args.bed, args.snp_file)
    log.info("writing")
    vcf.write_vcf(made.calls, head, args.output, args.by_position)
    if used is not None:
        text.write_snp_bed(used, f"{args.output}-snps")
    if args.single:
        vcf.write_single(made.calls, head, args.single, args.by_position)


if __name__ == "__main__":
    main()
