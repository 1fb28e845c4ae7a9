"""SAM, BED, SNP and genome files with Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text: the schema of the BAM source."""
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(part) >= 11))
    md = F.filter(F.slice(part, 12, F.size(part)), lambda t: t.startswith("MD:Z:"))
    qual = F.transform(F.split(part[10], ""), lambda c: F.ascii(c) - 33)
    return rows.select(
        part[0].alias("qname"),
        part[1].cast("int").alias("flag"),
        F.nullif(part[2], F.lit("*")).alias("rname"),
        (part[3].cast("long") - 1).alias("pos0"),
        part[4].cast("int").alias("mapq"),
        part[5].alias("cigar"),
        F.nullif(part[9], F.lit("*")).alias("seq"),
        F.when(part[10] != "*", qual).alias("qual"),
        F.substring(F.get(md, F.lit(0)), 6, 1 << 30).alias("md"),
    )


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """rname, length, ord of the @SQ lines of a SAM header, in their order."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    field = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]+)", 1)
    # The header is at the start of one file, so the row ids follow its order.
    return lines.select(field("SN").alias("rname"), field("LN").cast("long").alias("length"), F.monotonically_increasing_id().alias("ord"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """rname, start, stop: intervals with 1-based start and inclusive end."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="rname string, start long, stop long")
    return rows.where("start is not null").withColumn("start", F.col("start") + 1)


def read_snps(spark: SparkSession, path: str, bed: bool | None = None) -> DataFrame:
    """chr, pos of a SNP file: POS of a VCF, start + 1 of a BED (told by its name unless given)."""
    bed = path.rstrip("/").endswith(".bed") if bed is None else bed
    rows = spark.read.csv(path, sep="\t", comment="#", schema="chr string, pos long").where("pos is not null")
    return rows.withColumn("pos", F.col("pos") + int(bed))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """rname, length, ord of a two-column genome file."""
    return spark.read.csv(path, sep="\t", comment="#", schema="rname string, length long").withColumn("ord", F.monotonically_increasing_id())


def write_snp_bed(snps: DataFrame, path: str) -> None:
    """chr and position of retained SNPs, tab separated."""
    snps.select("chr", "pos").write.csv(path, sep="\t")
