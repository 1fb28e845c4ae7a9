"""VCF text."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from breakline.config import CallConfig
from breakline.operators.annotate import alt_notation, sv_length
from breakline.sources import vcf_file

METHOD = "breakline_0.1"

# Id, number, type and text of the header lines.
INFO = """
IMPRECISE|0|Flag|Imprecise structural variant
SVTYPE|1|String|Type of structural variant
SVMETHOD|1|String|Type of approach used to detect SV
END|1|Integer|End position of structural variant
CIPOS|2|Integer|Confidence interval around POS
CIEND|2|Integer|Confidence interval around END
SVLEN|.|Integer|Distance between the two genomic positions
RT|3|Integer|Number of the different read types (2d, template, complement)
GAP|1|Integer|Median number of bases between the two segments of the SV, in case of an insertion this is the size of the insertion
MAPQ|2|Integer|Median mapping quality of the two segments of the structural variant
PID|2|Float|Median percentage identity to the reference of the two segments of the structural variant
PLENGTH|2|Float|Median segment length percentage of the two segments of the structural variant
RLENGTH|1|Integer|Median length of the total reads
MATEID|.|String|ID of mate breakend
PURITY_SCORE|.|Integer|Purity of clusters after phasing
PHASING_SCORE|.|Integer|Percentage of reads in two largest clusters after phasing
PHASING_PVALUE|.|Float|P-value of the purity of clusters
SNPS_USED|.|Integer|SNPs used during phasing
ALT_READ_IDS|.|String|Read ids of the supporting alt reads
REF_READ_IDS_1|.|String|Read ids of the supporting reference reads for bp1
REF_READ_IDS_2|.|String|Read ids of the supporting reference reads for bp2
"""
FORMAT = """
GT|1|String|Genotype
DR|2|Integer|Number of reference reads
DV|2|Integer|Number of variant reads
GQ|1|Integer|Genotype quality
HR|2|Integer|Number of hanging variant reads
PL|G|Integer|Normalized, Phred-scaled likelihoods for genotypes as defined in the VCF specification
"""
ALT = {"DEL": "Deletion", "DUP": "Duplication", "BND": "Breakend", "INS": "Insertion"}


def header(contigs: list[tuple[str, int]], sample: str, config: CallConfig = CallConfig(), command: str = "", date: str | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.1", f"##fileDate={date or datetime.now():%c}" if date is None else f"##fileDate={date}", f"##cmdline={command}"]
    out += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    extra = ["DEPTHPVAL|1|Float|In case of a duplication or deletion the P-value of the significance test is shown here"] if config.depth_support else []
    for kind, lines in (("INFO", [*INFO.strip().split("\n"), *extra]), ("FORMAT", FORMAT.strip().split("\n"))):
        for line in lines:
            name, number, type_, text = line.split("|")
            out.append(f'##{kind}=<ID={name},Number={number},Type={type_},Description="{text}">')
    out += [f'##ALT=<ID={k},Description="{v}">' for k, v in ALT.items()]
    flags = {
        "SVcluster": f"There are more than {config.svcluster} SVs in a window of {config.window_size} on both sides",
        "GAP": f"The median gap size is larger than {config.gap_flag} for non insertions",
        "MapQual": f"The median mapping quality is less than {config.mapq_flag}",
        "PID": f"The median PID of one of the two sides is less than {config.pid_flag:g}",
        "CIPOS": f"The CIPOS is greater than {config.ci_flag}",
        "CIEND": f"The CIEND is greater than {config.ci_flag}",
        "LowQual": f"QUAL score is less than {config.qual_flag}",
    }
    out += [f'##FILTER=<ID={k},Description="{v}">' for k, v in flags.items()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


@F.pandas_udf(StringType())
def decimals(x: pd.Series) -> pd.Series:
    """Three decimals of the exact binary value; no built-in function rounds its ties that way."""
    return pd.Series([None if pd.isna(v) else f"{v:.3f}" for v in x], index=x.index, dtype=object)


def info_text() -> Column:
    """INFO of a called variant; END is left out for a breakend, IMPRECISE for exact bounds."""
    c = F.col
    text = lambda *xs: F.concat_ws(",", *(x.cast("string") for x in xs))
    exact = (c("cipos_lo") == 0) & (c("cipos_hi") == 0) & (c("ciend_lo") == 0) & (c("ciend_hi") == 0)
    pair = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))
    parts = [
        F.when(~exact, F.lit("IMPRECISE")),
        pair("SVTYPE", c("svtype")),
        pair("SVMETHOD", F.lit(METHOD)),
        F.when(c("svtype") != "BND", F.concat(F.lit("END="), c("end").cast("string"))),
        pair("CIPOS", text(c("cipos_lo"), c("cipos_hi"))),
        pair("CIEND", text(c("ciend_lo"), c("ciend_hi"))),
        pair("SVLEN", sv_length().cast("string")),
        pair("RT", F.lit("0,0,0")),
        pair("GAP", c("gap").cast("string")),
        pair("MAPQ", text(c("mapq_med1"), c("mapq_med2"))),
        pair("PID", F.concat_ws(",", decimals(c("pid_med1")), decimals(c("pid_med2")))),
        pair("PLENGTH", F.concat_ws(",", decimals(c("plen_med1")), decimals(c("plen_med2")))),
        pair("RLENGTH", c("rlength_med").cast("string")),
        pair("MATEID", c("mate_id").cast("string")),
        pair("DEPTHPVAL", F.when(c("depth_pval").isNotNull(), decimals(c("depth_pval")))),
        pair("ALT_READ_IDS", F.concat_ws(",", "alt_read_ids")),
        pair("REF_READ_IDS_1", F.concat_ws(",", "ref_read_ids_1")),
        pair("REF_READ_IDS_2", F.concat_ws(",", "ref_read_ids_2")),
    ]
    return F.concat_ws(";", *parts)


def record_lines(calls: DataFrame) -> DataFrame:
    """sv_id, line: a record for each called variant, phasing fields behind where they are known."""
    two = lambda a, b: F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string"))
    sample = F.concat_ws(":", F.col("gt"), two("dr_1", "dr_2"), two("dv", "dv"), F.col("gq").cast("string"), two("hr_1", "hr_2"), F.concat_ws(",", F.transform("pl", lambda x: x.cast("string"))))
    info = info_text()
    for name in ("purity_score", "phasing_score", "phasing_pvalue", "snps_used"):
        if name in calls.columns:
            info = F.concat_ws(";", info, F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name.upper()}="), decimals(name) if name == "phasing_pvalue" else F.col(name).cast("string"))))
    failed = F.when(F.size("filters") == 0, F.lit("PASS")).otherwise(F.concat_ws(";", "filters"))
    line = F.concat_ws("\t", F.col("chr"), F.col("pos").cast("string"), F.col("sv_id").cast("string"), F.col("ref"), alt_notation(F.col("ref")), F.col("qual").cast("string"), failed, info, F.lit("GT:DR:DV:GQ:HR:PL"), sample)
    return calls.select("sv_id", line.alias("line"))


def write_vcf(calls: DataFrame, head: list[str], path: str, coordinate_order: bool = False) -> None:
    """Write text parts whose names sort in record order; the first part holds the header alone."""
    spark = calls.sparkSession
    order = ["chr", "pos", "sv_id"] if coordinate_order else ["sv_id"]
    spark.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.mode("errorifexists").text(f"{path}/part=0")
    ordered = record_lines(calls.orderBy(*order)).select("line")
    ordered.write.mode("errorifexists").text(f"{path}/part=1")


def write_single(calls: DataFrame, head: list[str], path: str, coordinate_order: bool = False) -> None:
    """Write one file; with a name on `.gz` as BGZF, and in order of positions with its index."""
    order = ["chr", "pos", "sv_id"] if coordinate_order else ["sv_id"]
    vcf_file.register(calls.sparkSession)
    lines = record_lines(calls.orderBy(*order)).select("line")
    told = {"path": path, "header": "".join(f"{x}\n" for x in head), "index": str(coordinate_order).lower()}
    lines.write.format("vcf_file").options(**told).mode("append").save()
