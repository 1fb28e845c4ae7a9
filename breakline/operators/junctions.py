"""Reads to breakpoint junctions and hanging ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.functions.cigar import reverse
from breakline.operators.segments import read_segments

SIDE = ("rname", "pos", "flag", "mapq", "pid", "plen")


def strand(flag: Column) -> Column:
    return F.when(reverse(flag), F.lit(16)).otherwise(F.lit(0))


def adjacent(segments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Consecutive segments of a read, in reading order: qname, clip, rname1, pos1, ... plen2, gap, rlength."""
    order = Window.partitionBy("qname").orderBy("clip")
    one = F.struct("rname", "flag", "pos", "stop", "mapq", "pid", "clip", "length")
    pairs = read_segments(segments, config).select("qname", "rlength", one.alias("a"), F.lead(one).over(order).alias("b")).where("b is not null")
    a, b = F.col("a"), F.col("b")
    share = lambda s: s["length"].cast("double") / F.col("rlength").cast("double")
    return pairs.select(
        "qname",
        a["clip"].alias("clip"),
        a["rname"].alias("rname1"),
        F.when(reverse(a["flag"]), a["pos"]).otherwise(a["stop"]).alias("pos1"),
        strand(a["flag"]).alias("flag1"),
        a["mapq"].alias("mapq1"),
        a["pid"].alias("pid1"),
        share(a).alias("plen1"),
        b["rname"].alias("rname2"),
        F.when(reverse(b["flag"]), b["stop"]).otherwise(b["pos"]).alias("pos2"),
        strand(b["flag"]).alias("flag2"),
        b["mapq"].alias("mapq2"),
        b["pid"].alias("pid2"),
        share(b).alias("plen2"),
        (b["clip"] - (a["clip"] + a["length"])).alias("gap"),
        "rlength",
    )


def canonical(pairs: DataFrame) -> DataFrame:
    """Smaller contig, then position first; a swap turns both strands."""
    swap = (F.col("rname1") > F.col("rname2")) | ((F.col("rname1") == F.col("rname2")) & (F.col("pos1") > F.col("pos2")))
    turned = {}
    for name in SIDE:
        x, y = F.col(f"{name}1"), F.col(f"{name}2")
        turned[f"{name}1"] = F.when(swap, 16 - y if name == "flag" else y).otherwise(x)
        turned[f"{name}2"] = F.when(swap, 16 - x if name == "flag" else x).otherwise(y)
    return pairs.withColumns(turned)


def typed(pairs: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """An insertion where the sides lie closer than the gap between them, else a breakend.

    The contigs are not compared, so a gap between contigs can be an insertion (parity register), but for
    `one_contig_insertions`.
    """
    inside = F.abs(F.col("pos2") - F.col("pos1")) < F.col("gap")
    if config.one_contig_insertions:
        inside = inside & (F.col("rname1") == F.col("rname2"))
    return pairs.withColumns(
        {
            "svtype": F.when(inside, "INS").otherwise("BND"),
            "pos2": F.when(inside, F.col("pos1") + 1).otherwise(F.col("pos2")),
            "flag1": F.when(inside, 0).otherwise(F.col("flag1")),
            "flag2": F.when(inside, 0).otherwise(F.col("flag2")),
        }
    )


def junctions(segments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    return typed(canonical(adjacent(segments, config)), config)


def hanging_ends(segments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Unaligned ends of split reads: rname, side (H or T), pos, qname, clip, mapq, pid, plength, rlength."""
    order = Window.partitionBy("qname").orderBy("clip")
    known = read_segments(segments, config).withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead("clip").over(order).isNull()})
    back = reverse(F.col("flag"))
    end = lambda side, pos: F.struct(F.lit(side).alias("side"), F.col(pos).alias("pos"))
    head = F.when(F.col("_first") & (F.col("clip") >= config.hanging_length), F.when(back, end("T", "stop")).otherwise(end("H", "pos")))
    tail = F.when(F.col("_last") & (F.col("clip_2") >= config.hanging_length), F.when(back, end("H", "pos")).otherwise(end("T", "stop")))
    rows = known.select("rname", "qname", "clip", "mapq", "pid", (F.col("length") / F.col("rlength")).alias("plength"), "rlength", F.explode(F.array_compact(F.array(head, tail))).alias("e"))
    return rows.select("rname", "e.side", "e.pos", "qname", "clip", "mapq", "pid", "plength", "rlength")
