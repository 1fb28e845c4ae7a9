"""Alignments to segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakline.config import CallConfig
from breakline.functions import cigar as C
from breakline.functions import placed as P


#: Columns of an alignment that its segments do not repeat.
LONG = ("cigar", "md", "seq", "qual")
#: Places of a chunk, and what its identity is made of.
PLACES, PARTS = ("chunk", "pos", "stop", "length", "clip", "clip_2"), ("matches", "equal", "plain")


def split_alignments(alignments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """`alignments(qname, flag, rname, pos0, mapq, cigar, md, ...)` to segments, cut at long gaps.

    One row per chunk with aligned bases: rname, pos, stop (1-based, inclusive), qname, flag, mapq,
    length, clip, clip_2, pid, chunk; columns of LONG are dropped. Unmapped rows go. No shuffle: the
    operations of a batch are summed up together, in time and memory in proportion to them. The clip
    behind a chunk does not count insertions that were cut out (but for `count_cut_insertions`), and identity
    from MD is that of the whole alignment over the chunk's length: both as the parity register asks.
    """
    others = [c for c in alignments.columns if c not in LONG]
    rows = alignments.where(F.col("flag").bitwiseAND(4) == 0).select(*others, F.col("flag").alias("_flag"), F.col("pos0").cast("long").alias("_pos0"), F.col("cigar").alias("_cigar"), F.col("md").alias("_md"))
    least, count_cut = config.min_indel_size, config.count_cut_insertions

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = P.chunks(batch["_cigar"], batch["_md"], batch["_flag"].to_numpy(), batch["_pos0"].to_numpy(), least, count_cut)
            keep = np.flatnonzero(made["length"] > 0)
            row = pa.array(made["row"][keep])
            no_md = pa.array(batch["_md"].is_null().to_numpy(zero_copy_only=False)[made["row"][keep]])
            told = [pa.array(made[c][keep]) for c in (*PLACES, *PARTS)]
            told[len(PLACES)] = pc.if_else(no_md, None, told[len(PLACES)])
            yield pa.RecordBatch.from_arrays([*(batch[c].take(row) for c in others), *told], [*others, *PLACES, *PARTS])

    known = [f for f in alignments.schema.fields if f.name in others]
    schema = T.StructType([*known, *(T.StructField(c, T.LongType()) for c in (*PLACES, *PARTS))])
    pid = C.share(F.col("matches"), F.col("equal"), F.col("plain"), F.col("length"))
    return rows.mapInArrow(split, schema).withColumns({"pid": pid, "chunk": F.col("chunk").cast("int")}).select(*others, *PLACES, "pid")


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """rname, pos, stop of the reference stretches that mapped alignments cover with read bases.

    Deleted and skipped bases are not covered. All mapped alignments count, whatever their quality.
    """
    rows = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*")).select("rname", "pos0", C.operations(F.col("cigar")).alias("_ops"))
    gaps = F.filter(F.transform("_ops", lambda o, i: F.when(o["op"].isin("D", "N"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_at", gaps)
    span = lambda ops: C.total(ops, "M=X")
    rows = rows.select("rname", "pos0", F.transform(C.pieces(F.col("_ops"), F.col("_at")), span).alias("_span"), F.concat(F.transform("_at", lambda i: F.get("_ops", i)["len"]), F.array(F.lit(0).cast("long"))).alias("_gap"))
    rows = rows.withColumn("_before", C.running(F.zip_with("_span", "_gap", lambda a, b: a + b)))
    block = F.explode(F.zip_with("_before", "_span", lambda at, n: F.struct((F.col("pos0") + at + 1).alias("pos"), (F.col("pos0") + at + n).alias("stop"))))
    return rows.select("rname", block.alias("b")).select("rname", "b.*").where("pos <= stop")


def keep_segments(segments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Mapping quality and rounded identity at least as asked."""
    return segments.where((F.col("mapq") >= config.min_mapq) & (C.rounded3(F.col("pid")) >= config.min_pid))


def dedup_segments(segments: DataFrame, order: list[str]) -> DataFrame:
    """One segment for each read and clip: the last by `order` (a total order)."""
    last = Window.partitionBy("qname", "clip").orderBy(*(F.desc(c) for c in order))
    return segments.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def read_segments(segments: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Segments of reads with 2 to max_split segments, with `n_segments`."""
    counted = segments.withColumn("n_segments", F.count(F.lit(1)).over(Window.partitionBy("qname")))
    return counted.where(F.col("n_segments").between(2, config.max_split))
