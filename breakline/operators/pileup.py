"""Read bases at given positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakline.functions import cigar as C
from breakline.functions import placed as P
from breakline.operators.range_join import range_join
from breakline.shared import saved

#: Bases of the smallest bins in the join of positions with alignments.
BIN = 10_000
#: Positions, of a few machine words, that are sent to every task at most.
FEW = 1_000_000
#: Rows of the batches that a task gives.
SLICE = 100_000
_NONE = np.zeros(0, np.int64)
#: What names an alignment; rows that agree in all of it are copies.
KEY = ["qname", "flag", "rname", "pos0", "mark"]


def _read_bases(batch: pa.RecordBatch, ops: P.Operations, row: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """The bases of alignments at positions, looked up in the prefix sums of their operations."""
    offset = pos - batch["pos0"].to_numpy()[row] - 1
    inside = (offset >= 0) & (offset < ops.width()[row])
    row, pos, offset = row[inside], pos[inside], offset[inside]
    at = ops.read_at(row, offset)
    base = pc.if_else(pa.array(at == P.DELETED), "-", pc.if_else(pa.array(at == P.SKIPPED), ">", P.gathered_bytes(batch["seq"], row, at)))
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in ("rname", "qname", "clip")), pa.array(pos, pa.int64()), base, P.gathered_numbers(batch["qual"], row, at)], ["rname", "qname", "clip", "pos", "base", "qual"])


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions that come with each alignment."""
    for batch in batches:
        asked = batch["asked"]
        row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        yield _read_bases(batch, P.Operations(batch["cigar"]), row, asked.flatten().to_numpy())


def _bases_at(sent: Broadcast):
    """The positions, sorted for each contig, that lie in the span of each alignment."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            ops, pos0 = P.Operations(batch["cigar"]), batch["pos0"].to_numpy()
            stop = pos0 + ops.width()
            names = batch["rname"].dictionary_encode()
            contig = names.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(names.dictionary.to_pylist()):
                places, rows = asked.get(name, _NONE), np.flatnonzero(contig == k)
                first = np.searchsorted(places, pos0[rows], side="right")
                many = np.searchsorted(places, stop[rows], side="right") - first
                hit = many > 0
                rows, first, many = rows[hit], first[hit], many[hit]
                # Stretches of alignments with about SLICE positions, so that a batch of long reads gives many small ones.
                group = (np.cumsum(many) - 1) // SLICE
                for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(group)) + 1) if len(rows) else ():
                    n = many[cut]
                    into = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield _read_bases(batch, ops, np.repeat(rows[cut], n), places[np.repeat(first[cut], n) + into])

    return find


def pileup(alignments: DataFrame, positions: DataFrame) -> DataFrame:
    """`positions(rname, pos)` to a row for each mapped alignment over each: rname, pos, qname, clip, base,
    qual. A deleted base is '-', a skipped one '>', both without quality.

    FEW positions at most are sent to the tasks, where each alignment looks up those in its span: no
    alignment is shuffled. More first meet the spans of alignments, without bases; then each alignment that
    is wanted is fetched once, so no base is copied for a bin or a position, but `alignments` is read twice.
    It needs qname, flag, rname, pos0, cigar, seq and, if there, qual (numbers or bytes).
    """
    mapped = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("cigar") != "*") & F.col("seq").isNotNull())
    if "qual" not in mapped.columns:
        mapped = mapped.withColumn("qual", F.lit(None).cast("array<int>"))
    mapped = mapped.select("qname", "flag", "rname", "pos0", "cigar", "seq", "qual")
    asked = saved(positions.select("rname", F.col("pos").cast("long").alias("pos")).where("rname is not null and pos is not null").distinct(), "asked")
    lead, _ = C.clips(F.col("cigar"), F.col("flag"))
    told = ["rname", "qname", lead.alias("clip"), "pos0", "cigar"]
    bases = [F.col("seq").cast("binary").alias("seq"), "qual"]
    if asked.count() <= FEW:
        table = asked.toArrow().sort_by([("rname", "ascending"), ("pos", "ascending")])
        place, names = table["pos"].to_numpy(), table["rname"].combine_chunks().value_counts()
        ends = np.cumsum(names.field("counts").to_numpy())
        by_contig = dict(zip(names.field("values").to_pylist(), np.split(place, ends[:-1]), strict=True)) if len(place) else {}
        rows, find = mapped.where("pos0 is not null").select(*told, *bases), _bases_at(mapped.sparkSession.sparkContext.broadcast(by_contig))
    else:
        mapped = mapped.withColumn("mark", F.xxhash64("cigar"))
        spans = mapped.select(*KEY, (F.col("pos0") + 1).alias("_from"), (F.col("pos0") + C.reference_length(F.col("cigar"))).alias("_to"))
        met = range_join(asked, "pos", spans.withColumnRenamed("rname", "_rname").withColumn("rname", F.col("_rname")), "_from", "_to", ["rname"], BIN)
        wanted = met.groupBy("qname", "flag", F.col("_rname").alias("rname"), "pos0", "mark").agg(F.collect_set("pos").alias("asked"))
        rows, find = mapped.join(wanted, KEY).select(*told, "asked", *bases), _bases
    kind = dict(rows.dtypes)["qname"]
    found = rows.mapInArrow(find, f"rname string, qname {kind}, clip long, pos long, base string, qual int")
    return found.select("rname", "pos", "qname", "clip", "base", "qual")
