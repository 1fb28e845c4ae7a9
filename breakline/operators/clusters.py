"""Two-level gap clustering of junctions, and structural variants from clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakline.config import CallConfig
from breakline.functions.runs import differ
from breakline.shared import saved, scratch

REGION = ["svtype", "rname1", "rname2", "flag1", "flag2"]


def _scan(keys: list[str], position: str, distance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number the runs of sorted rows inside a task: `_run` counts breaks from 0 for each key, `_part` is the task.

    Only the last row and its number pass from one batch to the next.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.select([*keys, position])
            columns = [c.combine_chunks() for c in pa.Table.from_batches([own] if last is None else [last, own]).columns]
            changed = np.zeros(len(columns[0]) - 1, bool)
            for c in columns[:-1]:
                changed |= differ(c)
            step = pc.subtract(columns[-1][1:], columns[-1][:-1])
            apart = ~pc.fill_null(pc.less_equal(step, distance), False).to_numpy(zero_copy_only=False)
            if last is None:  # the first row of all begins a key
                changed, apart = np.append(True, changed), np.append(False, apart)
            breaks = np.cumsum(apart & ~changed) + at
            # A key's count begins anew at its first row.
            base = np.maximum.accumulate(np.where(changed, breaks, 0)) if changed.any() else np.zeros(len(breaks), np.int64)
            run = breaks - base
            at, last = int(run[-1]), own.slice(own.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64()), pa.array(np.full(len(run), part, np.int32))], [*batch.schema.names, "_run", "_part"])

    return scan


def gap_clusters(rows: DataFrame, keys: list[str], order: list[str], distance: int | float, name: str) -> DataFrame:
    """Number, from 1, the runs of rows of each key, by the first column of `order`, whose steps are at most `distance`.

    A segmented scan. Rows are dealt by ranges of (keys, order) and sorted, so neither a hot key nor one
    endless run makes a large task; each task numbers its own rows and writes them. A task can go on with
    at most one key of the task before it, so at most as many counts as there are tasks have to be added up;
    these are broadcast. `order` is a total order of the rows; a null position ends a run.
    """
    made = T.StructType([*rows.schema.fields, T.StructField("_run", T.LongType()), T.StructField("_part", T.IntegerType())])
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    scanned = saved(ordered.mapInArrow(_scan(keys, order[0], distance), made), "gap-scan")
    ends = scanned.groupBy("_part", *keys).agg(F.min(order[0]).alias("_first"), F.max(order[0]).alias("_last"), F.max("_run").alias("_breaks"))
    w = Window.partitionBy(*keys).orderBy("_part")
    more = F.when(F.col("_first") - F.lag("_last").over(w) <= distance, 0).otherwise(1) + F.lag("_breaks").over(w)
    going_on = ends.withColumns({"_n": F.row_number().over(w), "_more": F.coalesce(more, F.lit(0))})
    going_on = going_on.withColumn("_offset", F.sum("_more").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_n > 1")
    offsets = going_on.select("_offset", *(F.col(k).alias(f"_o_{k}") for k in ("_part", *keys)))
    test: Column = F.lit(True)
    for k in ("_part", *keys):
        test = test & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    number = (F.col("_run") + F.coalesce("_offset", F.lit(0)) + 1).alias(name)
    return scanned.join(F.broadcast(offsets), test, "left").select(*rows.columns, number)


def cluster(junctions: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Add c1 (runs of pos1) and c2 (runs of pos2 inside); together with REGION they name a cluster."""
    d = config.cluster_distance
    # Written first, as a range shuffle reads its input twice.
    with scratch() as keep:
        first = gap_clusters(saved(junctions, "junctions"), REGION, ["pos1", "pos2", "qname", "clip"], d, "c1")
        first = keep(saved(first, "clusters-1"))
    return gap_clusters(first, [*REGION, "c1"], ["pos2", "pos1", "qname", "clip"], d, "c2")


CLUSTER = [*REGION, "c1", "c2"]


def whole(x: Column) -> Column:
    """Exact median, cut off to a whole number."""
    return F.median(x).cast("long")


def variants(clusters: DataFrame, config: CallConfig = CallConfig()) -> DataFrame:
    """Clusters with enough junctions: chr, chr2, flags, positions, intervals, support and read ids."""
    grouped = clusters.groupBy(*CLUSTER).agg(
        F.count(F.lit(1)).alias("dv"),
        F.median("pos1").alias("_m1"),
        F.median("pos2").alias("_m2"),
        F.min("pos1").alias("pos_lo"),
        F.max("pos1").alias("pos_hi"),
        F.min("pos2").alias("end_lo"),
        F.max("pos2").alias("end_hi"),
        whole(F.col("gap")).alias("gap"),
        F.sort_array(F.collect_list(F.col("qname").cast("string"))).alias("alt_read_ids"),
    )
    kept = grouped.where(F.col("dv") >= config.cluster_count)
    near = lambda bound, m: (F.col(bound) - F.col(m)).cast("long")
    out = kept.withColumns({"pos": F.col("_m1").cast("long"), "end": F.col("_m2").cast("long"), "cipos_lo": near("pos_lo", "_m1"), "cipos_hi": near("pos_hi", "_m1"), "ciend_lo": near("end_lo", "_m2"), "ciend_hi": near("end_hi", "_m2")})
    out = out.withColumnsRenamed({"rname1": "chr", "rname2": "chr2"}).drop("_m1", "_m2")
    return numbered(saved(out, "variants"), ["svtype", "chr", "chr2", "flag1", "flag2"], ["pos_lo", "end_lo", "c1", "c2"], "sv_id")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, width: int = 1_000_000) -> DataFrame:
    """Number rows from 1 in the order of keys, then `order` (its first column a position).

    Rows are counted by key and stretch of positions; only those counts are summed up in one order, so
    no row passes a single task.
    """
    binned = rows.withColumn("_bin", F.floor(F.col(order[0]) / width).cast("long"))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # Sums in two levels: by key inside, then over the few keys.
    inside = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    of_key = counts.groupBy(*keys).agg(F.sum("_n").alias("_k"))
    above = of_key.withColumn("_above", F.coalesce(F.sum("_k").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    offsets = counts.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n").join(above, keys)
    own = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(*order))
    return binned.withColumn("_own", own).join(offsets, [*keys, "_bin"]).withColumn(name, F.col("_above") + F.col("_within") + F.col("_own")).drop("_own", "_above", "_within", "_bin")
