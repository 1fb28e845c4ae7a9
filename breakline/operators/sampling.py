"""Random genome positions outside masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breakline.operators.coverage import STRETCH, depth_runs
from breakline.operators.range_join import range_join
from breakline.shared import saved


def with_offsets(contigs: DataFrame) -> DataFrame:
    """`contigs(rname, length, ord)` with `before`: the lengths of all contigs ahead (a small table)."""
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("before", F.coalesce(F.sum("length").over(w), F.lit(0)))


def place(offsets: DataFrame, contigs: DataFrame, column: str) -> DataFrame:
    """Genome-wide offsets (from 0) to rname and 1-based position: the first contig whose end lies behind."""
    known = with_offsets(contigs.where("length > 0"))
    size = known.agg(F.sum("length"), F.count(F.lit(1))).first()
    width = max(1, (size[0] or 0) // max(1, size[1]))
    spans = known.select(F.col("rname"), F.col("before").alias("_before"), (F.col("before") + F.col("length") - 1).alias("_last"))
    met = range_join(offsets, column, spans, "_before", "_last", [], width)
    return met.withColumn("position", F.col(column) - F.col("_before") + 1).drop("_before", "_last")


def merged_masks(*masks: DataFrame) -> DataFrame:
    """Masks(rname, start, stop) of all sources, each interval once."""
    out = masks[0].select("rname", "start", "stop")
    for m in masks[1:]:
        out = out.unionByName(m.select("rname", "start", "stop"))
    return out.distinct()


def read_mask(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """`rows(rname, start, stop)` with a leading 'chr' removed, X and Y as 23 and 24, on known contigs."""
    plain = F.regexp_replace("rname", "^chr", "")
    number = F.when(plain == "X", "23").when(plain == "Y", "24").otherwise(plain)
    return rows.withColumn("rname", number).where(F.col("rname").try_cast("int").isNotNull()).join(contigs.select("rname"), "rname", "left_semi")


def unmasked(contigs: DataFrame, mask: DataFrame) -> DataFrame:
    """Stretches of `contigs(rname, length, ord)` outside all masks: rname, start, n, and `before`: the bases of
    all stretches ahead of each, in order of contigs and positions.

    A contig's own span adds one to the depth of its masks, so depth one is bare.
    """
    sizes = contigs.where("length > 0").select("rname", "length", "ord")
    inside = mask.join(sizes, "rname").select("rname", F.greatest("start", F.lit(1)).alias("pos"), F.least("stop", "length").alias("stop"))
    spans = sizes.select("rname", F.lit(1).cast("long").alias("pos"), F.col("length").alias("stop"))
    bare = depth_runs(spans.unionByName(inside)).where("depth = 1").select("rname", "start", (F.col("stop") - F.col("start") + 1).alias("n"))
    w = Window.partitionBy("rname").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    within = bare.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    of_contig = within.groupBy("rname").agg(F.sum("n").alias("length")).join(sizes.select("rname", "ord"), "rname")
    return within.join(with_offsets(of_contig).select("rname", "before"), "rname").select("rname", "start", "n", (F.col("before") + F.col("_in")).alias("before"))


def shuffled(number: Column, total: int, seed: int, rounds: int = 6) -> tuple[Column, int]:
    """(keyed permutation of 0 .. size - 1, size), where size is total or a little more, by less than its root.

    Numbers are pairs (a, b); by turns each half is moved on by a hash of the other, so every round, and
    the whole, can be undone and no two numbers meet.
    """
    wide = max(1, math.isqrt(max(total - 1, 0)) + 1)
    high = max(1, -(-total // wide))
    a, b = number % wide, F.floor(number / wide).cast("long")
    for k in range(rounds):
        if k % 2:
            b = F.pmod(b + F.pmod(F.xxhash64(a, F.lit(k), F.lit(seed)), F.lit(high)), F.lit(high))
        else:
            a = F.pmod(a + F.pmod(F.xxhash64(b, F.lit(k), F.lit(seed)), F.lit(wide)), F.lit(wide))
    return b * wide + a, wide * high


def sample_positions(spark: SparkSession, contigs: DataFrame, mask: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """`n` distinct unmasked positions: rname, position; an error if there are fewer.

    The unmasked bases are numbered, and a keyed permutation of these numbers gives the sample: its first n values
    are n different bases, however much is masked. The few values beyond the last base are replaced by
    later ones. The same seed gives the same sample on every cluster.
    """
    bare = saved(unmasked(contigs, mask), "unmasked")
    total = bare.agg(F.sum("n")).first()[0] or 0
    if n > total:
        raise ValueError(f"{n} positions are asked for, {total} are not masked")
    value, size = shuffled(F.col("id"), total, seed)
    drawn = lambda a, b: spark.range(a, b).select("id", value.alias("base"))
    missing = drawn(0, n).where(F.col("base") >= total).count()
    spare = drawn(n, min(size, n + size - total)).where(F.col("base") < total).orderBy("id").limit(missing)
    bases = drawn(0, n).where(F.col("base") < total).union(spare).select("base")
    met = range_join(bases, "base", bare.select("rname", "start", "before", (F.col("before") + F.col("n") - 1).alias("last")), "before", "last", [], STRETCH)
    return met.select("rname", (F.col("start") + F.col("base") - F.col("before")).alias("position"))
