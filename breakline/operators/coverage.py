"""Depth of coverage, its empirical test, and retyping by depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breakline.functions.cigar import reverse
from breakline.operators.range_join import range_join

#: Bases of a stretch that depth is summed up in on its own.
STRETCH, SIGNIFICANT = 10_000, 0.05


def depth_runs(blocks: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """`blocks(rname, pos, stop)` to maximal-by-events runs: rname, stretch, start, stop, depth (> 0 or 0).

    A block is cut at the bounds of stretches, so running sums stay inside a stretch and a long contig
    spreads over tasks.
    """
    number = lambda c: F.floor(F.col(c) / stretch).cast("long")
    cut = blocks.where("pos <= stop").select("rname", "pos", "stop", F.explode(F.sequence(number("pos"), number("stop"))).alias("stretch"))
    part = cut.select("rname", "stretch", F.greatest("pos", F.col("stretch") * stretch).alias("a"), (F.least("stop", F.col("stretch") * stretch + stretch - 1) + 1).alias("b"))
    events = part.select("rname", "stretch", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("n")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("n")))).alias("e"))
    summed = events.groupBy("rname", "stretch", F.col("e.at").alias("start")).agg(F.sum("e.n").alias("n"))
    w = Window.partitionBy("rname", "stretch").orderBy("start")
    runs = summed.select("rname", "stretch", "start", (F.lead("start").over(w) - 1).alias("stop"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.where("stop is not null")


def depth_at(positions: DataFrame, runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """`positions(rname, position, ...)` with `depth`, 0 where nothing covers.

    Distinct positions and starts of runs are put in one order inside each stretch; a position takes the
    depth of the last start before it, so the work is a sort however deep the coverage is.
    """
    asked = positions.select("rname", "position").distinct()
    known = asked.select("rname", F.floor(F.col("position") / stretch).cast("long").alias("stretch"), F.col("position").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("d"))
    # A run that ends inside the stretch is followed by another one, or by depth 0.
    begins = runs.select("rname", "stretch", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("depth").cast("long").alias("d")), F.struct((F.col("stop") + 1).alias("at"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("d")))).alias("e")).select("rname", "stretch", "e.*")
    w = Window.partitionBy("rname", "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = begins.unionByName(known).withColumn("depth", F.last("d", ignorenulls=True).over(w)).where("kind = 1").select("rname", F.col("at").alias("position"), "depth")
    return positions.join(found, ["rname", "position"], "left").na.fill(0, ["depth"])


def interval_histogram(intervals: DataFrame, runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """depth, n: how many bases inside `intervals(rname, start, stop)` have each depth; a base counts once."""
    union = depth_runs(intervals.select("rname", F.col("start").alias("pos"), "stop"), stretch).where("depth > 0").select("rname", "stretch", F.col("start").alias("a"), F.col("stop").alias("b"))
    total = union.agg(F.sum(F.col("b") - F.col("a") + 1).alias("n"))
    r = runs.where("depth > 0").withColumnsRenamed({"rname": "_r", "stretch": "_t"})
    met = union.join(r, (F.col("rname") == F.col("_r")) & (F.col("stretch") == F.col("_t")) & (F.col("start") <= F.col("b")) & (F.col("stop") >= F.col("a")))
    covered = met.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.sum(F.least("stop", "b") - F.greatest("start", "a") + 1).alias("n"))
    bare = total.select(F.lit(0).cast("long").alias("depth"), "n").unionByName(covered.select(F.lit(0).cast("long").alias("depth"), (-F.col("n")).alias("n")))
    zero = bare.groupBy("depth").agg(F.sum("n").alias("n"))
    return covered.unionByName(zero).where("n > 0")


def region_depth(regions: DataFrame, runs: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """`regions(id, rname, from, to)` (bounds in any order) to id, mean depth over all their bases."""
    known = regions.select("id", F.col("rname").alias("_r"), F.least("from", "to").alias("_a"), F.greatest("from", "to").alias("_b"))
    cut = known.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a") / stretch).cast("long"), F.floor(F.col("_b") / stretch).cast("long"))))
    r = runs.where("depth > 0")
    met = cut.join(r, (F.col("_r") == F.col("rname")) & (F.col("_s") == F.col("stretch")) & (F.col("start") <= F.col("_b")) & (F.col("stop") >= F.col("_a")))
    bases = met.groupBy("id").agg(F.sum((F.least("stop", "_b") - F.greatest("start", "_a") + 1) * F.col("depth")).alias("bases"))
    out = known.join(bases, "id", "left")
    return out.select("id", (F.coalesce("bases", F.lit(0)).cast("double") / (F.col("_b") - F.col("_a") + 1)).alias("mean_depth"))


def histogram(sample: DataFrame) -> DataFrame:
    """`sample(depth)` to depth, n: as many rows as there are depths."""
    return sample.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def depth_test(candidates: DataFrame, hist: DataFrame) -> DataFrame:
    """`candidates(id, is_dup, mean_depth)` with pval: the share of the sample beyond the mean.

    `hist(depth, n)`: the sample's histogram. Running counts are kept for every whole depth up to the
    largest, so the share is a lookup by the mean's neighbour: an equality join with as many rows as there
    are depths.
    """
    total = hist.agg(F.sum("n")).first()[0] or 0
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    every = hist.agg(F.max("depth").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("depth"))
    counts = every.join(hist, "depth", "left").select(F.col("depth").alias("key"), F.sum(F.coalesce("n", F.lit(0))).over(w).alias("upto"))
    keyed = candidates.withColumn("key", F.when(F.col("is_dup"), F.floor("mean_depth")).otherwise(F.ceil("mean_depth") - 1).cast("long"))
    upto = F.coalesce("upto", F.when(F.col("key") < 0, 0).otherwise(total))
    share = F.when(F.col("is_dup"), total - upto).otherwise(upto).cast("double") / max(total, 1)
    return keyed.join(counts, "key", "left").withColumn("pval", share).drop("key", "upto")


def retyped(variants: DataFrame, runs: DataFrame, hist: DataFrame) -> DataFrame:
    """Breakends on one contig whose depth stands out become DUP (both strands turned) or DEL (none)."""
    one = (F.col("svtype") == "BND") & (F.col("chr") == F.col("chr2")) & (F.col("flag1") == F.col("flag2"))
    open_ = variants.where(one).select(F.col("sv_id").alias("id"), F.col("chr").alias("rname"), F.col("pos").alias("from"), F.col("end").alias("to"), reverse(F.col("flag1")).alias("is_dup"))
    means = region_depth(open_, runs)
    tested = depth_test(open_.select("id", "is_dup").join(means, "id"), hist).select(F.col("id").alias("sv_id"), "mean_depth", "is_dup", F.col("pval").alias("depth_pval"))
    out = variants.join(tested, "sv_id", "left")
    kind = F.when(F.col("depth_pval") < SIGNIFICANT, F.when(F.col("is_dup"), "DUP").otherwise("DEL")).otherwise(F.col("svtype"))
    return out.withColumn("svtype", kind).drop("is_dup")


def aligned_bases(pileup: DataFrame) -> DataFrame:
    """`pileup(rname, pos, base)` to the usual base of each position: most frequent, then smallest.

    Deleted and skipped bases ('-', '>') do not count; a position without others has no row.
    """
    counts = pileup.where(~F.col("base").isin("-", ">")).groupBy("rname", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("rname", "pos").agg(F.min(F.struct((-F.col("n")).alias("k"), "base")).alias("b"))
    return best.select("rname", "pos", F.col("b.base").alias("ref"), (-F.col("b.k")).alias("n"))


def without_masked(positions: DataFrame, mask: DataFrame, width: int = STRETCH) -> DataFrame:
    """`positions(rname, position)` outside all intervals of `mask(rname, start, stop)`, ends included."""
    return range_join(positions, "position", mask, "start", "stop", ["rname"], width, "left_anti")
