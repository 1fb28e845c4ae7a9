"""The whole call: segments to annotated variants."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakline.config import CallConfig
from breakline.operators import annotate, clusters, coverage, evidence
from breakline.operators.junctions import hanging_ends, junctions
from breakline.shared import saved, scratch


@dataclass
class Call:
    """Tables of a call. All but `calls` are written, as several steps read them."""

    clusters: DataFrame
    variants: DataFrame
    hanging: DataFrame
    reference: DataFrame
    calls: DataFrame


def detect(segments: DataFrame, config: CallConfig = CallConfig()) -> tuple[DataFrame, DataFrame]:
    """(clustered junctions, variants)."""
    with scratch() as keep:
        made = keep(saved(clusters.cluster(junctions(segments, config), config), "clusters"))
    with scratch() as keep:
        return made, keep(saved(clusters.variants(made, config), "numbered"))


def genotyped(segments: DataFrame, config: CallConfig = CallConfig()) -> Call:
    """Variants with counts and genotype alone, all that phasing asks for; hom-ref ones are not in `calls`."""
    made, found = detect(segments, config)
    hung = saved(evidence.hanging_support(found, hanging_ends(segments, config), config), "hanging")
    spanning = saved(evidence.reference_reads(found, segments, config), "reference-reads")
    called = evidence.support(made, found, hung, spanning).drop("dv").where("gt <> '0/0'")
    return Call(made, found, hung, spanning, saved(found.drop("alt_read_ids").join(called, "sv_id"), "genotyped"))


def call(
    segments: DataFrame,
    config: CallConfig = CallConfig(),
    hist: DataFrame | None = None,
    runs: DataFrame | None = None,
    bases: Callable[[DataFrame], DataFrame] | None = None,
) -> Call:
    """Variants with evidence, genotype, type, density, mates and filters.

    `hist(depth, n)` of the depth sample and `runs` (of coverage.depth_runs) allow retyping by depth;
    `bases` gives the usual base (rname, pos, ref) of asked positions (rname, pos), 'N' where it has none.
    Hom-ref variants are not in `calls`.
    """
    made, found = detect(segments, config)
    hung = saved(evidence.hanging_support(found, hanging_ends(segments, config), config), "hanging")
    spanning = saved(evidence.reference_reads(found, segments, config), "reference-reads")
    # Hom-ref variants go first: their medians and read ids are not needed.
    out = found.join(evidence.support(made, found, hung, spanning).drop("dv").where("gt <> '0/0'"), "sv_id")
    out = out.join(evidence.side_medians(made, found, hung), "sv_id")
    out = out.join(evidence.reference_read_ids(spanning), "sv_id", "left")
    none = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, F.array(F.lit("NA"))).otherwise(F.col(c))
    out = out.withColumns({c: none(c) for c in ("ref_read_ids_1", "ref_read_ids_2")})
    if config.depth_support and hist is not None and runs is not None:
        out = coverage.retyped(out, runs, hist)
    else:
        out = out.withColumn("depth_pval", F.lit(None).cast("double"))
    live = saved(out, "live")
    if bases is not None:
        known = bases(live.select(F.col("chr").alias("rname"), "pos").distinct()).select(F.col("rname").alias("chr"), "pos", "ref")
        named = live.join(known, ["chr", "pos"], "left").na.fill("N", ["ref"])
    else:
        named = live.withColumn("ref", F.lit("N"))
    named = named.join(annotate.density(live, config), "sv_id").join(annotate.mates(live, config), "sv_id", "left")
    return Call(made, found, hung, spanning, named.withColumn("filters", annotate.filters(config)))
