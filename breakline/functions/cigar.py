"""CIGAR and MD strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OP = "struct<len:bigint,op:string>"
# Fixed values of the format.
KINDS = "MIDNSHP=X"


def operations(cigar: Column) -> Column:
    """`array<struct<len, op>>`; empty for '*' and null."""
    known = F.when(cigar != "*", cigar).otherwise("")
    sizes = F.filter(F.split(F.translate(known, KINDS, " " * len(KINDS)), " "), lambda x: x != "")
    kinds = F.filter(F.split(F.translate(known, "0123456789", ""), ""), lambda x: x != "")
    return F.zip_with(sizes, kinds, lambda n, op: F.struct(n.cast("long").alias("len"), op.alias("op")))


def running(values: Column, block: int = 64) -> Column:
    """For each of the numbers the sum of those before it, in two levels: a step copies no long array."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def sums(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("done"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["done"], F.array(acc["at"])).alias("done")), lambda acc: acc["done"])

    of = lambda xs: F.aggregate(xs, zero, lambda acc, x: acc + x)
    firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    parts = F.transform(firsts, lambda i: F.slice(values, i, block))
    return F.flatten(F.zip_with(sums(F.transform(parts, of)), parts, lambda base, part: F.transform(sums(part), lambda x: base + x)))


def total(ops: Column, kinds: str) -> Column:
    """Summed length of the operations of the given kinds."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin(list(kinds)), x["len"]).otherwise(0))


def reference_length(cigar: Column) -> Column:
    """Reference bases of an alignment."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def outer_clips(cigar: Column) -> tuple[Column, Column]:
    """Leading and trailing clip: the outermost operation if it is S or H, else 0."""
    number = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(0).cast("long"))
    return number(r"^(\d+)[SH]"), number(r"(\d+)[SH]$")


def clips(cigar: Column, flag: Column) -> tuple[Column, Column]:
    """Clip before and behind the segment in reading direction."""
    lead, trail = outer_clips(cigar)
    back = reverse(flag)
    return F.when(back, trail).otherwise(lead), F.when(back, lead).otherwise(trail)


def reverse(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def md_matches(md: Column) -> Column:
    """Sum of the numbers of an MD string."""
    return F.aggregate(F.regexp_extract_all(md, F.lit(r"(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def rounded3(x: Column) -> Column:
    """Three decimals; ties of the decimal text round half up (see the parity notes of the README)."""
    return F.round(x, 3)


def identity(md: Column, ops: Column, aligned: Column) -> Column:
    """Share of identical bases, 3 decimals: MD's matches, else `=`, else M; null if nothing is aligned."""
    share = lambda n: rounded3(F.try_divide(n.cast("double"), aligned.cast("double")))
    equal = share(total(ops, "="))
    return F.when(md.isNotNull(), share(md_matches(md))).otherwise(F.when(equal == 0, share(total(ops, "M"))).otherwise(equal))


def pieces(ops: Column, at: Column) -> Column:
    """The runs of operations between the places `at`: one more than there are places."""
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    ends = F.concat(at, F.array(F.size(ops)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(ops, a + 1, b - a))


def share(matches: Column, equal: Column, aligned_m: Column, aligned: Column) -> Column:
    """Share of identical bases, 3 decimals, from counts: MD's, else `=`, else M; null if nothing is aligned."""
    part = lambda n: rounded3(F.try_divide(n.cast("double"), aligned.cast("double")))
    same = part(equal)
    return F.when(matches.isNotNull(), part(matches)).otherwise(F.when(same == 0, part(aligned_m)).otherwise(same))
