"""Random positions by a permutation of the unmasked bases."""

import pytest
from pyspark.sql import functions as F

from breakline.operators import sampling

CONTIGS = [("b", 1000, 0), ("a", 35_000, 1), ("empty", 0, 2), ("c", 3, 3)]
MASKS = [("a", 1, 34_000), ("a", 100, 200), ("b", -5, 10), ("b", 990, 5000), ("b", 500, 499), ("x", 1, 9), ("c", 2, 2)]


def frames(spark):
    return spark.createDataFrame(CONTIGS, "rname string, length long, ord int"), spark.createDataFrame(MASKS, "rname string, start long, stop long")


def bare():
    hidden = {(r, p) for r, a, b in MASKS for p in range(a, b + 1)}
    return [(r, p) for r, n, _ in CONTIGS for p in range(1, n + 1) if (r, p) not in hidden]


def test_all_bases_are_drawn_once(spark):
    contigs, mask = frames(spark)
    want = bare()
    got = [tuple(r) for r in sampling.sample_positions(spark, contigs, mask, len(want), 3).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 500, 1900])
def test_exactly_n_distinct_unmasked(spark, n):
    contigs, mask = frames(spark)
    one, two = ({tuple(r) for r in sampling.sample_positions(spark, *f, n, 7).collect()} for f in ((contigs, mask), (contigs.repartition(3), mask.repartition(5))))
    assert one == two and len(one) == n and one <= set(bare())
    if n == 500:
        assert {tuple(r) for r in sampling.sample_positions(spark, contigs, mask, n, 8).collect()} != one


def test_too_many(spark):
    contigs, mask = frames(spark)
    with pytest.raises(ValueError, match="are not masked"):
        sampling.sample_positions(spark, contigs, mask, len(bare()) + 1)


@pytest.mark.parametrize("total", [1, 2, 3, 10, 1000, 1023])
def test_permutation(spark, total):
    value, size = sampling.shuffled(F.col("id"), total, 5)
    got = [r[0] for r in spark.range(size).select(value).collect()]
    assert sorted(got) == list(range(size)) and total <= size < total + total**0.5 + 2


def test_draws_spread_over_the_genome(spark):
    contigs = spark.createDataFrame([("a", 10**9, 0), ("b", 2 * 10**9, 1)], "rname string, length long, ord int")
    mask = spark.createDataFrame([("a", 1, 999_000_000)], "rname string, start long, stop long")
    got = sampling.sample_positions(spark, contigs, mask, 20_000).agg(F.count("*"), F.count_if(F.col("rname") == "a"), F.avg(F.when(F.col("rname") == "b", F.col("position")))).first()
    assert got[0] == 20_000 and got[1] < 40 and abs(got[2] / 1e9 - 1) < 0.03
