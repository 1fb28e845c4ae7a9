"""Near points by quadrants against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breakline.functions import runs
from breakline.operators import annotate, near


def test_quadrants_equal_all_pairs():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 8, 60):
        u, v, n, top = rng.integers(0, 20, size), rng.integers(-5, 9, size), rng.integers(1, 5, size), rng.integers(-1, 30, size)
        qu, qv = rng.integers(-2, 24, 50), rng.integers(-8, 12, 50)
        total, best = runs.quadrants(u, v, n, top, qu, qv)
        for a, b, t, m in zip(qu, qv, total, best, strict=True):
            inside = (u <= a) & (v <= b)
            assert t == n[inside].sum() and m == max(top[inside], default=-1)


def test_whole_runs_are_never_cut():
    rng = random.Random(2)
    for _ in range(80):
        keys = sorted(rng.choices([None, 1, 2, 3, 4], k=rng.randint(1, 30)), key=lambda k: (k is not None, k or 0))
        table = pa.table({"k": pa.array(keys, pa.int64()), "i": list(range(len(keys)))})
        cuts = sorted(rng.randint(0, len(keys)) for _ in range(4))
        batches = [b for a, z in zip([0, *cuts], [*cuts, len(keys)], strict=True) for b in table.slice(a, z - a).to_batches()]
        got, seen = [], []
        for rows, heads in runs.whole_runs(iter(batches), ["k"]):
            got += rows["i"].to_pylist()
            seen += [rows["k"][int(h)].as_py() for h in heads]
        assert got == list(range(len(keys))) and seen == list(dict.fromkeys(keys))


def plain(points, queries, d):
    out = {}
    for k, x, y in set(queries):
        hit = [(n, t) for q, a, b, n, t in points if q == k and abs(a - x) <= d and abs(b - y) <= d]
        if hit:
            out[k, x, y] = (sum(n for n, _ in hit), max(t for _, t in hit))
    return out


@pytest.mark.parametrize("small", [4096, 0])
def test_near_points_equal_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL", small)
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randint(-60, 60), rng.randint(-60, 60), rng.randint(1, 3), rng.randint(0, 99)) for _ in range(400)]
    queries = [(k, x, y) for k, x, y, _, _ in points[:200]] + [("a", 1000, 0), ("c", 0, 0)]
    p, q = spark.createDataFrame(points, "k string, x long, y long, n long, top long"), spark.createDataFrame(queries, "k string, x long, y long")
    for d in (0, 9, 40):
        got = near.near_points(p, q, ["k"], d).collect()
        assert {(r.k, r.x, r.y): (r.n, r.top) for r in got} == plain(points, queries, d) and len(got) == len({(r.k, r.x, r.y) for r in got})


def test_density_of_one_dense_cell(spark):
    """300,000 variants within a window: every place counts all of them that are near, without pairs."""
    n, w = 300_000, 1000
    df = spark.range(n).select(F.col("id").alias("sv_id"), F.lit("c").alias("chr"), F.lit("c").alias("chr2"), (F.col("id") % 997).alias("pos"), ((F.col("id") * 7919) % 1999).alias("end"), F.lit("0/1").alias("gt"))
    got = annotate.density(df).agg(F.count("*"), F.sum("svcluster")).first()
    x, y = np.arange(n) % 997, np.arange(n) * 7919 % 1999
    grid = np.zeros((997, 1999), np.int64)
    np.add.at(grid, (x, y), 1)
    columns = np.concatenate(([0], np.cumsum(grid.sum(0))))
    near_y = columns[np.minimum(y + w + 1, 1999)] - columns[np.maximum(y - w, 0)]  # all x are near
    assert tuple(got) == (n, near_y.sum())
