"""Top-k for other k than the default, and large components, against brute force."""

import math
import random

import pytest

from breakline.llm import topk

clamp = lambda x: max(-(2**63), min(2**63 - 1, x))


def brute(rows, k):
    whole = lambda x: clamp(math.floor(64 * x)) if math.isfinite(64 * x) else clamp(math.floor(x))
    full = {i: [whole(x) for x in v] for i, v in rows if all(map(math.isfinite, v))}
    out = []
    for q in full:
        if q % 20 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(full[q], v, strict=True))), i) for i, v in full.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("size", [8192, 64])
def test_any_k_equals_brute_force(spark, monkeypatch, large, size):
    monkeypatch.setattr(topk, "VECTOR_ROWS", size)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(250)]
    if large:
        rows += [(300 + 10 * i, [x] * 20) for i, x in enumerate((1e15, -1e16, 1e17, -1e18, 1e300, -1.7e308, math.inf, math.nan))]
    df = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.count() == 250 + 6 * large
    for k in (1, 100):
        got = sorted(map(tuple, topk.top_k(df.where("vec_id % 20 = 0"), df, k).collect()))
        assert got == brute(rows, k)
