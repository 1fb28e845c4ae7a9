"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout.

Vectors become integers floor(64 x). Both tables are cut into blocks by hash of their id; every task
joins some query blocks with one vector block. A vector block is held vertically (dimension by
candidate). A query adds up its products one dimension block at a time; after each, the remaining
mass of a candidate is at most |rest of q| * |rest of v| (Cauchy-Schwarz), and candidates whose
partial score plus that bound is below the query's k-th best score so far are compacted away. The
best k of every block are merged by rank, which handles at most k rows per query and block.

Edge cases: a vector that is null, empty, or holds a null or non-finite component takes no part; a
vector of another length than the query takes no part in that query; ties go to the smaller vec_id;
repeated rows are repeated candidates, a repeated query vec_id is one query, and no row finds its own vec_id; fewer than k candidates
give all of them; a null vec_id takes no part. Sums are exact while |floor(64 x)| < 2^23 for 64
dimensions; larger components fall back to Python integers. Components and scores beyond 64 bits
saturate, and saturated scores are ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, STEP, SCALE = 20, 16, 64
#: Rows of a vector block and of a query block.
VECTOR_ROWS, QUERY_ROWS = 8192, 1024
HITS = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: array<bigint> of floor(64 x), saturated, for the rows that take part."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")).cast("long"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", x.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float64: exact for integers below 2^53."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def search(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int = K) -> tuple[list, list, list]:
    """Best k of the candidates for each query, by score and then id. `v_ids` ascends."""
    dims = v.shape[1]
    cuts = [*range(0, dims, STEP), dims]
    tall = np.ascontiguousarray(v.T)
    # Suffix norms of candidates before each dimension block.
    rest = np.sqrt(np.stack([(tall[c:] ** 2).sum(0) for c in cuts]))
    out_q, out_v, out_s = [], [], []
    probe = np.argsort(-rest[0], kind="stable")[: 4 * k]  # long vectors give a first threshold
    first = q @ v[probe].T
    for i, query in enumerate(q):
        own = v_ids == q_ids[i]
        seen = first[i][~own[probe]]
        floor_ = np.partition(seen, -k)[-k] if len(seen) >= k else -np.inf
        tail = np.sqrt(np.array([(query[c:] ** 2).sum() for c in cuts]))
        alive = np.flatnonzero(~own)
        part = np.zeros(len(alive))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            block = tall[lo:hi] if len(alive) == tall.shape[1] else tall[lo:hi, alive]
            part = part + query[lo:hi] @ block
            bound = part + tail[b + 1] * rest[b + 1][alive]
            keep = bound >= floor_ - 1e-6 * (1 + abs(floor_))
            if not keep.all():
                alive, part = alive[keep], part[keep]
        if len(alive) > k:
            cut = np.partition(part, -k)[-k]
            keep = part >= cut
            alive, part = alive[keep], part[keep]
        order = np.lexsort((v_ids[alive], -part))[:k]
        out_q += [int(q_ids[i])] * len(order)
        out_v += v_ids[alive[order]].tolist()
        out_s += part[order].astype(np.int64).tolist()
    return out_q, out_v, out_s


def plain(q: list, q_ids: list, v: list, v_ids: list, k: int = K) -> tuple[list, list, list]:
    """The same for components too large for float64."""
    out: tuple[list, list, list] = ([], [], [])
    for x, i in zip(q, q_ids, strict=True):
        score = lambda y: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True))))  # noqa: B023, E731
        for s, j in sorted((-score(y), j) for y, j in zip(v, v_ids, strict=True) if j != i)[:k]:
            out[0].append(i), out[1].append(j), out[2].append(-s)
    return out


def block_pair(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Best k of a block of vectors for each query of a block; lengths are kept apart."""
    left, right = left.select(["vec_id", "v"]), right.select(["vec_id", "v"])
    got: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        right = right.sort_by("vec_id")
        size = lambda t: np.diff(t["v"].combine_chunks().offsets.to_numpy())
        ql, vl = size(left), size(right)
        for n in np.unique(ql):
            a, b = left.filter(pa.array(ql == n)), right.filter(pa.array(vl == n))
            if not b.num_rows:
                continue
            qv, vv = matrix(a["v"].combine_chunks()), matrix(b["v"].combine_chunks())
            exact = np.abs(qv).max() * np.abs(vv).max() * int(n) < 2**52
            found = search(qv, a["vec_id"].to_numpy(), vv, b["vec_id"].to_numpy(), k) if exact else plain(a["v"].to_pylist(), a["vec_id"].to_pylist(), b["v"].to_pylist(), b["vec_id"].to_pylist(), k)
            for x, y in zip(got, found, strict=True):
                x.extend(y)
    return pa.table({"query_id": pa.array(got[0], pa.int64()), "vec_id": pa.array(got[1], pa.int64()), "score": pa.array(got[2], pa.int64())})


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """`queries` and `vectors` as of `integers`: query_id, rank, vec_id, score."""
    n_q, n_v = queries.count(), vectors.count()
    q_blocks, v_blocks = max(1, -(-n_q // QUERY_ROWS)), max(1, -(-n_v // VECTOR_ROWS))
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("vec_id", "v", block(q_blocks, 0).alias("qb"), each(v_blocks).alias("vb"))
    v = vectors.select("vec_id", "v", block(v_blocks, 1).alias("vb"), each(q_blocks).alias("qb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_pair(left, right, k)

    pairs = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(best, HITS)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 20 against all rows."""
    rows = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"]), rows)


OP3_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
