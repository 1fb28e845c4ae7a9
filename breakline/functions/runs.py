"""Sorted Arrow rows in runs of equal keys, and sums and maxima over quadrants, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def differ(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike."""
    a, b = column[1:], column[:-1]
    null = pc.xor(pc.is_null(a), pc.is_null(b))
    return pc.or_(null, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each run) of sorted batches, so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(np.logical_or.reduce([differ(batch[k]) for k in keys])) + 1
        first = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]).combine_chunks() if held else None
        begins = first is not None and any(differ(first[k].combine_chunks())[0] for k in keys)
        if held and (begins or len(cuts)):
            ready = [*held, *([] if begins else [batch.slice(0, int(cuts[0]))])]
            yield cut(pa.Table.from_batches(ready), keys)
            batch = batch if begins else batch.slice(int(cuts[0]))
            cuts = cuts if begins else cuts[1:] - cuts[0]
            held = []
        if not held and len(cuts):
            yield cut(pa.Table.from_batches([batch.slice(0, int(cuts[-1]))]), keys)
            batch = batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        yield cut(pa.Table.from_batches(held), keys)


def cut(rows: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    rows = rows.combine_chunks()
    new = np.logical_or.reduce([differ(rows[k].combine_chunks()) for k in keys])
    return rows, np.concatenate(([0], np.flatnonzero(new) + 1))


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for every i and every x from begin[i] up to end[i]."""
    n = np.maximum(end - begin, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]


def quadrants(u: np.ndarray, v: np.ndarray, n: np.ndarray, top: np.ndarray, qu: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the sum of n and the largest top (-1: none) of the points with u <= qu and v <= qv.

    Points stand in order of u. Their ranks by v are split bit by bit, all queries at once, so the
    time is (points + queries) log points. `top` is -1 or more.
    """
    by_u = np.argsort(u, kind="stable")
    k = np.searchsorted(u[by_u], qu, side="right")
    by_v = np.argsort(v, kind="stable")
    t = np.searchsorted(v[by_v], qv, side="right")
    rank = np.empty(len(u), np.int64)
    rank[by_v] = np.arange(len(u))
    # Tops as ranks, so that runs can be told apart by adding to them.
    known, place = np.unique(top, return_inverse=True)
    now, w, m = rank[by_u], n[by_u], place[by_u]
    total, best, low = np.zeros(len(qu), np.int64), np.full(len(qu), -1), np.zeros(len(qu), np.int64)
    for bit in range(len(u).bit_length() - 1, -1, -1):
        one = (now >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        order = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        now, w, m = now[order], w[order], m[order]
        start, stop = zeros[low], zeros[low + k]
        under = (t >> bit & 1).astype(bool)
        # The points of the zero half lie below t: a beginning of their run.
        sums = np.concatenate(([0], np.cumsum(w)))
        total[under] += (sums[stop] - sums[start])[under]
        run = np.cumsum(np.concatenate(([False], now[1:] >> bit != now[:-1] >> bit)))
        high = np.maximum.accumulate(run * (len(known) + 1) + m) - run * (len(known) + 1)
        some = under & (stop > start)
        best[some] = np.maximum(best[some], high[stop[some] - 1])
        low, k = np.where(under, zeros[-1] + low - start, start), np.where(under, k - (stop - start), stop - start)
    return total, np.where(best >= 0, known[np.maximum(best, 0)], -1)
