"""How many points lie near others on a plane, and the largest of them, without making pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breakline.functions.runs import quadrants, spread, whole_runs

#: Points times queries of a cell up to which all are compared.
SMALL = 4096


def _answer(keys: list[str], distance: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, heads in whole_runs(batches, [*keys, "_x", "_y"]):
            asks, x, y, n, top, cx, cy = (rows[c].to_numpy() for c in ("_asks", "x", "y", "n", "top", "_x", "_y"))
            ends = np.append(heads[1:], len(x))
            points = np.add.reduceat(1 - asks, heads)  # they stand first in each cell
            total, best = np.zeros(len(x), np.int64), np.full(len(x), -1)
            small = points * (ends - heads - points) <= SMALL
            q = np.flatnonzero((asks == 1) & np.repeat(small, ends - heads))
            cell = np.searchsorted(heads, q, side="right") - 1
            i, p = spread(heads[cell], heads[cell] + points[cell])
            near = (np.abs(x[p] - x[q[i]]) <= distance) & (np.abs(y[p] - y[q[i]]) <= distance)
            i, p = i[near], p[near]
            np.add.at(total, q[i], n[p])
            np.maximum.at(best, q[i], top[p])
            for c in np.flatnonzero(~small):
                data, ask = slice(heads[c], heads[c] + points[c]), np.arange(heads[c] + points[c], ends[c])
                own = [(x, int(cx[heads[c]])), (y, int(cy[heads[c]]))]
                side = [np.sign(np.floor_divide(v[ask], distance + 1) - at) for v, at in own]
                # A cell is as wide as the distance, so an axis binds at one end, or not at all in the own row or column.
                for turn in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                    here = np.logical_and.reduce([s == -1 if t < 0 else s >= 0 for s, t in zip(side, turn, strict=True)])
                    if not here.any():
                        continue
                    # Query right of the points: x >= qx - d, so both are turned; left: x <= qx + d.
                    flip = [1 if t < 0 else -1 for t in turn]
                    bound = [np.where(s[here] == 0, np.int64(1) << 60, f * v[ask[here]] + distance) for s, f, (v, _) in zip(side, flip, own, strict=True)]
                    total[ask[here]], best[ask[here]] = quadrants(flip[0] * x[data], flip[1] * y[data], n[data], top[data], *bound)
            keep = np.flatnonzero((asks == 1) & (total > 0))
            out = rows.select([*keys, "x", "y"]).take(keep)
            yield from out.append_column("n", pa.array(total[keep])).append_column("top", pa.array(best[keep])).combine_chunks().to_batches()

    return answer


def near_points(points: DataFrame, queries: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """`points(keys, x, y, n, top)` near each of `queries(keys, x, y)`: keys, x, y, n, top.

    Near are points of equal keys with x and y at most `distance` off; n is summed, top (not negative) is
    the largest; queries without a near point have no row, equal queries one. Points are first put together
    by place, so a cell of the grid holds (distance + 1)^2 of them at most, however many rows there are.
    """
    cell = lambda c: F.floor(F.col(c) / (distance + 1)).cast("long")
    placed = points.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    own = placed.select(*keys, cell("x").alias("_x"), cell("y").alias("_y"), F.lit(0).alias("_asks"), "x", "y", "n", "top")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    zero = F.lit(0).cast("long")
    asked = queries.select(*keys, "x", "y").distinct().select("*", around.alias("s")).select(*keys, (cell("x") + F.col("s.i")).alias("_x"), (cell("y") + F.col("s.j")).alias("_y"), F.lit(1).alias("_asks"), "x", "y", zero.alias("n"), zero.alias("top"))
    rows = own.unionByName(asked).repartition(*keys, "_x", "_y").sortWithinPartitions(*keys, "_x", "_y", "_asks")
    fields = {f.name: f for f in rows.schema.fields}
    made = T.StructType([*(fields[c] for c in (*keys, "x", "y")), T.StructField("n", T.LongType()), T.StructField("top", T.LongType())])
    return rows.mapInArrow(_answer(keys, distance), made).groupBy(*keys, "x", "y").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
