"""Gap clustering of timed rows: sessions, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """`events(user_id, ts, value)` to user_id, first_ts, last_ts, n, total; steps of up to `gap` join.

    On a stream, `late` is how long late rows are waited for; a session is final when the watermark has
    passed its end. Partial sessions are merged before the shuffle. Rows without ts have no session.
    """
    # Watermarks need a timestamp with time zone; the answer keeps the type of ts.
    rows = events.where("ts is not null").select("user_id", "ts", "value", F.col("ts").cast("timestamp").alias("at"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    grouped = rows.groupBy("user_id", F.session_window("at", gap).alias("w"))
    found = grouped.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.drop("w")


def position_sessions(junctions: DataFrame, keys: list[str], distance: int, late: int | None = None) -> DataFrame:
    """First-level gap clusters of `junctions(keys, pos1)` as sessions of a clock that counts bases.

    One base is one second; the window's end is inclusive, so steps of up to `distance` join. `late` is
    how many bases of disorder a stream may have.
    """
    rows = junctions.select(*keys, "pos1", F.timestamp_seconds("pos1").alias("ts"))
    if late is not None:
        rows = rows.withWatermark("ts", f"{late} seconds")
    grouped = rows.groupBy(*keys, F.session_window("ts", f"{distance} seconds").alias("w"))
    return grouped.agg(F.min("pos1").alias("cluster_start"), F.max("pos1").alias("cluster_end"), F.count(F.lit(1)).alias("cluster_size")).drop("w")
