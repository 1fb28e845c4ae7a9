"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breakline.shared import new_path, saved, shared_dir

__all__ = ["bounded_sample", "held_out", "maybe_broadcast", "new_path", "saved", "shared_dir", "small_batches", "table"]

#: A side is broadcast only when its counted rows (of a few machine words) are at most this many.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch: texts can be long, and a batch is held on both sides.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5 = 0; false where doc_id is null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, limit: int, seed: int = 11) -> DataFrame:
    """At most `limit` rows, those with the smallest hash of `key`: the same ones on every run."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a counted, bounded side; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_ROWS; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
