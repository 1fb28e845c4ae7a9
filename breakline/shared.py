"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without it, a temporary folder, on one machine only.

    On a cluster a local folder would lose what other machines write, so that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("breakline.shared.dir", None)
    if own is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="breakline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = f"file://{path}"
        spark.conf.set("breakline.shared.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write and read again: cuts the lineage and the plan, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if _SCRATCH.get() is not None:
        _SCRATCH.get().append(out)
    return out


#: Tables saved inside the innermost `scratch`.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end the tables that were saved inside are deleted, but for those given to what it yields.

    A table that was kept goes at the end of the scratch around it, if there is one and it is not kept there.
    """
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _SCRATCH.set(made)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        held = {df._saved_at for df in kept}
        discard(*(df for df in made if df._saved_at not in held))
        if _SCRATCH.get() is not None:
            _SCRATCH.get().extend(df for df in made if df._saved_at in held)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `saved` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def filesystem(uri: str):
    """pyarrow's file system and the path inside it, for any store that tasks can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
