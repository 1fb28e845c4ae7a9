"""Streams that sweep the genome: clusters and SNP positions are kept in state until the sweep has passed them.

The clock counts bases from the first base of the first contig, one a second, so a watermark is a place. A
row whose clock the watermark has reached is late: Spark drops it and counts it in the query's progress.
Timers fire as the watermark passes the end of what they watch; what is told then is final, and its state
goes. What the sweep has not passed when the input ends is told when a row of a place further on comes.

`prepare` chooses the state store that these operators need.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from breakline.config import CallConfig
from breakline.operators.clusters import REGION
from breakline.operators.coverage import STRETCH
from breakline.operators.sampling import with_offsets


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def clocked(rows: DataFrame, contigs: DataFrame, rname: str, pos: str) -> DataFrame:
    """`rows` with `clock`, the place of (rname, pos) on the genome in seconds; unknown contigs have no place and go."""
    known = with_offsets(contigs).select(F.col("rname").alias("_r"), "before")
    return rows.join(known, F.col(rname) == F.col("_r")).withColumn("clock", F.timestamp_seconds(F.col("before") + F.col(pos))).drop("_r", "before")


def runs(values: np.ndarray, distance: int) -> list[slice]:
    """Stretches of sorted values whose steps are at most `distance`."""
    cuts = [0, *(np.flatnonzero(np.diff(values) > distance) + 1).tolist(), len(values)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


_JUNCTION = ["pos1", "pos2", "qname", "clip", "at"]


class OpenClusters(StatefulProcessor):
    """Junctions of one region key; a first-level cluster closes when no later row can come near its last one."""

    def __init__(self, distance: int) -> None:
        self.distance = distance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "pos1 long, pos2 long, qname string, clip long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            pdf = pdf.assign(at=pdf["clock"].astype("datetime64[s]").astype("int64"))
            self.open.appendList([(int(a), int(b), str(q), int(c), int(t)) for a, b, q, c, t in pdf[_JUNCTION].itertuples(index=False, name=None)])
            last = max(int(pdf["at"].max()), last or 0)
        if last is not None:
            self.handle.registerTimer((last + self.distance) * 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = pd.DataFrame(list(self.open.get()), columns=_JUNCTION).sort_values(_JUNCTION[:4])
        closed, stay = [], []
        for part in runs(held["pos1"].to_numpy(), self.distance):
            group = held.iloc[part]
            (closed if int(group["at"].max()) + self.distance <= passed else stay).append(group)
        if not closed:
            return
        self.open.clear()
        left = [tuple(r) for g in stay for r in g.itertuples(index=False, name=None)]
        if left:
            self.open.put(left)
        out = []
        for group in closed:
            inner = group.sort_values(["pos2", "pos1", "qname", "clip"])
            for part in runs(inner["pos2"].to_numpy(), self.distance):
                g = inner.iloc[part]
                out.append((*key, int(group["pos1"].min()), int(g["pos1"].min()), int(g["pos1"].max()), int(g["pos2"].min()), int(g["pos2"].max()), len(g)))
        yield pd.DataFrame(out, columns=[*REGION, "cluster_start", "pos_lo", "pos_hi", "end_lo", "end_hi", "dv"])


CLUSTERS = "svtype string, rname1 string, rname2 string, flag1 int, flag2 int, cluster_start long, pos_lo long, pos_hi long, end_lo long, end_hi long, dv long"


def gap_clusters(junctions: DataFrame, contigs: DataFrame, distance: int, late: int) -> DataFrame:
    """Both levels of gap clusters of a stream of junctions, each told once, when it is closed.

    `late`: how many bases of disorder rows may have. A row of each second-level cluster: its region,
    where its first-level cluster starts, its bounds and its junctions.
    """
    rows = clocked(junctions.withColumn("qname", F.col("qname").cast("string")), contigs, "rname1", "pos1").select(*REGION, "pos1", "pos2", "qname", "clip", "clock")
    grouped = rows.withWatermark("clock", f"{late} seconds").groupBy(*REGION)
    return grouped.transformWithStateInPandas(OpenClusters(distance), CLUSTERS, "Append", "EventTime")


class OpenPositions(StatefulProcessor):
    """Calls and covering segments of one stretch of a contig; told when the sweep has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "pos long, base string, n long, highq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Sums of the batch; a segment is +1 at its start and -1 behind its end, under the base ' '."""
        sums: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])
        end = None
        for pdf in rows:
            end = int(pdf["end"].iloc[0])
            for pos, stop, base, high in pdf[["pos", "stop", "base", "high"]].itertuples(index=False, name=None):
                if isinstance(base, str):
                    s = sums[int(pos), base]
                    s[0], s[1] = s[0] + 1, s[1] + int(high)
                else:
                    sums[int(pos), " "][0] += 1
                    sums[int(stop) + 1, " "][0] -= 1
        if sums:
            self.counts.appendList([(p, b, n, h) for (p, b), (n, h) in sums.items()])
            self.handle.registerTimer(end * 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.counts.get()), columns=["pos", "base", "n", "highq"]).groupby(["pos", "base"], as_index=False).sum()
        self.counts.clear()
        steps = held[held["base"] == " "].sort_values("pos")
        at, depth = steps["pos"].to_numpy(), np.concatenate(([0], np.cumsum(steps["n"].to_numpy())))
        out = []
        for pos, calls in held[held["base"] != " "].groupby("pos"):
            equal = int(depth[np.searchsorted(at, pos, side="right")]) - int(calls["n"].sum())
            found = [(-int(n), b, int(h)) for b, n, h in calls[["base", "n", "highq"]].itertuples(index=False, name=None)]
            found += [(-equal, "=", equal)] if equal > 0 else []
            top = [*sorted(x for x in found if x[1] != "-")[:2], None, None][:2]
            total, gone = -sum(x[0] for x in found), -sum(x[0] for x in found if x[1] == "-")
            out.append((key[0], int(pos), total, gone, *((v for t in top for v in ((t[1], -t[0], t[2]) if t else (None, None, None))))))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ALLELES.split(", ")]).astype({c: "Int64" for c in ("n1", "highq1", "n2", "highq2")}).astype(object).where(lambda x: x.notna(), None)


ALLELES = "chr string, pos long, total long, deletions long, base1 string, n1 long, highq1 long, base2 string, n2 long, highq2 long"


def snp_alleles(calls: DataFrame, covering: DataFrame, contigs: DataFrame, config: CallConfig, late: int, stretch: int = STRETCH) -> DataFrame:
    """Alleles of every called position, as of `phasing.discovered`, from streams, each told once.

    `calls(chr, pos, base, qual, start)` with the start of the alignment they come from, and the kept segments
    `covering(rname, pos, stop, start)`; rows come in the order of `start`, with `late` bases of disorder. A position
    is final when alignments start behind the end of its stretch.
    """
    number = lambda c: F.floor(F.col(c) / stretch).cast("long")
    one = calls.select("chr", number("pos").alias("stretch"), "pos", F.col("pos").alias("stop"), "base", (F.coalesce("qual", F.lit(-1)) >= config.min_base_qual_ph).cast("int").alias("high"), "start")
    cut = covering.where("pos <= stop").select(F.col("rname").alias("chr"), F.explode(F.sequence(number("pos"), number("stop"))).alias("stretch"), F.col("pos").alias("_a"), F.col("stop").alias("_b"), "start")
    inside = cut.select("chr", "stretch", F.greatest("_a", F.col("stretch") * stretch).alias("pos"), F.least("_b", F.col("stretch") * stretch + stretch - 1).alias("stop"), F.lit(None).cast("string").alias("base"), F.lit(0).alias("high"), "start")
    rows = clocked(one.unionByName(inside), contigs, "chr", "start")
    # The clock of the stretch's end is as far ahead of the row's clock as the positions are apart.
    rows = rows.withColumn("end", F.unix_seconds("clock") + (F.col("stretch") + 1) * stretch - F.col("start")).drop("start")
    grouped = rows.withWatermark("clock", f"{late} seconds").groupBy("chr", "stretch")
    return grouped.transformWithStateInPandas(OpenPositions(), ALLELES, "Append", "EventTime")
