"""Mixing to target weights with soft domain membership.

A classifier learnt from the labelled table gives every document a posterior over domains (one
factorization machine per domain, against the rest; its terms are words, runs of other signs, and
buckets of length and of repetition).

Rates r >= 0 minimize 1/2 |sum_d r_d n_d p_d - T|^2 / N + RIDGE / 2 sum_d n_d (r_d - r0)^2 with n_d the
tokens (words) of a document, p_d its posterior, T the target totals and N all tokens. At the solution
r_d = max(0, r0 - p_d . m) with one multiplier m for each domain, so every document has a rate of its own.

The solver is projected gradient with momentum (dropped when it goes against the gradient), in units where
the step of a document is its posterior times g. Its steps run over cells: documents whose posteriors round
to the same multiples of 1 / GRID, with their summed tokens and mean posterior; each is a Spark
aggregation. When no cell's rate moves by NEAR, or after WARM steps, the multipliers that fit the cells'
rates begin Newton's steps on the multipliers' convex dual, over the documents themselves: each is
one aggregation of as many numbers as there are pairs of domains, halved while the dual does not fall enough.
They end when the totals are off those of the solution by CLOSE of all tokens, and an error tells if they
do not. RIDGE is so small that reachable targets are met; unreachable ones are approached.

Edge cases: a null or empty text has no tokens and gets the rate of its posterior; repeated rows have
equal rates; labels that are null are not learnt from; of several domains of one doc_id the smallest
counts; with one domain all posteriors are 1; a domain without target has target 0; without labels or
tokens all rates are r0. Other columns are kept, but for n_tokens, p, rate and copies, which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import toxicity
from .common import bounded_sample, saved, small_batches, table
from .textscan import blocks, lists, mix, word_bytes, words

#: Labelled documents that training uses at most.
SAMPLE = 8_000
GRID, RIDGE = 32, 1e-6
#: Projected gradient over cells: ends when no rate moves by NEAR, or after WARM steps.
WARM, NEAR = 40, 1e-2
#: Newton's steps over documents: at most so many (a handful is usual), until the residual is CLOSE.
STEPS, CLOSE = 200, 1e-9
_WORD = word_bytes()
_SIGN = ~_WORD
_SIGN[[32, 9, 10, 11, 12, 13]] = False

#: Production targets: shares of tokens by language and quality, and tokens wanted per token there is.
TARGETS = {"de-q0": 0.015, "de-q1": 0.16, "en-q0": 0.04, "en-q1": 0.51, "es-q0": 0.01, "es-q1": 0.135, "fr-q0": 0.01, "fr-q1": 0.12}
BUDGET = 1.25


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, text) of the distinct terms, and the number of words of each text."""
    w, s = words(data, offsets, _WORD), words(data, offsets, _SIGN)
    n = len(offsets) - 1
    many = w.counts
    pairs = np.unique((w.text.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20)))
    distinct = np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=n)
    length = np.log2(many + 1.0).astype(np.uint64)
    repeat = (10 * distinct / np.maximum(many, 1)).astype(np.uint64)
    signs = (8 * s.counts / np.maximum(many, 1)).clip(0, 40).astype(np.uint64)
    own = np.arange(n)
    coded = [(w.hash, w.text), (mix(s.hash + np.uint64(1)), s.text)]
    coded += [(mix(x + np.uint64((k + 2) << 50)), own) for k, x in enumerate((length, repeat, signs))]
    bits = toxicity.BITS
    key = np.unique(np.concatenate([(t.astype(np.uint64) << np.uint64(bits)) | (c >> np.uint64(64 - bits)) for c, t in coded]))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), (key >> np.uint64(bits)).astype(np.int64), many


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[str], list[toxicity.Machine]]:
    """`labels(doc_id, domain)`: domains and a machine for each, from at most `limit` documents."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = bounded_sample(known, "doc_id", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                slots, text, _ = features(data, offsets)
                made = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()), pa.array(slots, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["domain"][lo:hi], made], ["doc_id", "domain", "slots"])

    # Bounded by `limit`.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text")
    made = rows.mapInArrow(run, "doc_id long, domain string, slots array<int>")
    # A doc_id with several texts is learnt once.
    got = made.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.min_by("slots", F.xxhash64("slots")).alias("slots")).toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    domain = np.array(got["domain"].to_pylist(), object)[order]
    slots = lists(got["slots"], order)
    names = sorted(set(domain.tolist()))
    machines = [toxicity.fit(slots, (domain == x).astype(float), positive=1.0, pairs=False) for x in names]
    del got, slots
    pa.default_memory_pool().release_unused()
    return names, machines


def posteriors(docs: DataFrame, names: list[str], machines: list[toxicity.Machine]) -> DataFrame:
    """`docs` with n_tokens and p (array over names, sum 1; columns of these names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(machines)
    keep = [c for c in docs.columns if c not in ("n_tokens", "p")]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("p", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                slots, text, many = features(data, offsets)
                p = np.stack([1 / (1 + np.exp(-np.clip(m.logits(slots, text, hi - lo), -30, 30))) for m in sent.value], 1)
                p /= p.sum(1, keepdims=True)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), p.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(many, pa.int64()), lists], [*keep, "n_tokens", "p"])

    return docs.select(*keep).mapInArrow(run, schema)


def cell_of(p: Column) -> Column:
    return F.transform(p, lambda x: F.round(x * GRID).cast("int"))


def moved(center: Column, x: Column, y: Column, history: list[tuple[list[float], float]], step: float, r0: float) -> Column:
    """(x, y, d, e) after the steps of `history` ((gradient over domains, momentum) of each).

    Of the last step, d is how far it moved and e > 0 if momentum went against the gradient.
    """
    dot = lambda g: F.aggregate(F.zip_with(center, g, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    # One literal, however long the history is.
    told = json.dumps([{"g": g, "b": b} for g, b in history])
    rows = F.from_json(F.lit(told), "array<struct<g:array<double>,b:double>>")

    def move(acc: Column, h: Column) -> Column:
        new = F.greatest(F.lit(0.0), acc["y"] - step * (dot(h["g"]) + RIDGE * (acc["y"] - r0)))
        return F.struct(new.alias("x"), (new + h["b"] * (new - acc["x"])).alias("y"), F.abs(new - acc["y"]).alias("d"), ((acc["y"] - new) * (new - acc["x"])).alias("e"))

    return F.aggregate(rows, F.struct(x.alias("x"), y.alias("y"), F.lit(float("inf")).alias("d"), F.lit(0.0).alias("e")), move)


def warm(soft: DataFrame, goal: np.ndarray, r0: float) -> tuple[np.ndarray, float]:
    """(multipliers that fit the rates of the cells after projected gradient, tokens) of `soft(n_tokens, p)`."""
    k = len(goal)
    rows = soft.select("n_tokens", "p", cell_of(F.col("p")).alias("cell"))
    at = [F.get("p", F.lit(i)) for i in range(k)]
    mass = F.sum("n_tokens").cast("double")
    center = F.array(*(F.when(mass > 0, F.sum(F.col("n_tokens") * x) / mass).otherwise(F.avg(x)) for x in at))
    cells = saved(rows.groupBy("cell").agg(mass.alias("mass"), center.alias("center")), "mixing-cells")
    at = [F.get("center", F.lit(i)) for i in range(k)]
    told = cells.agg(F.sum("mass").alias("n"), *(F.sum(F.col("mass") * x).alias(f"s{i}") for i, x in enumerate(at))).first()
    total = told["n"] or 0.0
    if not total:
        return np.zeros(k), 0.0
    # Posteriors sum to 1, so a row of their second moments sums to its domain's share, which bounds the curvature.
    step = float(1 / (max(told[f"s{i}"] for i in range(k)) / total + RIDGE))
    cells = cells.withColumns({"x": F.lit(r0), "y": F.lit(r0), "d": F.lit(float("inf")), "e": F.lit(0.0)})
    history: list[tuple[list[float], float]] = []
    age = 0
    while True:
        rated = cells
        if history:
            rated = cells.select("mass", "center", moved(F.col("center"), F.col("x"), F.col("y"), history, step, r0).alias("now")).select("mass", "center", "now.*")
        # Gradient at y: one aggregation over the cells.
        got = rated.agg(*(F.sum(F.col("mass") * F.col("y") * x).alias(f"s{i}") for i, x in enumerate(at)), F.max("d").alias("d"), F.sum(F.col("mass") * F.col("e")).alias("e")).first()
        if got["d"] < NEAR or len(history) == WARM:
            break
        age = 0 if got["e"] > 0 else age
        history.append(((np.array([got[f"s{i}"] for i in range(k)]) / total - goal).tolist(), age / (age + 3)))
        age += 1
    # r0 - x = center . m over the cells that are not at 0, by least squares.
    fitted = _summed(rated.where("x > 0").select(F.col("mass").alias("n_tokens"), F.col("center").alias("p"), (F.lit(r0) - F.col("x")).alias("v")), k, lambda n, p, v: (p.T @ (n * v), (p * n[:, None]).T @ p), "v double")
    if fitted is None:
        return np.zeros(k), total
    right, gram = fitted
    return np.linalg.solve(gram + 1e-6 * total * np.eye(k), right), total


def _summed(rows: DataFrame, k: int, of, extra: str = "") -> list[np.ndarray] | None:
    """Sums over `rows(n_tokens, p, ...)` of the arrays that `of` makes from a batch; None without rows.

    Every task sends its sums once; they are added up by their places, so the driver gets one number for each.
    """
    names = [x.split()[0] for x in extra.split(", ")] if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                p = batch["p"].flatten().to_numpy().reshape(-1, k)
                got = of(batch["n_tokens"].to_numpy().astype(float), p, *(batch[c].to_numpy() for c in names))
                held = got if held is None else [a + b for a, b in zip(held, got, strict=True)]
        for i, x in enumerate(held or ()):
            flat = np.asarray(x, float).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), i), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["part", "place", "v"])

    got = rows.mapInArrow(run, "part int, place int, v double").groupBy("part", "place").agg(F.sum("v").alias("v")).toArrow().sort_by([("part", "ascending"), ("place", "ascending")])
    if not got.num_rows:
        return None
    part, v = got["part"].to_numpy(), got["v"].to_numpy()
    shape = {1: (), k: (k,), k * k: (k, k)} if k > 1 else {1: (1,)}
    return [v[part == i].reshape(shape[(part == i).sum()]) for i in range(int(part.max()) + 1)]


def solve(soft: DataFrame, target: list[float], budget: float) -> np.ndarray:
    """The multipliers of `soft(n_tokens, p)`: a document's rate is max(0, budget - p . multipliers)."""
    k, r0 = len(target), float(budget)
    goal = np.array(target, float) * r0
    if k < 2:
        return np.zeros(k)
    m, total = warm(soft, goal, r0)
    if not total:
        return m

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual, its gradient and its second derivatives."""

        def of(n: np.ndarray, p: np.ndarray) -> tuple:
            rate = np.maximum(0.0, r0 - p @ m)
            on = p * (n * (rate > 0))[:, None]
            return np.array([0.5 * n @ rate**2]), p.T @ (n * rate), on.T @ p

        value, totals, second = _summed(soft.select("n_tokens", "p"), k, of)
        return float(value) / total + goal @ m + RIDGE / 2 * m @ m, goal + RIDGE * m - totals / total, second / total + RIDGE * np.eye(k)

    value, slope, second = at(m)
    for _ in range(STEPS):
        if np.abs(slope).max() < CLOSE * max(1.0, r0):
            return m
        step = np.linalg.solve(second, slope)
        share = 1.0
        while True:
            new = at(m - share * step)
            # Close to the end the dual's last digits no longer tell; there the slope has to fall.
            if new[0] <= value - 1e-4 * share * (slope @ step) or np.abs(new[1]).max() < np.abs(slope).max() and abs(new[0] - value) <= 1e-12 * max(1.0, abs(value)):
                break
            share /= 2
            if share < 1e-9:
                raise RuntimeError(f"rates are off their targets by {np.abs(slope).max():.2g} of all tokens and no step helps")
        m, (value, slope, second) = m - share * step, new
    raise RuntimeError(f"rates are off their targets by {np.abs(slope).max():.2g} of all tokens after {STEPS} steps")


def rated(soft: DataFrame, target: list[float], budget: float) -> DataFrame:
    """`soft(n_tokens, p)` with its rates."""
    m = solve(soft, target, budget)
    dot = F.aggregate(F.zip_with("p", F.array(*(F.lit(float(x)) for x in m)), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    return soft.withColumn("rate", F.greatest(F.lit(0.0), F.lit(float(budget)) - dot))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float) -> DataFrame:
    """`docs` with n_tokens, p, rate and copies: whole copies whose expectation is the rate.

    A document's chance is a hash of its doc_id and text, so a rerun gives the same copies.
    """
    docs = docs.drop("n_tokens", "p", "rate", "copies")
    names, machines = train(docs, labels)
    if not names:
        none = F.lit(float(budget))
        return docs.withColumns({"n_tokens": F.lit(None).cast("long"), "p": F.array().cast("array<double>"), "rate": none, "copies": _copies(none)})
    soft = saved(posteriors(docs, names, machines), "mixing-posteriors")
    return rated(soft, [targets.get(x, 0.0) for x in names], budget).withColumn("copies", _copies(F.col("rate")))


def _copies(rate: Column) -> Column:
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mixing")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + chance).cast("long")


def labelled_domains(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, domain: language and quality of the labelled documents whose language is known."""
    lang = docs.where("lang is not null and doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return labels.join(lang, "doc_id").select("doc_id", F.concat("lang", F.lit("-q"), F.col("quality").cast("string")).alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document; without labels all rates are BUDGET, posteriors empty."""
    docs = table(spark, sf_dir, "documents")
    out = mixed(docs.select("doc_id", "text"), labelled_domains(table(spark, sf_dir, "labels"), docs), TARGETS, BUDGET)
    return out.select("doc_id", "n_tokens", F.col("p").alias("posterior"), "rate", "copies")
