"""Quality by regularised quadratic discriminant analysis of document statistics.

A text becomes STATISTICS numbers (lengths, shares of byte classes, repetition of words, pairs and lines,
byte entropy), each brought to a bell-like shape by a root or logarithm when it is counted, then
standardised and cut off at CUT deviations. Each class has a mean and a covariance shrunk twice: towards
the pooled covariance by `pooled`, then towards a multiple of the identity by `round_`; both shares
are chosen by log loss on folds of the training rows. The covariance enters as its cached Cholesky factor:
the Mahalanobis distance is the squared length of inverse factor times deviation, the log determinant is
read off its diagonal. The score is a logistic of the log-density difference, whose slope and offset are
fitted on the folds' left-out rows.

Training takes at most SAMPLE labelled documents that are not held out, those of the smallest hash of
doc_id; of these only the statistics reach the driver. One pass without a shuffle scores every whole text.

Edge cases: a null text is an empty one, whose statistics are 0, and is scored like any other; very long
texts are blocks of their own; repeated rows get equal scores; a label that is null or not 0 or 1 is not
learnt from; of several labels of one doc_id the largest counts, of several texts one; without five
learnable rows of each class the score is the share of positives (1/2 if there are no labels); a null
doc_id is scored and not held out; an empty table gives an empty one; a column `score` is replaced, other
columns are kept and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, small_batches, table
from .textscan import blocks, mix, word_bytes, words

#: Labelled documents that training uses at most.
SAMPLE = 12_000
#: Standardised statistics are cut off at so many deviations.
CUT = 6.0
#: Shares that are tried for shrinkage to the pooled covariance and to the identity.
POOLED, ROUND = (0.0, 0.1, 0.3, 0.6, 1.0), (0.01, 0.05, 0.2)
FOLDS, SEED, LEAST = 5, 13, 5
#: From this score on a text is predicted to be good.
THRESHOLD = 0.3
_WORD = word_bytes()
_LINE = word_bytes(b"\n")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Byte classes whose shares are statistics.
CLASSES = {
    "letters": _WORD & ~_class(b"0123456789"),
    "capitals": _class(bytes(range(65, 91))),
    "digits": _class(b"0123456789"),
    "white": _class(b" \t\r\n\v\f"),
    "stops": _class(b".,;:'\"-"),
    "shouts": _class(b"!?"),
    "symbols": _class(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "lines": _class(b"\n"),
}
STATISTICS = (
    *CLASSES, "bytes", "words", "word_length", "word_spread", "short_words", "long_words", "capital_words", "distinct", "distinct_root", "commonest", "repeated_pairs",
    "line_length", "repeated_lines", "runs", "entropy",
)


def repeats(text: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its distinct codes and the count of the most frequent one."""
    order = np.lexsort((code, text))
    t, c = text[order], code[order]
    heads = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))) if len(t) else np.zeros(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, t[heads], np.diff(np.append(heads, len(t))))
    return np.bincount(t[heads], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x STATISTICS; every row is finite."""
    n, size = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(size, 1)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    count = {name: within(of[data]) for name, of in CLASSES.items()}
    out = {name: np.sqrt(c / some) for name, c in count.items()}
    out["capitals"] = np.sqrt(count["capitals"] / np.maximum(count["letters"], 1))
    w = words(data, offsets, _WORD)
    text, k, length = w.text, w.counts, (w.stop - w.start).astype(float)
    many = np.maximum(k, 1)
    mean = np.bincount(text, length, n) / many
    out["bytes"], out["words"], out["word_length"] = np.log1p(size), np.log1p(k), np.log1p(mean)
    out["word_spread"] = np.log1p(np.sqrt(np.maximum(np.bincount(text, length**2, n) / many - mean**2, 0)))
    share = lambda flag: np.sqrt(np.bincount(text, flag, n) / many)
    raw = data[w.start] if len(w.start) else np.zeros(0, np.uint8)
    out["short_words"], out["long_words"], out["capital_words"] = share(length <= 2), share(length >= 12), share((raw >= 65) & (raw <= 90))
    distinct, most = repeats(text, w.hash, n)
    out["distinct"], out["distinct_root"], out["commonest"] = np.sqrt(distinct / many), np.log1p(distinct / np.sqrt(many)), np.sqrt(most / many)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pairs, _ = repeats(text[inner], mix(w.hash[inner] * np.uint64(3) + w.hash[inner + 1]), n)
    out["repeated_pairs"] = np.sqrt(1 - pairs / np.maximum(k - 1, 1)) * (k > 1)
    lines = words(data, offsets, _LINE)
    full = np.maximum(lines.counts, 1)
    out["line_length"] = np.log1p(np.bincount(lines.text, (lines.stop - lines.start).astype(float), n) / full)
    out["repeated_lines"] = np.sqrt(1 - repeats(lines.text, lines.hash, n)[0] / full) * (lines.counts > 0)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (data[1:] != 32)
    out["runs"] = np.sqrt(within(same) / some)
    entropy = np.zeros(n)
    for lo in range(0, n, 256):
        part = offsets[lo : min(lo + 256, n) + 1]
        of = np.repeat(np.arange(len(part) - 1), np.diff(part))
        p = np.bincount(of * 256 + data[part[0] : part[-1]], minlength=256 * (len(part) - 1)).reshape(-1, 256) / some[lo : lo + 256, None]
        entropy[lo : lo + 256] = -(p * np.log2(np.maximum(p, 1e-300))).sum(1)
    out["entropy"] = entropy
    return np.stack([np.asarray(out[s], float) for s in STATISTICS], 1)


@dataclass
class Gauss:
    """A class's density with the inverse of its covariance's Cholesky factor."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray, share: float) -> Gauss:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), float(np.log(share) - np.log(np.diag(factor)).sum()))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * (((x - self.mean) @ self.inverse.T) ** 2).sum(1)


@dataclass
class Discriminant:
    """Standardisation, both densities, and the logistic of their difference; without densities a constant."""

    share: float
    middle: np.ndarray | None = None
    spread: np.ndarray | None = None
    classes: tuple[Gauss, Gauss] | None = None
    slope: float = 1.0
    offset: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.spread, -CUT, CUT)
        return self.classes[1].log_density(z) - self.classes[0].log_density(z)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        return logistic(self.slope * self.differences(x) + self.offset)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def discriminant(x: np.ndarray, y: np.ndarray, pooled: float, round_: float) -> Discriminant:
    middle, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = np.clip((x - middle) / spread, -CUT, CUT)
    parts = [z[y == k] for k in (0, 1)]
    own = [np.cov(p, rowvar=False, bias=True) for p in parts]
    common = sum(len(p) * s for p, s in zip(parts, own, strict=True)) / len(z)
    out = []
    for p, s in zip(parts, own, strict=True):
        mixed = (1 - pooled) * s + pooled * common
        flat = max(np.trace(mixed) / len(mixed), 1e-6)
        out.append(Gauss.of(p.mean(0), (1 - round_) * mixed + round_ * flat * np.eye(len(mixed)), len(p) / len(z)))
    return Discriminant(float(y.mean()), middle, spread, (out[0], out[1]))


def calibrated(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic of `d` by Newton steps; ends of targets are drawn in a little."""
    scale = max(float(np.abs(d).mean()), 1e-9)
    x = np.stack([d / scale, np.ones(len(d))], 1)
    n = y.sum()
    target = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = logistic(x @ at)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return max(float(at[0]), 1e-6) / scale, float(at[1])


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """x: documents x statistics; y: 0 or 1."""
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return Discriminant(float(y.mean()) if len(y) else 0.5)
    fold = np.empty(len(y), int)
    rng = np.random.default_rng(SEED)
    for k in (0, 1):  # every fold has rows of both classes
        of = rng.permutation(np.flatnonzero(y == k))
        fold[of] = np.arange(len(of)) % FOLDS
    best = None
    for pooled in POOLED:
        for round_ in ROUND:
            d = np.empty(len(y))
            for f in range(FOLDS):
                d[fold == f] = discriminant(x[fold != f], y[fold != f], pooled, round_).differences(x[fold == f])
            slope, offset = calibrated(d, y)
            p = np.clip(logistic(slope * d + offset), 1e-12, 1 - 1e-12)
            loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
            if best is None or loss < best[0]:
                best = (loss, pooled, round_, slope, offset)
    model = discriminant(x, y, best[1], best[2])
    model.slope, model.offset = best[3], best[4]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Discriminant:
    """Fit on at most `limit` labelled rows of `docs(doc_id, text)` that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    chosen = bounded_sample(known, "doc_id", limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                flat = pa.array(statistics(data, offsets).reshape(-1))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(STATISTICS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["y"][lo:hi], rows], ["doc_id", "y", "x"])

    # The sample is bounded by `limit`, so it can be broadcast and its statistics fit the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("doc_id")
    return fit(got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)), got["y"].to_numpy())


def score(docs: DataFrame, model: Discriminant, keep: list[str] | None = None) -> DataFrame:
    """The columns of `docs` named in `keep` (all) and `score`."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["_text"]):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(sent.value.scores(statistics(data, offsets)))], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(apply, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; the model is learnt from the labels of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
