"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to 2^BITS slots: its words, and the first bytes (PREFIXES) of
longer words, which stand for the inflections of a stem. The machine's logit is
bias + sum w[i] + 1/2 sum_f ((sum V[i,f])^2 - sum V[i,f]^2), so a pair of words can weigh what neither
does alone. It is trained by AdaGrad in numpy on a bounded sample of labelled rows (SAMPLE documents,
those with the smallest hash of doc_id among rows that are not held out); slots seen in fewer than
MIN_DOCS sampled documents, or that tell nothing about the label, neither alone nor in a pair, keep weight
zero. All texts are then scored whole, in one pass without a
shuffle; the model is sent to the tasks and has a fixed size.

Edge cases: a null or empty text gets the bias alone; repeated rows get equal scores; a label that is
null, or not 0 or 1, is not learnt from; of several labels of one doc_id the largest counts; without
labels of both classes the score is the share of positives (1/2 if there are none); a null doc_id is
scored and not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, small_batches, table
from .textscan import blocks, lists, mix, word_bytes, words

#: Labelled documents that training uses at most.
SAMPLE = 12_000
BITS, FACTORS, EPOCHS, RATE, L2, MIN_DOCS, SEED = 18, 4, 12, 0.1, 1e-4, 5, 3
#: Spread of the factors at the start, and their rate.
START, RATE_V = 0.1, 0.1
#: Weight of a toxic document in training: a miss costs more than a false alarm.
POSITIVE = 3.0
PREFIXES = (4, 5, 6, 8)
#: Slots that training keeps: those of the largest chi-square between presence and label, over a floor.
TERMS, CHI = 4096, 12.0
#: And the slots of pairs that tell together: of the most frequent slots, with an interaction of at least
#: this squared z (27 leaves one chance hit in the 2 million pairs; small cells have heavier tails). They stay only
#: where they lower the loss on a part of the training rows by GAIN: copies of documents make chance hits common.
PAIRED, PAIR_CHI, GAIN = 2048, 40.0, 0.05
_TABLE = word_bytes()


@dataclass
class Machine:
    """w: the weight of every slot; v: the factors of those whose weight is not 0, in their order."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self) -> None:
        self.place = np.cumsum(self.w != 0, dtype=np.int32) - 1

    def logits(self, slots: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """slots: distinct per text, ordered by text."""
        known = self.w[slots] != 0
        slots, text = slots[known], text[known]
        out = np.full(n, self.bias) + np.bincount(text, self.w[slots], n)
        place = self.place[slots]
        for f in range(self.v.shape[1]):
            x = self.v[place, f].astype(np.float64)
            out += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return out


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text) of the distinct hashed terms of each text."""
    w = words(data, offsets, _TABLE)
    terms = [(w.hash, w.text), *(w.prefixes(n) for n in PREFIXES)]
    key = np.sort(np.concatenate([(text.astype(np.uint64) << np.uint64(BITS)) | (code >> np.uint64(64 - BITS)) for code, text in terms]))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def telling(docs: list[np.ndarray], y: np.ndarray, size: int, pairs: bool) -> np.ndarray:
    """Mask of slots that tell about the label, alone or together with another one; rarer ones would only be learnt by heart."""
    n, positives = len(docs), y.sum()
    count = lambda which: sum((np.bincount(np.concatenate(which[i : i + 500]), minlength=size) for i in range(0, len(which), 500)), np.zeros(size))
    a = count([d for d, label in zip(docs, y, strict=True) if label > 0])
    b = count([d for d, label in zip(docs, y, strict=True) if label <= 0])
    seen = a + b
    chi = n * (a * (n - positives - b) - b * (positives - a)) ** 2 / np.maximum(seen * (n - seen) * positives * (n - positives), 1)
    chi[seen < MIN_DOCS] = 0
    kept = chi >= max(CHI, np.sort(chi)[-TERMS])
    if pairs:
        kept[joint(docs, y, seen)] = True
    return kept


def bit_sets(docs: list[np.ndarray], y: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(slots x words of 64 documents, how many words the positive documents take, which stand first)."""
    n, many = len(docs), int(y.sum())
    place = np.full(size, -1)
    place[slots] = np.arange(len(slots))
    wide = -(-many // 64)
    bits = np.zeros((len(slots), wide + -(-(n - many) // 64)), np.uint64)
    at = np.empty(n, np.int64)
    at[y > 0], at[y <= 0] = np.arange(many), 64 * wide + np.arange(n - many)
    for d, b in zip(docs, at.tolist(), strict=True):
        p = place[d]
        bits[p[p >= 0], b >> 6] |= np.uint64(1) << np.uint64(b & 63)
    return bits, wide


def departure(n: int, rate: float, positives: float, alone_i, alone_j, toxic_i, toxic_j, c11: np.ndarray, a11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how far a pair's cells depart from adding up, its squared z; 0 where a cell has fewer than MIN_DOCS).

    With r and c the label's rate and the documents of a cell, z is (r11 - r10 - r01 + r00) over its standard error
    under the common rate.
    """
    c10, a10 = alone_i - c11, toxic_i - a11
    c01, a01 = alone_j - c11, toxic_j - a11
    c00, a00 = n - c11 - c10 - c01, positives - a11 - a10 - a01
    cells = ((c11, a11, 1), (c10, a10, -1), (c01, a01, -1), (c00, a00, 1))
    off = sum(s * a / np.maximum(c, 1) for c, a, s in cells)
    z = off**2 / (rate * (1 - rate) * sum(1 / np.maximum(c, 1) for c, _, _ in cells))
    z[np.minimum.reduce([c for c, _, _ in cells]) < MIN_DOCS] = 0
    return off, z


def joint(docs: list[np.ndarray], y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Slots of pairs whose four cells (both, one, the other, neither) depart from adding up, whatever each does alone.

    The pairs are those of the PAIRED slots in the most documents.
    """
    n, rate = len(docs), y.mean()
    top = np.argsort(-np.where(seen >= n, 0, seen), kind="stable")[:PAIRED]
    top = top[(seen[top] >= MIN_DOCS) & (seen[top] < n)]
    bits, wide = bit_sets(docs, y, top, len(seen))
    count = lambda words: np.bitwise_count(words).sum(1, dtype=np.int64).astype(float)
    alone, toxic = count(bits), count(bits[:, :wide])
    kept = np.zeros(len(top), bool)
    for i in range(len(top)):
        both = bits & bits[i]
        _, z = departure(n, rate, y.sum(), alone[i], alone, toxic[i], toxic, count(both), count(both[:, :wide]))
        kept |= z >= PAIR_CHI
    return top[kept]


def pairs_help(docs: list[np.ndarray], y: np.ndarray, positive: float) -> bool:
    """Whether slots of pairs lower the loss on a fifth of the rows, which training leaves out.

    Rows are dealt by the least hash of their slots, so copies of a document, near ones too, mostly stay together.
    """
    least = np.array([mix(d.astype(np.uint64) + np.uint64(1)).min() if len(d) else 0 for d in docs], np.uint64)
    apart = mix(least) % np.uint64(5) == 0
    loss = []
    for pairs in (False, True):
        m = fit([d for d, a in zip(docs, apart, strict=True) if not a], y[~apart], positive, pairs, True)
        logit = np.array([m.logits(d.astype(np.int64), np.zeros(len(d), int), 1)[0] for d, a in zip(docs, apart, strict=True) if a])
        side = np.where(y[apart] > 0, 1.0, -1.0)
        loss.append(float((np.logaddexp(0, -side * logit) * np.where(side > 0, positive, 1)).sum()))
    return loss[1] < (1 - GAIN) * loss[0]


def fit(docs: list[np.ndarray], y: np.ndarray, positive: float = POSITIVE, pairs: bool = True, sure: bool = False) -> Machine:
    """docs: distinct slots of each document; `pairs`: keep also slots that tell only together, if it helps or is `sure`."""
    size = 1 << BITS
    positives = float(y.mean()) if len(y) else 0.5
    if positives in (0.0, 1.0) or len(y) == 0:
        bias = float(np.log((positives + 1e-3) / (1 - positives + 1e-3)))
        return Machine(bias, np.zeros(size, np.float32), np.zeros((0, FACTORS), np.float32))
    if pairs and not sure:
        pairs = pairs_help(docs, y, positive)
    rng = np.random.default_rng(SEED)
    kept = telling(docs, y, size, pairs)
    # From here on slots are places among those kept.
    place = np.cumsum(kept, dtype=np.int32) - 1
    docs = [place[d[kept[d]]] for d in docs]
    many = int(kept.sum())
    w, v = np.zeros(many), rng.normal(0, START, (size, FACTORS))[kept]
    gw, gv, gb, bias = np.full(many, 1e-2), np.full((many, FACTORS), 1e-2), 1e-2, float(np.log(positives / (1 - positives)))
    for _ in range(EPOCHS):
        for lo in range(0, len(docs), 64):
            pick = order[lo : lo + 64] if lo else (order := rng.permutation(len(docs)))[:64]
            batch = [docs[i] for i in pick]
            slots, text = np.concatenate(batch), np.repeat(np.arange(len(batch)), [len(b) for b in batch])
            sums = np.stack([np.bincount(text, v[slots, f], len(batch)) for f in range(FACTORS)], 1)
            x = v[slots]
            logit = bias + np.bincount(text, w[slots], len(batch)) + 0.5 * ((sums**2).sum(1) - np.bincount(text, (x * x).sum(1), len(batch)))
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) * np.where(y[pick] > 0, positive, 1)
            e = err[text]
            used, back = np.unique(slots, return_inverse=True)
            dw = np.bincount(back, e, len(used)) / len(batch) + L2 * w[used]
            dv = np.stack([np.bincount(back, e * (sums[text, f] - x[:, f]), len(used)) for f in range(FACTORS)], 1) / len(batch) + L2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE_V * dv / np.sqrt(gv[used])
            db = float(err.mean())
            gb += db * db
            bias -= RATE * db / gb**0.5
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return Machine(bias, weights, v[weights[kept] != 0].astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Machine:
    """Fit on at most `limit` labelled rows of `docs(doc_id, text)` that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    chosen = bounded_sample(known, "doc_id", limit)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                slots, text = slots_of(data, offsets)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                made = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(slots, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["y"][lo:hi], made], ["doc_id", "y", "slots"])

    # The sample is bounded by `limit`, so it can be broadcast and its features fit the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(featurize, "doc_id long, y int, slots array<int>")
    # A doc_id with several texts is learnt once.
    once = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("slots", F.xxhash64("slots")).alias("slots"))
    got = once.toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    slots = lists(got["slots"], order)
    machine = fit(slots, got["y"].to_numpy()[order].astype(float))
    # The driver lives on through other stages.
    del got, slots
    pa.default_memory_pool().release_unused()
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with `score` added (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select(*keep).schema.add("score", "double")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                logit = sent.value.logits(*slots_of(data, offsets), hi - lo)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], [*keep, "score"])

    return docs.select(*keep).mapInArrow(apply, schema)


def predicted(score_: str = "score"):
    return (F.col(score_) >= 0.5).cast("int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted().alias("predicted"))
