"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the n-grams of the bytes of a lower-cased word between two marks, for n in ORDERS, and
the word itself, each hashed to a row of the embedding table. A text is the mean of its rows; a softmax
over the learnt languages follows. Training uses a bounded sample of rows that are not held out
(at most PER_LANG documents of a language, chosen by the hash of doc_id). A temperature is fitted on a
part of the sample that training leaves out, and so is a threshold: the least at which the texts of that
part that reach it are right in PRECISION of cases. `rejected` marks texts whose best calibrated
probability is under it; they keep their predicted language, as the query asks for a learnt one. As embedding and softmax are both linear, scoring uses their product: one row of class
weights for each subword.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; repeated rows get equal
results; a null lang is not learnt from; without any learnable row all texts are `und` and rejected; more
than MAX_LANGS languages are an error; a null doc_id is predicted and not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .textscan import Words, blocks, mix, word_bytes, words

#: Documents of each language that training uses at most.
PER_LANG = 600
BITS, DIM, ORDERS, EPOCHS, RATE, BATCH, SEED = 17, 8, (2, 3, 4), 4, 0.5, 32, 5
#: Share of right answers among the left-out texts that the rejection threshold lets pass.
PRECISION = 0.99
#: Languages that a model can hold.
MAX_LANGS = 1000
UNKNOWN = "und"
_TABLE = word_bytes()
_TABLE[48:58] = False  # digits are no letters


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # subword x language
    bias: np.ndarray
    temperature: float
    reject: float = 0.0


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """One position of each distinct word, and for each word the place of its distinct word."""
    _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
    return at, back


def subwords(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the table, place in `at`) of all subwords of the words at `at`, with repeats."""
    shift = np.uint64(64 - BITS)
    rows, owner = [(w.hash[at] >> shift).astype(np.int32)], [np.arange(len(at))]
    start, length = w.start[at], w.stop[at] - w.start[at]
    # Every word once between marks: byte 0 before and after it.
    size = length + 2
    ends, before = np.cumsum(size), np.cumsum(length) - length
    inner = np.arange(int(length.sum()))
    marked = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    marked[inner + np.repeat(ends - length - 1 - before, length)] = w.data[inner + np.repeat(start - before, length)]
    of = np.repeat(np.arange(len(size)), size)
    left = np.repeat(ends, size) - np.arange(len(marked))  # bytes up to the end of the marked word
    code = marked.copy()
    for n in range(2, max(ORDERS) + 1):
        code[: max(0, len(marked) - n + 1)] = (code[: max(0, len(marked) - n + 1)] << np.uint64(8)) | marked[n - 1 :]
        if n in ORDERS:
            ok = np.flatnonzero(left >= n)
            rows.append((mix(code[ok] + np.uint64(n << 56)) >> shift).astype(np.int32))
            owner.append(of[ok])
    return np.concatenate(rows), np.concatenate(owner)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, row, count) of the subwords of each text, ordered by text."""
    w = words(data, offsets, _TABLE)
    rows, text = subwords(w, np.arange(len(w.start)))
    key, n = np.unique((w.text[text].astype(np.int64) << BITS) | rows, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str]) -> Model:
    """docs: (table rows, counts) of each document; y: index into langs."""
    rng = np.random.default_rng(SEED)
    table_, out, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(docs))
    apart = order[: len(order) // 10]
    used = order[len(order) // 10 :]
    for epoch in range(EPOCHS):
        step = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(used), BATCH):
            pick = used[lo : lo + BATCH]
            rows = np.concatenate([docs[i][0] for i in pick])
            text = np.repeat(np.arange(len(pick)), [len(docs[i][0]) for i in pick])
            share = np.concatenate([docs[i][1] / max(1, docs[i][1].sum()) for i in pick])
            hidden = np.stack([np.bincount(text, table_[rows, d] * share, len(pick)) for d in range(DIM)], 1)
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ out.T
            out -= step * hidden.T @ p / len(pick) * 8
            bias -= step * p.mean(0)
            seen, place = np.unique(rows, return_inverse=True)
            table_[seen] -= step * np.stack([np.bincount(place, back[text, d] * share, len(seen)) for d in range(DIM)], 1)
        rng.shuffle(used)
    weights = table_ @ out
    logits = np.array([(weights[r] * (c / max(1, c.sum()))[:, None]).sum(0) + bias for r, c in (docs[i] for i in apart)]).reshape(len(apart), len(langs))

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(apart)), y[apart]] - np.log(np.exp(z).sum(1))).mean())

    temperature = min((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss) if len(apart) else 1.0
    return Model(langs, weights.astype(np.float32), bias, temperature, threshold(logits / temperature, y[apart]))


def threshold(logits: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least best probability at which the texts that reach it are right in `precision` of cases; 0 if
    all do, above 1 if none."""
    p = np.exp(logits - logits.max(1, keepdims=True)) if len(y) else np.ones((0, 1))
    top, right = (p / p.sum(1, keepdims=True)).max(1), p.argmax(1) == y
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) >= precision * np.arange(1, len(y) + 1)
    # Equal probabilities pass together.
    last = np.append(top[order][1:] != top[order][:-1], True)[: len(y)]
    fit_ = np.flatnonzero(good & last)
    if not len(fit_):
        return 0.0 if not len(y) else 2.0
    return 0.0 if fit_[-1] == len(y) - 1 else float(top[order][fit_[-1]])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Fit on at most about `per_lang` documents of a language that are not held out."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    langs = sorted(counts)
    # A document is chosen where the hash of its id is under its language's share.
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / counts[k])))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.element_at(share, F.col("lang")))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                text, rows, n = features(data, offsets)
                cut = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, pa.int32())) for x in (rows, n)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], batch["lang"][lo:hi], *lists], ["doc_id", "lang", "rows", "n"])

    got = chosen.mapInArrow(featurize, "doc_id long, lang string, rows array<int>, n array<int>").toArrow().sort_by("doc_id")
    rows, n = got["rows"].combine_chunks(), got["n"].combine_chunks()
    cut = rows.offsets.to_numpy()
    flat, many = rows.values.to_numpy(), n.values.to_numpy()
    where = {k: i for i, k in enumerate(langs)}
    return fit([(flat[a:b].astype(np.int64), many[a:b].astype(float)) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.array([where[x] for x in got["lang"].to_pylist()], int), langs)


def predict(docs: DataFrame, model: Model | None, reject: float = 0.0) -> DataFrame:
    """`docs` with lang_pred, score and rejected added (columns of those names are replaced).

    A text whose best probability is under `reject` is `und` besides.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    if model is None:
        return docs.select(*keep).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                w = words(data, offsets, _TABLE)
                at, back = distinct_words(w)  # each is looked up once
                rows, owner = subwords(w, at)
                text, sums = w.text, [np.bincount(owner, m.weights[rows, k], len(at)) for k in range(len(m.langs))]
                many = np.bincount(text, np.bincount(owner, minlength=len(at))[back], hi - lo)
                logit = np.stack([np.bincount(text, x[back], hi - lo) for x in sums], 1) / np.maximum(many, 1)[:, None] + m.bias
                logit /= m.temperature
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                top = p[np.arange(hi - lo), best]
                text_ = batch["text"].slice(lo, hi - lo)
                letter = pc.fill_null(pc.match_substring_regex(text_, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best = np.where(letter & (top >= reject), best, len(m.langs))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(names[best], pa.string()), pa.array(np.where(letter, top, 0.0)), pa.array(~letter | (top < max(reject, m.reject)))], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep).mapInArrow(apply, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
