"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Items and texts are sequences of lower-cased words. An item leaks into a text if some stretch of the
text is within EDITS times the item's words of it in word edit distance. Items fall into size classes
of m words and more, up to LONGEST. Texts give windows of m - h + 1 words at every h-th word, h = m // 4, and
items all their windows of that length, so an unchanged passage always holds a text window that an item
has. Items of the last class are longer than their windows and give many of them: one is enough, as the
whole item is verified, whereas the walks over a whole long item lose each other (0.64 found of items of
120 words and more with 20 % edits, all with windows of the class of 19).

A window is embedded by the CGK random walk: at step j it emits the word it stands on and moves on if
bit j of the word's random hash is set, so that after an edit two walks come together again and edit
distance becomes Hamming distance. A key joins COORDINATES sampled positions of the embedding; WALKS
walks with KEYS keys each reach the recall that the tests measure. Windows that share a key with an
item window are aligned and verified by the edit distance of the whole item. The walk runs for all
windows of a block at once.

The benchmark is sent to the tasks in blocks of at most ITEM_BLOCK characters, one pass for each.

Edge cases: a null or wordless text has no leaks; a null or wordless item leaks nowhere; items of
equal text are all reported; repeated rows have equal leaks; an item of one or two words must match
exactly; a row with a null item_id reports null.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .textscan import blocks, mix, word_bytes, words

#: Share of an item's words that may differ.
EDITS = 0.2
#: Longest window class, in words: two walks of a longer window with an edit share of EDITS drift apart for good.
LONGEST = 19
WALKS, KEYS, COORDINATES, SEED = 4, 4, 4, 17
ITEM_BLOCK = 8 << 20
_TABLE = word_bytes()
LEAKS = "array<struct<item_id:bigint,distance:bigint,first_word:bigint,item_words:bigint>>"


def size_class(n: int) -> int:
    """The largest m of 1, 2, 3, 4, 6, 9, 13, ... up to LONGEST that is at most n."""
    m = 1
    while (up := m + max(1, m // 2)) <= min(n, LONGEST):
        m = up
    return m


def shape(m: int) -> tuple[int, int]:
    """(stride h, window length) of a class."""
    h = max(1, m // 4)
    return h, m - h + 1


def samples(m: int) -> list[list[np.ndarray]]:
    """For each walk its keys, for each key its sampled steps, spread over the window."""
    rng = np.random.default_rng(SEED + m)
    length = shape(m)[1]
    steps = max(1, 2 * length - 2)
    count = min(COORDINATES, length)
    edge = np.linspace(0, steps, count + 1)
    return [[np.unique((edge[:-1] + rng.random(count) * np.diff(edge)).astype(int)) for _ in range(KEYS)] for _ in range(WALKS)]


def embed(code: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """Keys (one row per walk and key) of the windows at `start`; `code` are the words' hashes."""
    length = shape(m)[1]
    padded = np.concatenate((code, np.zeros(2 * length + 2, np.uint64)))
    stop = start + length
    out = []
    for r, keys in enumerate(samples(m)):
        last = max(int(k.max()) for k in keys)
        at = start.copy()
        made = [np.full(len(start), i + 1, np.uint64) for i in range(len(keys))]
        bits = None
        for j in range(last + 1):
            if j % 63 == 0:
                bits = (mix(padded + np.uint64((r << 20) + j + 1)) >> np.uint64(1)).view(np.int64)
            if any(j in k for k in keys):
                seen = np.where(at < stop, padded[at], np.uint64(3))
                for i, k in enumerate(keys):
                    if j in k:
                        made[i] = mix(made[i] * np.uint64(7) + seen + np.uint64(j))
            at += (bits[at] >> (j % 63)) & 1
        out += [x + np.uint64(97 * (r * KEYS + i)) for i, x in enumerate(made)]
    return np.stack(out)


def window_starts(first: np.ndarray, m: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of the full windows of all texts."""
    many = np.maximum(0, (np.diff(first) - shape(m)[1]) // stride + 1)
    text = np.repeat(np.arange(len(many)), many)
    return first[text] + stride * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)), text


def distance(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to a part of the stretch, end of that part)."""
    cols = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (stretch != word), row[1:] + 1)
        row = np.minimum.accumulate(new - cols) + cols
    return int(row.min()), int(row.argmin())


def runs(wanted: list[tuple[int, int, int]], reach: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first place, last place): places of a pair within `reach` of the first are verified at once."""
    i = 0
    while i < len(wanted):
        d, k, p = wanted[i]
        last = p
        while i < len(wanted) and wanted[i][:2] == (d, k) and wanted[i][2] <= p + reach[k]:
            last = wanted[i][2]
            i += 1
        yield d, k, p, last


class Index:
    """The windows of a block of items, by class and key."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        text = pa.array(texts, pa.large_string())
        self.items: list[tuple[int | None, np.ndarray]] = []
        parts = []
        for lo, hi, data, offsets in blocks(text):
            w = words(data, offsets, _TABLE)
            parts += [(ids[lo + d], w.hash[w.first[d] : w.first[d + 1]]) for d in range(hi - lo)]
        self.items = [(i, x) for i, x in parts if len(x)]
        grouped = defaultdict(list)
        for k, (_, x) in enumerate(self.items):
            grouped[size_class(len(x))].append(k)
        self.classes = {}
        for m, members in grouped.items():
            codes = [self.items[k][1] for k in members]
            first = np.concatenate(([0], np.cumsum([len(x) for x in codes])))
            start, text_ = window_starts(first, m, 1)
            keys = embed(np.concatenate(codes), start, m)
            item, offset = np.tile(np.array(members)[text_], len(keys)), np.tile(start - first[text_], len(keys))
            flat = keys.reshape(-1)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            here = np.zeros(1 << 20, bool)
            here[flat >> np.uint64(44)] = True
            self.classes[m] = flat, item[order], offset[order], here

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """Leaks of each text, by item order: the best place of each item."""
        w = words(data, offsets, _TABLE)
        n = len(offsets) - 1
        wanted: set[tuple[int, int, int]] = set()
        for m, (flat, item, offset, here) in self.classes.items():
            start, text = window_starts(w.first, m, shape(m)[0])
            if not len(start):
                continue
            keys = embed(w.hash, start, m)
            row, col = np.nonzero(here[keys >> np.uint64(44)])
            key = keys[row, col]
            lo, hi = np.searchsorted(flat, key), np.searchsorted(flat, key, "right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            col = np.repeat(col, size)
            place = start[col] - w.first[text[col]] - offset[at]
            wanted.update(zip(text[col].tolist(), item[at].tolist(), place.tolist(), strict=True))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, k, p, last in runs(sorted(wanted), [int(EDITS * len(x)) + 2 for _, x in self.items]):
            got = best.get((d, k))
            if got and got[0] == 0:
                continue
            item, doc = self.items[k][1], w.hash[w.first[d] : w.first[d + 1]]
            limit = int(EDITS * len(item))
            lo = max(0, p - limit - 2)
            score, end = distance(item, doc[lo : max(0, last + len(item) + limit + 2)])
            if score <= limit and (got is None or score < got[0]):
                best[d, k] = score, max(lo, lo + end - len(item))
        out: list[list[dict]] = [[] for _ in range(n)]
        for (d, k), (score, p) in sorted(best.items()):
            out[d].append({"item_id": self.items[k][0], "distance": score, "first_word": p, "item_words": len(self.items[k][1])})
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, by hash of the text."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // ITEM_BLOCK)
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in got], [r["text"] for r in got])


def with_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with a column `leaks` (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*keep).withColumn("leaks", F.array().cast(LEAKS))
    for index in item_blocks(benchmark):
        out = _add(out, index)
    return out


def _add(docs: DataFrame, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("leaks")
            for lo, hi, data, offsets in blocks(batch["text"]):
                rows = batch.slice(lo, hi - lo)
                found = [a + b for a, b in zip(rows["leaks"].to_pylist(), sent.value.find(data, offsets), strict=True)]
                columns = [pa.array(found, batch.schema.field("leaks").type) if i == at else c for i, c in enumerate(rows.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that leaks into it."""
    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
