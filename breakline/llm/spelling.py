"""Spelling variants by composing a vocabulary acceptor with a one-edit transducer and the acceptor again.

Words are counted in numpy inside tasks and summed by one shuffle of partial counts. Two words are near if
one inserted, deleted or replaced code point makes one of the other. A pair has a class m, the length of its
shorter word, and a place c, the length of the common prefix: the edit happens there. A partition of the
composition is named by (class, range of places [lo, hi), what stands before lo, what stands from hi on): it
is the initial state that both copies of the acceptor have reached before the transducer may edit. A word
enters the two halves of the places of its two classes, so words that never meet on their outer part never
meet in a task; a partition of more than CELLS cells is halved again, down to single places, whose sets are
bounded by the alphabet. So no limit on partners is needed and a hot prefix or suffix spreads.

Inside a task many partitions are worked on at once. Their middles form one acceptor, minimised from the
end: the states that accept the same strings of r code points are one class. The one-edit transducer gives
the start pairs: two children of a state under different code points (a replacement), or a state and a child
of the state that the longer words reach with the same prefix, whose common rest begins otherwise (an
insertion, counted at the first place where it can stand). Pairs of classes are then composed to the end,
those that accept nothing common are dropped, and the accepted pairs are listed by their ranks. Classes are
told apart by 64-bit sums, so each accepted pair is compared once more.

Each word's near words are summed up and its best one is kept where the pairs arise; forms are followed by
pointer doubling, whose rounds are few as every step at least doubles the count.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash; repeated
rows count as often as they occur; ties go to the smaller word in code-point order; a very long text is a
block of its own, a very long word a row like any other; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, saved, small_batches, table
from .textscan import blocks, mix, words

#: A run's code point is deleted where the crc32 of `<doc_id>:<run>` is a multiple of this.
EVERY = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Code points of the middles of a partition above which it is halved, and of a chunk of partitions.
CELLS, CHUNK = 1 << 16, 1 << 20
#: Distinct words a task holds before it hands on their counts.
HELD = 400_000
#: Words of more bytes are hashed one by one.
LONG = 64
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
PARTITION = ["m", "lo", "hi", "outer"]


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """Words of `textscan` for the runs of A-Z, a-z and U+00C0 to U+00FF."""
    high = data >= 0x80
    kept = ~high
    lead = data == 0xC3
    kept |= lead
    kept[1:] |= lead[:-1] & high[1:]
    return words(np.where(kept, data, np.uint8(32)), offsets, _LETTERS)


def _crc_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        code = np.where(code & 1, np.uint32(0xEDB88320) ^ (code >> 1), code >> 1).astype(np.uint32)
    return code


_CRC = _crc_table()


def crc_of_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:stop] that continues the crc32 `before`."""
    out = ~before.astype(np.uint32)
    order = np.argsort(start - stop, kind="stable")  # the longest first
    size = (stop - start)[order]
    short = order[np.searchsorted(-size, -LONG) :]
    state, at, left = out[short], start[short], (stop - start)[short]
    for i in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -i, side="left")  # words longer than i
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + i]) & 255] ^ (state[:n] >> np.uint32(8))
    out[short] = state
    out = ~out
    for i in order[: len(order) - len(short)]:
        out[i] = zlib.crc32(data[start[i] : stop[i]].tobytes(), int(before[i]))
    return out


def count_words(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of `docs(doc_id, text)`, after the deletions, that are long and frequent enough."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")

    def tell(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                w = letter_runs(data, offsets)
                size = w.stop - w.start
                leads = np.concatenate(([0], np.cumsum(w.data == 0xC3)))
                points = size - (leads[w.stop] - leads[w.start])
                seeds = np.array([zlib.crc32(f"{x}:".encode()) for x in batch["id"][lo:hi].to_pylist()], np.uint32)
                crc = crc_of_words(w.data, w.start, w.stop, seeds[w.text]).astype(np.int64)
                hit = crc % every == 0
                for i in np.flatnonzero(hit & (points > least_length)):
                    word = w.data[w.start[i] : w.stop[i]].tobytes().decode()
                    k = crc[i] % len(word)
                    made = (word[:k] + word[k + 1 :]).encode()
                    held[made] = held.get(made, 0) + 1
                plain = np.flatnonzero(~hit & (points >= least_length))
                _, at, n = np.unique(w.hash[plain], return_index=True, return_counts=True)
                at = plain[at]
                text = w.data.tobytes()
                for a, b, k in zip(w.start[at].tolist(), w.stop[at].tolist(), n.tolist(), strict=True):
                    word = text[a:b]
                    held[word] = held.get(word, 0) + k
                if len(held) > HELD:
                    yield tell(held)
                    held = {}
        yield tell(held)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def partitions(vocabulary: DataFrame, cells: int = CELLS) -> DataFrame:
    """m, lo, hi, outer, longer, word, n: each word in the partitions where its near words can be.

    `longer`: the word has m + 1 code points. Partitions of more than `cells` cells are halved until none is
    left that can be.
    """
    size = F.char_length("word")
    classed = vocabulary.select("word", "n", size.alias("_size"), F.explode(F.array(size - 1, size)).alias("m")).where("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    ranges = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("m").alias("hi"))))

    def named(rows: DataFrame) -> DataFrame:
        tail = F.col("m") - F.col("hi")
        outer = F.concat(F.substring(F.col("word"), F.lit(1), F.col("lo")), F.lit(" "), F.substring(F.col("word"), F.col("_size") - tail + 1, tail))
        return rows.where("lo < hi").select("m", "lo", "hi", outer.alias("outer"), (F.col("_size") > F.col("m")).alias("longer"), "word", "n", "_size")

    rows = saved(named(classed.select("word", "n", "_size", "m", ranges.alias("r")).select("word", "n", "_size", "m", "r.*")), "spelling-partitions")
    while True:
        heavy = (F.col("rows") * (F.col("hi") - F.col("lo")) > cells) & (F.col("hi") - F.col("lo") > 1)
        hot = saved(rows.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("rows")).where(heavy).drop("rows"), "spelling-hot")
        many = hot.count()
        if not many:
            return rows.drop("_size")
        hot = maybe_broadcast(hot, many)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))
        parts = named(rows.join(hot, PARTITION, "left_semi").select("word", "n", "_size", "m", halves.alias("r")).select("word", "n", "_size", "m", "r.*"))
        rows = saved(rows.join(hot, PARTITION, "left_anti").select(*parts.columns).union(parts), "spelling-partitions")


class Acceptor:
    """The minimised acceptor of the middles of some partitions: all of `width`, or of width + 1.

    Rows are sorted by partition and middle; `short` and `longer` are their code points, `part` numbers of
    partitions. Nodes are the distinct beginnings; those with r code points to come share classes if they accept
    the same. `arcs[r]` are (class, code point, class after it, rank before it), in order.
    """

    def __init__(self, short: np.ndarray, short_part: np.ndarray, longer: np.ndarray, longer_part: np.ndarray):
        self.sides = []
        for middles, part in ((short, short_part), (longer, longer_part)):
            n, width = middles.shape
            # Length of the common beginning with the row before; -1 where the partition changes.
            same = np.zeros(n, np.int64)
            if n > 1:
                same[1:] = np.where(part[1:] == part[:-1], np.cumprod(middles[1:] == middles[:-1], axis=1).sum(1), -1)
            same[:1] = -1
            heads = [np.flatnonzero(same < d) for d in range(width + 1)]  # first rows of the nodes at each depth
            self.sides.append((middles, part, heads, [None] * (width + 1)))
        self.width = short.shape[1]
        self.arcs: list[tuple[np.ndarray, ...]] = []
        self.sizes: list[np.ndarray] = []
        for r in range(self.width + 2):
            self._minimise(r)

    def _minimise(self, r: int) -> None:
        """Classes of all nodes with r code points to come."""
        arcs = []  # owner node, code point, class after, rows below
        first, count = 0, []
        for middles, _, heads, classes in self.sides:
            d = middles.shape[1] - r
            if d < 0:
                count.append(0)
                continue
            nodes = heads[d]
            count.append(len(nodes))
            if r:
                child = heads[d + 1]
                owner = np.searchsorted(nodes, child, side="right") - 1
                below = np.diff(np.append(child, len(middles)))
                arcs.append((first + owner, middles[child, d].astype(np.int64), classes[d + 1], below))
            first += len(nodes)
        if not r:
            # A middle stands once in a partition, so a node without code points to come is one row.
            made = np.zeros(first, np.int64)
            self.arcs.append(())
            self.sizes.append(np.ones(1, np.int64))
        else:
            owner, point, after, below = (np.concatenate(x) for x in zip(*arcs, strict=True))
            code = mix((point.astype(np.uint64) << np.uint64(32)) + after.astype(np.uint64) + np.uint64(1))
            total = np.zeros(first, np.uint64)
            np.add.at(total, owner, code)
            _, chosen, made = np.unique(total, return_index=True, return_inverse=True)
            # The arcs of one node stand for those of its class.
            place = np.full(first, -1)
            place[chosen] = np.arange(len(chosen))
            held = place[owner] >= 0
            cls, point, after, below = place[owner[held]], point[held], after[held], below[held]
            order = np.lexsort((point, cls))
            cls, point, after, below = cls[order], point[order], after[order], below[order]
            running = np.concatenate(([0], np.cumsum(below)))[:-1]
            begin = np.searchsorted(cls, cls)
            self.arcs.append((cls, point, after, running - running[begin]))
            self.sizes.append(np.bincount(cls, below, len(chosen)).astype(np.int64))
        at = 0
        for (middles, _, _, classes), n in zip(self.sides, count, strict=True):
            d = middles.shape[1] - r
            if d >= 0:
                classes[d] = made[at : at + n]
                at += n

    def composed(self, r: int, u: np.ndarray, v: np.ndarray):
        """For pairs of classes with r to come: (index of the pair, classes and ranks after each common code point)."""
        cls, point, after, rank = self.arcs[r]
        begin, end = np.searchsorted(cls, u), np.searchsorted(cls, u, side="right")
        pair, arc = spread(begin, end)
        span = np.int64(1) << 32
        key = cls * span + point
        want = v[pair] * span + point[arc]
        found = np.minimum(np.searchsorted(key, want), len(key) - 1)
        ok = key[found] == want
        pair, arc, found = pair[ok], arc[ok], found[ok]
        return pair, after[arc], after[found], rank[arc], rank[found]

    def replacements(self, d: int):
        """(first rows, classes) of the pairs of children of one node of the shorter words at depth d."""
        middles, _, heads, classes = self.sides[0]
        child = heads[d + 1]
        owner = np.searchsorted(heads[d], child, side="right") - 1
        i, j = spread(np.arange(len(child)) + 1, np.searchsorted(owner, owner, side="right"))
        return child[i], child[j], classes[d + 1][i], classes[d + 1][j], False

    def insertions(self, d: int, ends: np.ndarray):
        """Start pairs of an insertion at depth d, where the shorter word goes on otherwise.

        With code points to come these are taken one step on, so that the shorter word's next one differs from
        the inserted one; at the end (allowed in the partitions of `ends`) nothing is to come.
        """
        short, part, heads, classes = self.sides[0]
        longer, longer_part, longer_heads, longer_classes = self.sides[1]
        p, q = self._meet(d)
        child = longer_heads[d + 1]
        begin, end = (np.searchsorted(child, x) for x in (longer_heads[d][q], np.append(longer_heads[d], len(longer))[q + 1]))
        pair, y = spread(begin, end)  # y: nodes of longer words with the inserted code point
        if d == self.width:
            ok = ends[part[heads[d][p[pair]]]]
            pair, y = pair[ok], y[ok]
            zero = np.zeros(len(pair), np.int64)
            return heads[d][p[pair]], child[y], zero, zero, True
        step, longer_step = heads[d + 1], longer_heads[d + 2]
        begin, end = (np.searchsorted(step, x) for x in (heads[d][p[pair]], np.append(heads[d], len(short))[p[pair] + 1]))
        entry, x = spread(begin, end)
        y = y[entry]
        ok = short[step[x], d] != longer[child[y], d]
        x, y = x[ok], y[ok]
        # The child of y under x's code point, if there is one.
        parent = np.searchsorted(child, longer_step, side="right") - 1
        span = np.int64(1) << 32
        key = parent * span + longer[longer_step, d + 1]
        want = y * span + short[step[x], d]
        found = np.minimum(np.searchsorted(key, want), len(key) - 1) if len(key) else np.zeros(len(want), np.int64)
        ok = key[found] == want if len(key) else np.zeros(len(want), bool)
        x, found = x[ok], found[ok]
        return step[x], longer_step[found], classes[d + 1][x], longer_classes[d + 2][found], True

    def _meet(self, d: int):
        """Nodes of both sides at depth d with the same partition and beginning."""
        if d == 0:
            firsts = [part[heads[0]] for _, part, heads, _ in self.sides]
            _, p, q = np.intersect1d(*firsts, return_indices=True)
        else:
            p0, q0 = self.met
            sides, keys = [], []
            for k, before in ((0, p0), (1, q0)):
                middles, _, heads, _ = self.sides[k]
                joint = np.full(len(heads[d - 1]), -1)
                joint[before] = np.arange(len(before))
                parent = joint[np.searchsorted(heads[d - 1], heads[d], side="right") - 1]
                node = np.flatnonzero(parent >= 0)
                sides.append(node)
                keys.append(parent[node] * (np.int64(1) << 32) + middles[heads[d][node], d - 1])
            _, i, j = np.intersect1d(*keys, return_indices=True)
            p, q = sides[0][i], sides[1][j]
        self.met = (p, q)
        return p, q

    def pairs(self, ends: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Rows (shorter, shorter) one replacement apart and (shorter, longer) one insertion apart.

        `ends[part]`: an insertion may stand behind the last place of the middle.
        """
        starts: list[list] = [[] for _ in range(self.width + 1)]
        for d in range(self.width + 1):
            starts[max(self.width - d - 1, 0)].append(self.insertions(d, ends))
            if d < self.width:
                starts[self.width - d - 1].append(self.replacements(d))
        out = []
        for kind in (False, True):
            begun = [[np.concatenate([s[i] for s in of if s[4] is kind] or [np.zeros(0, np.int64)]) for i in range(4)] for of in starts]
            live = self._live([b[2:] for b in begun])
            u = v = cu = cv = np.zeros(0, np.int64)
            for r in range(self.width, -1, -1):
                if len(cu):
                    pair, cu, cv, du, dv = self.composed(r + 1, cu, cv)
                    u, v = u[pair] + du, v[pair] + dv
                u, v, cu, cv = (np.concatenate(x) for x in zip((u, v, cu, cv), begun[r], strict=True))
                ok = np.isin(cu * len(self.sizes[r]) + cv, live[r])
                u, v, cu, cv = u[ok], v[ok], cu[ok], cv[ok]
            out.append((u, v))
        return out[0], out[1]

    def _live(self, starts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """For each r the pairs of classes, as one number, that some start leads to and that accept something common."""
        seen: list[np.ndarray] = []
        steps = []
        now = np.zeros(0, np.int64)
        for r in range(self.width, -1, -1):
            k = len(self.sizes[r])
            now = np.unique(np.concatenate((now, starts[r][0] * k + starts[r][1])))
            seen.append(now)
            if r:
                pair, cu, cv, _, _ = self.composed(r, now // k, now % k)
                steps.append((pair, cu * len(self.sizes[r - 1]) + cv))
                now = steps[-1][1]
        seen.reverse()
        steps.reverse()
        for r in range(1, self.width + 1):
            pair, after = steps[r - 1]
            seen[r] = seen[r][np.unique(pair[np.isin(after, seen[r - 1])])]
        return seen


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for every i and every x from begin[i] up to end[i]."""
    n = np.maximum(end - begin, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]


def code_points(texts: list[str], width: int) -> np.ndarray:
    data = "".join(texts).encode("utf-32-le")
    return (np.frombuffer(data, np.uint32) if data else np.zeros(0, np.uint32)).reshape(len(texts), width)


def near_in_chunk(rows: list[tuple], width: int) -> pa.RecordBatch:
    """Near words of a chunk of partitions of one width, each sorted: word, near, best_n, best."""
    number, ends, part = -1, [], []
    last = None
    for m, _, hi, outer, *_ in rows:
        if (m, hi, outer) != last:
            last, number = (m, hi, outer), number + 1
            ends.append(hi == m)
        part.append(number)
    part_, longer = np.array(part), np.array([r[4] for r in rows])
    side = [np.flatnonzero(~longer), np.flatnonzero(longer)]
    middles = [code_points([rows[i][5][rows[i][1] : rows[i][1] + width + k] for i in at], width + k) for k, at in enumerate(side)]
    found = Acceptor(middles[0], part_[side[0]], middles[1], part_[side[1]]).pairs(np.array(ends))
    (a, b), (c, d) = found
    x, y = middles
    ok = (x[a] != x[b]).sum(1) == 1
    a, b = a[ok], b[ok]
    agree = np.cumprod(x[c] == y[d][:, :width], axis=1).sum(1) + np.cumprod((x[c] == y[d][:, 1:])[:, ::-1], axis=1).sum(1)
    c, d = c[agree >= width], d[agree >= width]
    one = np.concatenate((side[0][a], side[0][c]))
    two = np.concatenate((side[0][b], side[1][d]))
    own, other = np.concatenate((one, two)), np.concatenate((two, one))
    if not len(own):
        return pa.RecordBatch.from_pylist([], NEAR)
    texts, n = [r[5] for r in rows], np.array([r[6] for r in rows])
    rank = np.empty(len(rows), np.int64)
    rank[sorted(range(len(rows)), key=texts.__getitem__)] = np.arange(len(rows))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    best = other[heads]
    columns = [pa.array([texts[i] for i in own[heads]]), pa.array(np.diff(np.append(heads, len(own)))), pa.array(n[best]), pa.array([texts[i] for i in best])]
    return pa.RecordBatch.from_arrays(columns, schema=NEAR)


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(width, rows) of whole partitions of one width, in order; partitions without two words are left out."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held: list[tuple] = []
    width = 0
    for key, of in groupby(rows(), key=lambda r: r[:4]):
        part = list(of)
        if len(part) < 2 or part[0][4]:  # only longer words
            continue
        if held and (key[2] - key[1] != width or len(held) * width > CHUNK):
            yield width, held
            held = []
        width = key[2] - key[1]
        held += part
    if held:
        yield width, held


def near_words(vocabulary: DataFrame, cells: int = CELLS) -> DataFrame:
    """`vocabulary(word, n)`, each word once, to word, n_near, best_n, best for the words that have near ones.

    `best` is the near word of the largest n, of these the smallest in code-point order.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, rows in chunks(batches):
            yield near_in_chunk(rows, width)

    parts = partitions(vocabulary, cells).repartition(*PARTITION)
    ordered = parts.sortWithinPartitions(F.col("hi") - F.col("lo"), *PARTITION, "longer", "word")
    found = ordered.select(*PARTITION, "longer", "word", "n").mapInArrow(find, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("best")))
    summed = found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """`links(word, form)`, without cycles, to word, root: where the forms end."""
    now = saved(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = saved(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, cells: int = CELLS) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of `docs(doc_id, text)` that are long and frequent enough."""
    vocabulary = saved(count_words(docs, every, least_length, least_count), "vocabulary")
    near = near_words(vocabulary, cells)
    usual = F.col("best_n") >= ratio * F.col("n")
    made = saved(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best")).alias("form"), F.when(usual, F.col("best_n")).alias("form_n")), "forms")
    return made.join(roots(made.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
