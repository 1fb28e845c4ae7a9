"""Token ids in a content-addressed store.

Encoding: a text is cut where the tokenizer never joins (at white space, and between ASCII letters and
signs); distinct lower-cased words are encoded by the tokenizers library once and kept by their 64-bit
hash in a bounded cache, and a document's ids are gathered from it.
Chunks: a rolling hash over WINDOW ids cuts a document where its low bits are zero, so equal passages
give equal chunks wherever they stand. A chunk is named by the BLAKE2b digest of its ids.

Files: `packs/` holds frames of compressed chunks, each distinct chunk once; `index/` (Parquet) tells
where; `recipes/` (Parquet, ascending doc_id) lists the chunks of each document with its Merkle root;
`manifest/` (Parquet) has a row per recipe partition: first id position, sums, the root of the tree over
its documents in order, and the root over all partitions. A task writes packs of its own; only those named in the committed index count, so lost or
repeated tasks leave nothing that is read.

One shuffle brings the copies of a chunk together: every block sends a distinct chunk once, so a chunk
that a third of all documents share arrives once per block. Reading checks every chunk against its
name and every document against its roots and its length; a chunk that is not there is an error.

Edge cases: a null text is empty; an empty text is the end id alone; documents of equal doc_id are
all stored, in order of their content; a null doc_id comes first; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, small_batches, table
from .textscan import _BASE, _INVERSE, SPACE, Words, blocks, mix, powers, word_bytes, words
from .warc import filesystem

END_ID = 2
#: Ids in the rolling window; smallest, usual and largest chunk.
WINDOW, SMALL, MASK, LARGE = 16, 64, (1 << 9) - 1, 4096
#: Words that a worker's cache holds, words of a call, bytes of a frame.
CACHE_WORDS, RUN, FRAME = 600_000, 200, 1 << 18
#: Recipes under one digest of a partition's tree.
BLOCK = 4096
#: Stands between words that are encoded in one call.
SIGN = "\x01"
#: A word also ends between an ASCII letter and an ASCII sign, as the tokenizer cuts there; it does not at
#: an apostrophe, which can belong to the letters behind it.
_SPACED = word_bytes(SPACE)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_KINDS[[c for c in range(65, 123) if chr(c).isalpha()]] = 1


class Encoder:
    """Word-wise encoding; one for each worker and vocabulary file."""

    made: dict[str, Encoder] = {}  # one for each vocabulary file

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        got = self.tokenizer.encode(SIGN, add_special_tokens=False).ids
        self.sign = got[0] if len(got) == 1 else -1
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.start, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def ids_of(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, size of each): many words in one call, a control sign between them.

        The sign is a word of one id. A word that holds it goes alone.
        """
        apart = [i for i, w in enumerate(fresh) if SIGN in w]
        lone = {i: self.tokenizer.encode(fresh[i], add_special_tokens=False).ids for i in apart}
        plain = fresh if not apart else [w if i not in lone else "" for i, w in enumerate(fresh)]
        runs = [f" {SIGN} ".join(plain[i : i + RUN]) + f" {SIGN}" for i in range(0, len(plain), RUN)]
        flat = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        size = np.diff(np.flatnonzero(flat == self.sign), prepend=-1) - 1
        if len(size) != len(fresh):
            raise ValueError("the sign between words is not a word of one id in this vocabulary")
        flat = flat[flat != self.sign]
        if lone:
            parts = np.split(flat, np.cumsum(size)[:-1])
            for i, ids in lone.items():
                parts[i], size[i] = np.array(ids, np.uint32), len(ids)
            flat = np.concatenate(parts)
        return flat, size

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at these slots, size of each)."""
        size = self.start[slot + 1] - self.start[slot]
        done = np.cumsum(size) - size
        return self.ids[np.repeat(self.start[slot] - done, size) + np.arange(int(size.sum()))], size

    def add(self, names: list[int], flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate((self.start, self.used + np.cumsum(size)))
        self.place.update(zip(names, range(len(self.start) - 1 - len(names), len(self.start) - 1), strict=True))
        self.used += len(flat)

    def slots(self, w: Words) -> np.ndarray:
        """The slot of each word; fresh ones are encoded first."""
        distinct, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        found = [self.place.get(x, -1) for x in distinct.tolist()]
        slot = np.array(found, np.int64)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            names = [bytes(w.data[a:b]).decode("utf-8", "replace") for a, b in zip(w.start[at[fresh]].tolist(), w.stop[at[fresh]].tolist(), strict=True)]
            slot[fresh] = np.arange(len(self.start) - 1, len(self.start) - 1 + len(names))
            self.add(distinct[fresh].tolist(), *self.ids_of(names))
        return slot[back]

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each)."""
        if len(self.place) > CACHE_WORDS:
            self.forget()
        w = words(data, offsets, _SPACED, _KINDS)
        ids, size = self.gather(self.slots(w))
        done = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(done[w.first])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; where each text ends).

        A text with the signs that open a special token goes to the tokenizer as it is.
        """
        special = np.unique(np.searchsorted(offsets, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)), "right") - 1)
        flat, many, row = [], [], 0
        for d in [*special.tolist(), len(offsets) - 1]:
            if row < d:
                ids, size = self.plain(data[offsets[row] : offsets[d]], offsets[row : d + 1] - offsets[row])
                flat.append(ids)
                many.append(size)
            if d < len(offsets) - 1:
                text = bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace")
                flat.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                many.append(np.array([len(flat[-1])]))
            row = d + 1
        size = np.concatenate(many)
        lasts = np.cumsum(size + 1)
        out = np.full(int(size.sum()) + len(size), end, np.uint32)
        free = np.ones(len(out), bool)
        free[lasts - 1] = False
        out[free] = np.concatenate(flat)
        return out, lasts


def cuts(ids: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of each chunk, number of chunks of each document) by content-defined cuts."""
    n = len(ids)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    stop = np.arange(WINDOW, n + 1)
    code = mix((total[stop] - total[stop - WINDOW]) * powers(_INVERSE, n + 1)[stop - WINDOW])
    marks = stop[(code & np.uint64(MASK)) == 0]
    ends, many, first = [], [], 0
    bound = np.searchsorted(marks, np.concatenate(([0], lasts)))
    for d, last in enumerate(lasts.tolist()):
        before, at = len(ends), first
        for c in [*marks[bound[d] : bound[d + 1]].tolist(), last]:
            while c - at > LARGE:
                at += LARGE
                ends.append(at)
            if c - at >= SMALL or (c == last and c > at):
                at = c
                ends.append(c)
        many.append(len(ends) - before)
        first = last
    return np.array(ends, np.int64), np.array(many, np.int64)


def name_of(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in names]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b""


def packed(ids: np.ndarray) -> bytes:
    """Little-endian ids, two bytes each where they fit (marked by the first byte), else four."""
    small = not len(ids) or ids.max() < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


PIECES = "key long, doc_id long, n_tokens long, names array<binary>, sizes array<int>, name binary, payload binary"


def pieces(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Two kinds of rows: a recipe for each document, and each distinct chunk of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)  # what it knows, up to its bound, also serves the worker's next tasks
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                yield block(encoder, batch["doc_id"][lo:hi].to_pylist(), data, offsets)

    def block(encoder: Encoder, doc_ids: list, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, lasts = encoder.encode(data, offsets, end)
        ends, many = cuts(ids, lasts)
        size = np.diff(ends, prepend=0)
        payloads = [packed(ids[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
        names = [name_of(x) for x in payloads]
        distinct = dict(zip(names, payloads, strict=True))
        n, m = len(doc_ids), len(distinct)
        key = [int.from_bytes(x[:8], "little", signed=True) for x in distinct]
        lists = pa.array(np.concatenate(([0], np.cumsum(many), np.full(m, len(names)))), pa.int32())
        kind = np.arange(n + m) >= n
        made = lambda values, kind_: pa.ListArray.from_arrays(lists, pa.array(values, kind_), mask=pa.array(kind))
        first = np.concatenate(([0], lasts[:-1]))
        spread = [int.from_bytes(names[i][:8], "little", signed=True) ^ (d or 0) for i, d in zip(np.cumsum(many) - many, doc_ids, strict=True)]
        columns = [
            pa.array([*spread, *key], pa.int64()),
            pa.array([*doc_ids, *[None] * m], pa.int64()),
            pa.array([*(lasts - first).tolist(), *[None] * m], pa.int64()),
            made(names, pa.binary()),
            made(size, pa.int32()),
            pa.array([*[None] * n, *distinct], pa.binary()),
            pa.array([*[None] * n, *distinct.values()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_tokens", "names", "sizes", "name", "payload"])

    return docs.mapInArrow(run, PIECES)


STORED = "doc_id long, n_tokens long, names array<binary>, sizes array<int>, root binary, name binary, pack string, frame long, length long, at long, size long"


def write_packs(rows: DataFrame, where: str) -> DataFrame:
    """Write each chunk once; return recipes as they are and an index row for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(where)
        store.create_dir(at, recursive=True)
        out, pack, offset, last = None, f"{uuid.uuid4().hex}.pack", 0, None
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, offset, held, size
            out = out or store.open_output_stream(f"{at}/{pack}", compression=None)
            frame = zlib.compress(b"".join(x for _, x in held), 1)
            out.write(frame)
            ends = np.cumsum([len(x) for _, x in held])
            n = len(held)
            none = lambda kind: pa.nulls(n, kind)
            made = [none(pa.int64()), none(pa.int64()), none(pa.list_(pa.binary())), none(pa.list_(pa.int32())), none(pa.binary()), pa.array([x for x, _ in held], pa.binary()), pa.array([pack] * n), pa.array([offset] * n), pa.array([len(frame)] * n), pa.array(ends - [len(x) for _, x in held], pa.int64()), pa.array([len(x) for _, x in held], pa.int64())]
            offset, held, size = offset + len(frame), [], 0
            return pa.RecordBatch.from_arrays(made, NAMES)

        NAMES = [x.split()[0] for x in STORED.split(", ")]
        for batch in batches:
            recipes = batch.filter(pa.compute.is_null(batch["name"]))
            if n := recipes.num_rows:
                roots = pa.array([merkle(x) for x in recipes["names"].to_pylist()], pa.binary())
                rest = [pa.nulls(n, k) for k in (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([recipes["doc_id"], recipes["n_tokens"], recipes["names"], recipes["sizes"], roots, *rest], NAMES)
            chunks = batch.filter(pa.compute.is_valid(batch["name"]))
            for name, payload in zip(chunks["name"].to_pylist(), chunks["payload"].to_pylist(), strict=True):
                if name != last:
                    last = name
                    held.append((name, payload))
                    size += len(payload)
                    if size >= FRAME:
                        yield flush()
        if held:
            yield flush()
        if out:
            out.close()

    return rows.repartition("key").sortWithinPartitions("name").mapInArrow(run, STORED)


def write_store(docs: DataFrame, where: str, tokenizer: str, end: int = END_ID) -> dict[str, DataFrame]:
    """Write `docs(doc_id, text)` below `where`: the index, recipes and manifest as tables."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = saved(write_packs(pieces(texts, tokenizer, end), f"{where}/packs"), "token-rows")
    stored.where("name is not null").select("name", "pack", "frame", "length", "at", "size").write.parquet(f"{where}/index")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, rank = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch["n_tokens"].to_numpy()
            start = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(rank + np.arange(len(n)), pa.int64()), pa.array(start, pa.int64()), *batch.columns], ["part", "rank", "start", *batch.schema.names])
            rank += len(n)

    recipes = stored.where("name is null").select("doc_id", "n_tokens", "names", "sizes", "root")
    parts = max(1, stored.rdd.getNumPartitions())
    ordered = recipes.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "root").sortWithinPartitions(F.asc_nulls_first("doc_id"), "root")
    ordered.mapInArrow(place, "part int, rank long, start long, doc_id long, n_tokens long, names array<binary>, sizes array<int>, root binary").write.parquet(f"{where}/recipes")
    # One row per partition: the driver adds up their sums and hashes their roots.
    sums = sorted(map(tuple, tree(spark.read.parquet(f"{where}/recipes")).collect()))
    whole, rows, base = root_of(sums), [], 0
    for part, docs_, n, root in sums:
        rows.append((part, base, docs_, n, root, whole))
        base += n
    spark.createDataFrame(rows, "part int, base long, docs long, n_tokens long, root string, whole string").coalesce(1).write.parquet(f"{where}/manifest")
    return open_store(spark, where)


def tree(recipes: DataFrame) -> DataFrame:
    """part, docs, n_tokens, root: SHA-256 over the digests of blocks of BLOCK recipes, each over its recipes' roots, in order."""
    joined = lambda xs, of: F.sha2(F.array_join(F.transform(F.sort_array(xs), of), ""), 256)
    block = F.floor(F.col("rank") / BLOCK).alias("block")
    leaf = F.struct("rank", F.concat_ws(":", F.col("start"), F.col("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("root")).alias("d"))
    blocks_ = recipes.groupBy("part", block).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("n"), joined(F.collect_list(leaf), lambda x: x["d"]).alias("d"))
    return blocks_.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_tokens"), joined(F.collect_list(F.struct("block", "d")), lambda x: x["d"]).alias("root"))


def root_of(sums: list[tuple]) -> str:
    """The root over the partitions' rows of `tree`."""
    return hashlib.sha256("".join(f"{p}:{d}:{n}:{r}" for p, d, n, r in sums).encode()).hexdigest()


def open_store(spark: SparkSession, where: str) -> dict[str, DataFrame]:
    return {x: spark.read.parquet(f"{where}/{x}") for x in ("index", "recipes", "manifest")}


def read_chunks(store: dict[str, DataFrame], where: str, schema: str, give) -> DataFrame:
    """`give(name, payload)` of every chunk of the index, checked against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = filesystem(f"{where}/packs")
        source, frame, opened, data = None, None, None, b""
        kinds = pa.schema([(x.split()[0], {"binary": pa.binary(), "long": pa.int64()}[x.split()[1]]) for x in schema.split(", ")])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["pack"] != opened:
                    source = files.open_input_file(f"{at}/{r['pack']}")
                    opened, frame = r["pack"], None
                if r["frame"] != frame:
                    source.seek(r["frame"])
                    frame, data = r["frame"], zlib.decompress(source.read(r["length"]))
                payload = data[r["at"] : r["at"] + r["size"]]
                if name_of(payload) != r["name"]:
                    raise ValueError(f"a chunk of {r['pack']} differs from its name")
                rows.append(give(r["name"], payload))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    index = store["index"]
    spread = index.withColumn("slice", F.floor(F.col("frame") / (16 << 20)))
    return spread.repartition("pack", "slice").sortWithinPartitions("pack", "frame", "at").drop("slice").mapInArrow(run, schema)


def checked_recipes(store: dict[str, DataFrame]) -> DataFrame:
    """doc_id, start, n_tokens, names, sizes; fails where a root of a document or partition differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, root in zip(batch["names"].to_pylist(), batch["root"].to_pylist(), strict=True):
                if merkle(names) != root:
                    raise ValueError("a recipe differs from its Merkle root")
            yield batch

    recipes = store["recipes"]
    held = recipes.mapInArrow(run, recipes.schema).join(F.broadcast(store["manifest"].select("part", "base")), "part")  # a row per partition
    return held.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "names", "sizes")


def check_manifest(store: dict[str, DataFrame]) -> None:
    got = sorted(map(tuple, tree(store["recipes"]).collect()))
    told = sorted(map(tuple, store["manifest"].select("part", "docs", "n_tokens", "root", "whole").collect()))
    if got != [t[:4] for t in told] or any(t[4] != root_of(got) for t in told):
        raise ValueError("the recipes differ from the manifest")


def occurrences(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document: doc_id, start, seq, after (ids behind it), name."""
    pair = F.posexplode(F.arrays_zip("names", "sizes")).alias("seq", "c")
    rows = recipes.select("doc_id", "start", "n_tokens", "sizes", pair)
    upto = F.aggregate(F.slice("sizes", 1, F.col("seq") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "start", "n_tokens", "seq", F.col("c.names").alias("name"), (F.col("n_tokens") - upto).alias("after"))


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, ids (array<bigint>): the documents, put together again."""
    store = open_store(spark, where)
    check_manifest(store)
    chunks = read_chunks(store, where, "name binary, payload binary", lambda name, payload: (name, payload))
    joined = occurrences(checked_recipes(store)).join(chunks, "name", "left")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row, n in zip(batch["parts"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if any(x["payload"] is None for x in row):
                    raise ValueError("a chunk is missing in the index")
                made.append(np.concatenate([unpacked(x["payload"]) for x in row]).tolist())
                if len(made[-1]) != n:
                    raise ValueError("a document differs from its recipe in length")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(made, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    whole = joined.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))
    return whole.mapInArrow(ids, "doc_id long, start long, ids array<bigint>")


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a stretch of CRC-32 `crc` adds (by xor) to the whole's, `after` bytes before its end."""
    out, bits = crc.astype(np.uint32), after.astype(np.int64) * 8
    power = np.full(1, 1 << 30, np.uint32)  # x^1
    for k in range(int(bits.max()).bit_length() if len(bits) else 0):
        odd = (bits >> k) & 1 == 1
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, int(odd.sum())))
        power = _times(power, power)
    return out


def digests(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files: chunks are summed up where they are read.

    The CRC-32 of a document is the xor of its chunks' CRC-32s moved to their places, so no ids are
    shuffled.
    """
    store = open_store(spark, where)
    check_manifest(store)

    def give(name: bytes, payload: bytes) -> tuple:
        ids = unpacked(payload)
        return name, zlib.crc32(ids.tobytes()), len(ids)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch["crc"].null_count:
                raise ValueError("a chunk is missing in the index")
            moved = crc_before(batch["crc"].to_numpy(), batch["after"].to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "n_tokens", "n")), pa.array(moved.astype(np.int64))], ["doc_id", "start", "n_tokens", "n", "crc"])

    chunks = read_chunks(store, where, "name binary, crc long, n long", give)
    joined = occurrences(checked_recipes(store)).join(chunks, "name", "left").select("doc_id", "start", "n_tokens", "n", "crc", "after")
    moved = joined.mapInArrow(move, "doc_id long, start long, n_tokens long, n long, crc long")
    summed = moved.groupBy("doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"))
    wrong = F.raise_error(F.lit("a document differs from its recipe in length"))
    return summed.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(wrong.cast("long")).alias("n_tokens"), "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), where, vocabulary())
    return digests(spark, where).select("doc_id", "start", "n_tokens", "ids_crc32")
