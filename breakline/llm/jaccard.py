"""Exact Jaccard join of shingle sets by PartEnum signatures, and its components.

Sets: the distinct hashed word n-grams of a text. Sets of equal fingerprint form a class and only the
smallest doc_id of a class goes on. Sizes fall into bands [l, u] with u = floor(100 l / threshold), so
similar sets lie in the same or in neighbouring bands. For each pair of neighbouring bands the hash
domain is partitioned twice. k being the most elements in which two similar sets of these bands can
differ, floor(k / (OFF + 1)) + 1 + x first-level partitions leave x + 1 at least in which such a pair differs in
OFF elements or fewer. Each is cut into SECOND parts, of which then SECOND - OFF are equal; all subsets of so many
parts are enumerated, and the hash of a subset's elements is a signature, so the pair shares one. A
subset without elements gives none; a set with so many of them that all those x + 1 partitions could be
without adds its prefix elements (the smallest size - ceil(size * threshold) + 1 hashes), of
which similar sets share one. No pair is lost.

Buckets: a block of documents sends one head per signature and names its local members directly, so a
signature that a third of all documents hold is combined before the shuffle. Links are then found in
steps. First every member is compared with the smallest and the largest head of its buckets.
Components of these links label the documents; in buckets that still hold several labels, first one
member of each label is compared, then all pairs of different labels, in blocks. Each comparison first passes a lossless filter: the odd
sketch (one flipped bit per element), whose differing bits are at most the differing elements. What is
left is verified on the sets themselves.

Edge cases: a null or wordless text has an empty set and links with nothing; a text of fewer words
than n is one shingle; repeated rows are copies; a doc_id with several texts links with whatever one of
them links with; a row with a null doc_id links with nothing and has a null component; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, saved, small_batches, table
from .components import components, joined
from .textscan import SPACE, blocks, mix, word_bytes, words

#: Bits of a set element; the rest of the word holds the text's place in its block.
ELEMENT = 53
#: Signatures that a block gathers before they are combined; rows of a block of a large bucket.
GATHER, BUCKET_BLOCK = 600_000, 1024
#: Parts of a first-level partition, and how many of them an enumerated subset leaves out.
SECOND, OFF = 3, 1
#: A document's best candidates (by sketch) among the heads of its buckets.
STARS = 3
_SPACED = word_bytes(SPACE)


def elements(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, text) of the distinct shingles of each text, ordered by text and element."""
    w = words(data, offsets, _SPACED)
    many = w.counts
    code, size = np.zeros(len(w.hash), np.uint64), len(w.hash)
    for j in range(n):
        code[: max(0, size - j)] = mix(code[: max(0, size - j)] * np.uint64(3) + w.hash[j:] + np.uint64(j + 1))
    # A shingle starts where n words of the text are left.
    left = np.repeat(w.first[1:], many) - np.arange(size)
    full = left >= n
    text = w.text[full].astype(np.uint64)
    code = code[full]
    short = np.flatnonzero((many > 0) & (many < n))
    if len(short):
        whole = np.array([_short(w.hash[w.first[d] : w.first[d + 1]]) for d in short], np.uint64)
        code, text = np.concatenate((code, whole)), np.concatenate((text, short.astype(np.uint64)))
    key = np.sort((text << np.uint64(ELEMENT)) | (code >> np.uint64(64 - ELEMENT)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & np.uint64((1 << ELEMENT) - 1), (key >> np.uint64(ELEMENT)).astype(np.int64)


def _short(hashes: np.ndarray) -> np.uint64:
    code = np.array([len(hashes) + 77], np.uint64)
    for h in hashes:
        code = mix(code * np.uint64(5) + h)
    return code[0]


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the odd sketch: the power of two of at least 2 bits per element."""
    bits = np.maximum(256, 2 * size)
    return (1 << np.ceil(np.log2(bits)).astype(np.int64)) // 64


SETS = "doc_id long, n long, f1 long, f2 long, sketch array<bigint>"


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, fingerprint and odd sketch of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                x, text = elements(data, offsets, n)
                size = np.bincount(text, minlength=hi - lo)
                sums = []
                for seed in (1, 2):
                    part = np.zeros(hi - lo, np.uint64)
                    np.add.at(part, text, mix(x + np.uint64(seed << 54)))
                    sums.append(part.view(np.int64))
                wide = np.where(size > 0, sketch_words(size), 0)
                base = np.cumsum(wide) - wide
                flat = np.zeros(int(wide.sum()), np.uint64)
                h = mix(x + np.uint64(3 << 54)).astype(np.uint64)
                bit = h & (wide[text] * 64 - 1).astype(np.uint64)
                # Low bits choose the place, so a sketch folds to half its length by xor.
                np.bitwise_xor.at(flat, base[text] + (bit % wide[text].astype(np.uint64)).astype(np.int64), np.uint64(1) << ((h >> np.uint64(40)) & np.uint64(63)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(wide))), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], pa.array(size, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n", "f1", "f2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


@cache
def bands(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(largest size, first-level partitions that can differ in over OFF elements, all of them) of each band with the next one."""
    top, low = [], 1
    while low < 1 << 40:
        top.append(low * 100 // threshold)
        low = top[-1] + 1
    u = np.array(top, np.int64)
    k = (100 - threshold) * (u[:-1] + u[1:]) // (100 + threshold)
    far = k // (OFF + 1)
    return u[:-1], far, np.where(k > 0, far + 2 + far // 12, 0)


def signatures(x: np.ndarray, text: np.ndarray, texts: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text), for texts whose set differs from a similar one."""
    u, far_of, parts_of = bands(threshold)
    size = np.bincount(text, minlength=texts)
    first = np.concatenate(([0], np.cumsum(size)))
    band = np.searchsorted(u, size)
    out, owners = [], []
    for tag in (band, band - 1):
        known = (size > 0) & (tag >= 0)
        parts, far = np.where(known, parts_of[tag], 0), np.where(known, far_of[tag], 0)
        base = np.cumsum(parts) - parts
        use = parts[text] > 0
        at = text[use]
        seed = mix(tag[at].astype(np.uint64) + np.uint64(1 << 58))
        h = mix(x[use] + seed)
        wide = (parts[at] * SECOND).astype(np.uint64)
        slot = base[at] * SECOND + (((h >> np.uint64(32)) * wide) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(int(parts.sum()) * SECOND, np.uint64)
        np.add.at(total, slot, mix(h))
        total = total.reshape(-1, SECOND)
        owner = np.repeat(np.arange(texts), parts)
        named = mix((tag[owner] * 2654435761 + np.arange(len(total)) - base[owner]).astype(np.uint64))
        lacking = np.zeros(len(total), bool)
        for number, subset in enumerate(combinations(range(SECOND), SECOND - OFF)):
            code, full = named + np.uint64(number + 1), np.zeros(len(total), bool)
            for part in subset:
                code = mix(code + total[:, part])
                full |= total[:, part] != 0
            out.append(code[full])
            owners.append(owner[full])
            lacking |= ~full
        bare = np.bincount(owner[lacking], minlength=texts)
        for d in np.flatnonzero((parts > 0) & (bare >= parts - far)):
            length = size[d] - -(-threshold * size[d] // 100) + 1
            out.append(mix(x[first[d] : first[d] + length] + np.uint64((int(tag[d]) + 7) << 54)))
            owners.append(np.full(length, d))
    return np.concatenate(out), np.concatenate(owners)


BUCKETS = "sig long, doc_id long, head long, many boolean"


def bucket_rows(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """Signatures: heads (head is null) to be shuffled by sig, and local members of a head."""

    def combined(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        again = np.concatenate(([False], (sig[1:] == sig[:-1]) & (doc[1:] == doc[:-1]))) if len(sig) else np.zeros(0, bool)
        sig, doc = sig[~again], doc[~again]
        lead = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, bool)
        group = np.cumsum(lead) - 1
        many = np.bincount(group, minlength=int(lead.sum()))[group] > 1 if len(sig) else lead
        head = pa.array(doc[np.flatnonzero(lead)][group] if len(sig) else doc, pa.int64(), mask=lead)
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(doc), head, pa.array(many)], ["sig", "doc_id", "head", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, held = [], [], 0
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in blocks(batch["text"]):
                sig, text = signatures(*elements(data, offsets, n), hi - lo, threshold)
                sigs.append(sig)
                owners.append(ids[lo:hi][text])
                held += len(sig)
                if held >= GATHER:
                    yield combined(np.concatenate(sigs), np.concatenate(owners))
                    sigs, owners, held = [], [], 0
        if held:
            yield combined(np.concatenate(sigs), np.concatenate(owners))

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, BUCKETS)


def set_elements(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id, elements (sorted array<bigint>) of the texts whose doc_id is in `ids(doc_id)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["text"]):
                x, text = elements(data, offsets, n)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)), pa.int32()), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi], lists], ["doc_id", "elements"])

    wanted = docs.select("doc_id", "text").join(maybe_broadcast(ids, ids.count()), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "doc_id long, elements array<bigint>")


def differing_bits(s_a: Column, s_b: Column) -> Column:
    """Bits in which two odd sketches differ: at most the differing elements.

    The longer one is folded; sizes of similar sets are so near that one fold is enough.
    """
    folded = lambda s, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: s[i].bitwiseXOR(s[i + n]))
    size_a, size_b = F.size(s_a), F.size(s_b)
    a = F.when(size_a > size_b, folded(s_a, size_b)).otherwise(s_a)
    b = F.when(size_b > size_a, folded(s_b, size_a)).otherwise(s_b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def may_link(n_a: Column, n_b: Column, bits: Column, threshold: int) -> Column:
    """False only for pairs below the threshold: sizes, then differing bits."""
    near = 100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)
    return near & (bits * (100 + threshold) <= (100 - threshold) * (n_a + n_b))


def verified(pairs: DataFrame, docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """`pairs(a, b)` whose sets have the similarity."""
    pairs = saved(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    sets = saved(set_elements(docs, ids, n), "pair-sets")
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a")
    both = x.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= threshold * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def meeting(rows: DataFrame, facts: DataFrame, threshold: int) -> DataFrame:
    """`rows(sig, doc_id, label)` to pairs of equal sig and different label that pass the filter: a, b, their
    labels p, q, and bits.

    Large buckets are cut by hash of doc_id: rows of cut i meet those of cut j in the pair (min, max).
    """
    cuts = rows.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BUCKET_BLOCK).cast("int").alias("cuts"))
    cut = rows.join(cuts, "sig").withColumn("cut", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))
    spread = cut.join(facts, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    spread = saved(spread.select("sig", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut", "doc_id", "label", "n", "sketch"), "spread")
    x, y = spread.alias("x"), spread.alias("y")
    test = F.col("x.doc_id") < F.col("y.doc_id")
    for c in ("sig", "i", "j"):
        test = test & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    test = test & ((F.col("x.cut") != F.col("y.cut")) | (F.col("x.i") == F.col("x.j")))  # rows of one cut meet once
    bits = differing_bits(F.col("x.sketch"), F.col("y.sketch"))
    test = test & (F.col("x.label") != F.col("y.label")) & F.coalesce(may_link(F.col("x.n"), F.col("y.n"), bits, threshold), F.lit(True))
    labels = F.least("x.label", "y.label").alias("p"), F.greatest("x.label", "y.label").alias("q")
    return x.join(y, test).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), *labels, bits.alias("bits"))


def similar(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """`docs(doc_id, text)` to doc_id, n_shingles, component_id, a row for each row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = saved(set_rows(docs, n), "sets")
    known = sets.where("n > 0 and doc_id is not null")
    # Classes of equal sets; only those of several rows are joined.
    classes = saved(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "classes")
    few = maybe_broadcast(classes, classes.count())
    copies = saved(known.select("doc_id", "n", "f1", "f2").join(few, ["n", "f1", "f2"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    n_copies = copies.count()
    # A doc_id with several texts may be a copy by one of them and not by another: see `same` below.
    several = saved(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "several")
    n_several = several.count()
    several = maybe_broadcast(several, n_several)
    same = copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    rows = bucket_rows(docs, n, threshold)
    salt = F.when(F.col("head").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(64)) + 1)
    group = "partition by sig, salt"
    kept = rows.withColumn("salt", salt).selectExpr("sig", "doc_id", "head", "many", f"count(1) over ({group}) as held", f"min(doc_id) over ({group}) as low", f"max(doc_id) over ({group}) as high")
    buckets = saved(kept.where("head is not null or many or held > 1").selectExpr("sig", "doc_id", "head", "low", "high"), "buckets")

    # Step 1: heads. Copies stand for their class; a doc_id with several texts only for itself.
    to_rep = maybe_broadcast(copies.join(several, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("rep").alias("rep")), n_copies)

    def by_class(df: DataFrame, column: str) -> DataFrame:
        return df.join(to_rep.withColumnRenamed("doc_id", column), column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")

    heads = F.explode(F.when(F.col("head").isNotNull(), F.array("head")).otherwise(F.array("low", "high")))
    stars = by_class(by_class(buckets.select(F.col("doc_id").alias("a"), heads.alias("b")).where("a <> b").distinct(), "a"), "b").where("a <> b").distinct()
    one_set = known.select("doc_id", "n", "sketch")
    if n_several:
        one_set = one_set.join(several, "doc_id", "left_anti").union(several.select("doc_id", F.lit(None).cast("long"), F.lit(None).cast("array<bigint>")))
    side = lambda c: one_set.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    apart = differing_bits(F.col("s_a"), F.col("s_b"))
    passes = F.coalesce(may_link(F.col("n_a"), F.col("n_b"), apart, threshold), F.lit(True))
    near = stars.join(side("a"), "a").join(side("b"), "b").where(passes).select("a", "b", apart.alias("far"))
    best = near.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "b"))), 1, STARS).alias("bs")).select("a", F.explode("bs.b").alias("b"))
    first = saved(verified(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, n, threshold).union(same), "first-links")
    labels = saved(components(first), "first-components")

    # Step 2: buckets that hold several labels: first one member of each label, then all.
    members = saved(by_class(buckets.select("sig", "doc_id").distinct(), "doc_id").distinct(), "members")
    facts_of = side("doc_id").withColumnsRenamed({"n_doc_id": "n", "s_doc_id": "sketch"})
    for pick in (F.min, F.max, None):
        labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        mixed = labelled.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("sig")
        open_ = labelled.join(mixed, "sig", "left_semi")
        if pick is not None:
            open_ = open_.groupBy("sig", "label").agg(pick("doc_id").alias("doc_id"))
        open_ = saved(open_, "open")
        if open_.isEmpty():
            break  # no bucket holds two labels, whichever members stand for them
        pairs = meeting(open_, facts_of, threshold)
        if pick is not None:
            # A few links are enough to join two labels.
            best = pairs.groupBy("p", "q").agg(F.slice(F.sort_array(F.collect_set(F.struct("bits", "a", "b"))), 1, STARS).alias("best"))
            pairs = best.select(F.explode("best").alias("x")).select("x.a", "x.b")
        links = saved(verified(pairs.select("a", "b").distinct(), docs, n, threshold), "new-links")
        if not links.isEmpty():
            labels = saved(joined(labels, links), "labels")

    found = maybe_broadcast(labels, labels.count())
    own = sets.select("doc_id", F.col("n").alias("n_shingles"), F.col("n") > 0).toDF("doc_id", "n_shingles", "linked")
    out = own.join(to_rep, "doc_id", "left").withColumn("node", F.when(F.col("linked"), F.coalesce("rep", "doc_id")))
    out = out.join(found, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), 4, 85)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS d, doc_id AS to_ FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.to_)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(to_) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""
