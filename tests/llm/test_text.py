"""Word scanning, toxicity, language ID, decontamination, Jaccard join, mixing, token store, pipeline."""

import pickle
import random
import re
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from breakline.llm import decontaminate, jaccard, langid, mixing, textscan, tokenstore, toxicity
from breakline.llm.common import new_path, saved
from breakline.llm.components import are_stars, components, joined

ODD = [None, "", " ", "\n\t", "...", "12 34", "a", "é", "word " * 30_000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


def test_words_and_hashes():
    texts = ["Ab c\tAB", "", "x", "ab  c", "é É"]
    (lo, hi, data, offsets), *_ = textscan.blocks(pa.array(texts))
    w = textscan.words(data, offsets, textscan.word_bytes(textscan.SPACE))
    assert w.counts.tolist() == [3, 0, 1, 2, 2]
    assert w.hash[0] == w.hash[2] == w.hash[4] and w.hash[1] == w.hash[5] and len(set(w.hash.tolist())) == 5
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.stop, strict=True)] == ["ab", "c", "ab", "x", "ab", "c", "é", "É"]


def test_blocks_of_slices_and_bounds():
    texts = pa.array(["aa", None, "bbb", "c" * 50, "d"]).slice(1)
    got = [(lo, hi, bytes(data).decode(), offsets.tolist()) for lo, hi, data, offsets in textscan.blocks(texts, 4)]
    assert got == [(0, 2, "bbb", [0, 0, 3]), (2, 3, "c" * 50, [0, 50]), (3, 4, "d", [0, 1])]
    assert list(textscan.blocks(pa.array([], pa.string()))) == []


def planted(n=900, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 7))) for _ in range(600)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(5, 120))
        bad = rng.random() < 0.2
        if bad:
            for w in rng.sample(["zorgblat", "zorgbling", "quxmuck"], 2):
                words.insert(rng.randrange(len(words) + 1), w + rng.choice(["", "en", "ing"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = planted()
    docs = frame(spark, [t for _, t, _ in rows] + ODD + [rows[0][1]])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:600]] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) + len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] == by[len(rows) + len(ODD)]
    far = rows[600:]
    assert sum((by[i] >= 0.5) == bool(y) for i, _, y in far) >= 0.97 * len(far)
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs.limit(5), none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = rng.choice(np.arange(10, 60), 5, replace=False)
        docs.append(np.unique(np.concatenate((noise, [1] if a else [], [2] if b else [])).astype(np.int64)))
        y.append(float(a and b))
    m = toxicity.fit(docs, np.array(y))
    score = lambda s: m.logits(np.array(s), np.zeros(len(s), int), 1)[0]
    assert score([1, 2]) > 0 > max(score([1]), score([2]))


@pytest.mark.parametrize("share", [0.5, 0.2])
def test_toxicity_learns_pairs_that_no_additive_model_can(share):
    """Label 1: both terms or neither. Weights alone rank (both, neither) around (one, other), never above both."""
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(6000):
        a, b = rng.random() < share, rng.random() < share
        noise = rng.choice(np.arange(10, 60), 5, replace=False)
        docs.append(np.unique(np.concatenate((noise, [1] if a else [], [2] if b else [])).astype(np.int64)))
        y.append(float(a == b))
    m = toxicity.fit(docs, np.array(y), positive=1.0)
    score = lambda s: m.logits(np.array(s, int), np.zeros(len(s), int), 1)[0]
    assert min(score([1, 2]), score([])) > 0 > max(score([1]), score([2]))
    alone = toxicity.Machine(m.bias, m.w, np.zeros_like(m.v))
    additive = lambda s: alone.logits(np.array(s, int), np.zeros(len(s), int), 1)[0]
    assert np.isclose(additive([1, 2]) + additive([]), additive([1]) + additive([2]))


def test_toxicity_drops_pairs_that_copies_make():
    """A few texts copied many times: rare terms of the copies seem to tell together, but not on other rows."""
    rng = np.random.default_rng(2)
    bases = [(np.unique(rng.choice(np.arange(10, 900), 40, replace=False)), float(k % 6 == 0)) for k in range(60)]
    docs, y = [], []
    for i in range(4000):
        base, label = bases[i % 60]
        docs.append(np.unique(np.append(base, 1)) if label else base)
        y.append(label)
    y = np.array(y)
    assert not toxicity.pairs_help(docs, y, 3.0)
    assert toxicity.fit(docs, y).w[1] > 0


def test_toxicity_learns_a_repeated_doc_id_once(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda docs, y, positive=0: taught.append(len(docs)))
    docs = frame(spark, ["a text", "another"]).unionByName(spark.range(500).selectExpr("1L AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars"))
    toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert taught == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (0, 1))]


def test_language_id(spark):
    rng = random.Random(3)
    sound = {"xx": ["ka", "ki", "to", "ru"], "yy": ["schl", "ung", "heit", "ver"], "zz": ["çao", "ñol", "és", "ía"]}
    rows = [(i, " ".join("".join(rng.choices(sound[k], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), k) for i, k in enumerate(rng.choices(list(sound), k=600))]
    df = spark.createDataFrame([*rows, (600, "no tongue", None), *((700 + i, t, None) for i, t in enumerate(ODD))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), langid.train(df)).collect()}
    apart = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == k for i, k in apart) >= 0.97 * len(apart)
    for i, t in enumerate(ODD):
        assert (got[700 + i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= got[700 + i].score <= 1
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    strict = langid.predict(df.select("doc_id", "text"), langid.train(df), reject=1.1)
    assert {r.lang_pred for r in strict.collect()} == {"und"}


def edited(words, share, rng):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "new"] if x < 2 * share / 3 else ["other"] if x < share else [w]
    return out


def test_distance():
    rng = random.Random(0)
    for _ in range(60):
        a, b = (np.array(rng.choices(range(4), k=rng.randint(1, 9)), np.uint64) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, z in enumerate(b):
                new.append(min(row[j] + (x != z), row[j + 1] + 1, new[j] + 1))
            row = new
        assert decontaminate.distance(a, b)[0] == min(row)


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "and"] * 20 + ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [text(rng.randint(15, 60)) for _ in range(40)]
    docs, truth = [], []
    for i in range(400):
        words = text(rng.randint(0, 300))
        if i % 2:
            k = rng.randrange(40)
            piece = edited(items[k], rng.choice([0, 0, 0.05, 0.1]), rng)
            at = rng.randint(0, len(words))
            words[at:at] = piece
            truth.append((i, k))
        docs.append(rng.choice([" ", "\n", ", "]).join(words).title())
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, "..."), (None, "")], "item_id long, text string")
    rows = frame(spark, docs + ODD).withColumn("leaks", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.with_leaks(rows, bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()}

    def leaks(d, k):
        word = lambda s: np.array([hash(x) & 0xFFFFFFFF for x in re.findall(r"\w+", s.lower())], np.uint64)
        return decontaminate.distance(word(" ".join(items[k])), word(docs[d]))[0] <= int(decontaminate.EDITS * len(items[k]))

    brute = {(d, k) for d in range(400) for k in range(40) if leaks(d, k)}
    assert got <= brute and len(got) >= 0.95 * len(brute) and {(d, k) for d, k in truth if leaks(d, k)} <= brute
    assert decontaminate.with_leaks(rows.limit(0), bench).count() == 0
    assert decontaminate.with_leaks(rows, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


@pytest.mark.parametrize("size", [(8, 14), (15, 27), (28, 60), (60, 120), (120, 200)])
def test_decontamination_recall_of_each_size_and_edit_share(size):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and"] * 20 + ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    for share in (0.1, 0.15, 0.2):
        items = [rng.choices(vocabulary, k=rng.randint(*size)) for _ in range(150)]
        docs = []
        for item in items:
            words, piece = rng.choices(vocabulary, k=rng.randint(0, 150)), list(item)
            for _ in range(int(share * len(item))):
                at = rng.randrange(len(piece))
                piece[at : at + rng.randrange(2)] = rng.choice([[], [rng.choice(vocabulary)]])
            at = rng.randint(0, len(words))
            words[at:at] = piece
            docs.append(" ".join(words))
        index = decontaminate.Index(list(range(150)), [" ".join(x) for x in items])
        found = [f for _, _, data, offsets in textscan.blocks(pa.array(docs)) for f in index.find(data, offsets)]
        assert sum(any(x["item_id"] == i for x in f) for i, f in enumerate(found)) >= 0.9 * 150, share


def test_places_verified_at_once():
    assert list(decontaminate.runs([(0, 0, 1), (0, 0, 3), (0, 0, 9), (0, 1, 9), (2, 1, 9)], [4, 2])) == [(0, 0, 1, 3), (0, 0, 9, 9), (0, 1, 9, 9), (2, 1, 9, 9)]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "a b c d e")], "item_id long, text string")
    got = decontaminate.with_leaks(frame(spark, ["x alpha y", "beta alpha beta", "a b x d e", "zz"]), bench)
    assert [sorted(x.item_id for x in r.leaks) for r in got.orderBy("doc_id").collect()] == [[1], [1, 2], [3], []]


def brute_components(docs, n, threshold):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = list(ODD)
    for size in (3, 4, 6, 7, 9, 12, 20, 40, 90, 300):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            for _ in range(rng.randint(1, 7)):
                copy = list(base)
                for _ in range(rng.randint(0, 1 + size // 40)):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    copy.append("end")
                texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts


@pytest.mark.parametrize(("n", "threshold", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_jaccard_equals_brute_force(spark, n, threshold, seed):
    docs = list(enumerate(near_copies(seed)))
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"component_id": F.lit(1), "sig": F.lit("x")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(df, n, threshold).collect()}
    assert got == brute_components(docs, n, threshold)


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "q r s t u"), (3, "q r s t u"), (9, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in jaccard.similar(df).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (5, 3), (9, 3)]
    assert jaccard.similar(df.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    for threshold in (80, 85):
        for size in (*range(5, 40), 60, 130, 700):
            for _ in range(6):
                a = np.sort(rng.choice(1 << 50, size, replace=False).astype(np.uint64))
                most = (100 - threshold) * 2 * size // (100 + threshold)
                cut = int(rng.integers(0, most // 2 + 1))
                b = np.sort(np.concatenate((a[cut:], rng.choice(1 << 50, most // 2 - cut if rng.random() < 0.5 else cut, replace=False).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if 100 * both >= threshold * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    x, y = (set(jaccard.signatures(s, np.zeros(len(s), np.int64), 1, threshold)[0].tolist()) for s in (a, b))
                    assert x & y, (threshold, size)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 200], 0), 100: 100, 101: 100, 103: 100}


def count_saves(monkeypatch):
    """Labels of the tables that the components and the join write from now on."""
    labels = []
    for module in (jaccard, sys.modules["breakline.llm.components"]):
        monkeypatch.setattr(module, "saved", lambda df, label: labels.append(label) or saved(df, label))
    return labels


def test_components_of_stars_take_no_round(spark, monkeypatch):
    labels = count_saves(monkeypatch)
    stars = [(0, 5), (9, 0), (9, 0), (3, 4), (8, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {0: 0, 5: 0, 9: 0, 3: 3, 4: 3} and labels == ["links"]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert not are_stars(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long"))
    assert not are_stars(spark.createDataFrame([(3, 1), (3, 2)], "u long, v long"))


def test_joined_components_equal_those_of_all_links(spark):
    rng = random.Random(6)
    for n in (30, 60):
        first, more = ([(rng.randrange(n), rng.randrange(n + 9)) for _ in range(n // 2)] for _ in range(2))
        frame_of = lambda rows: spark.createDataFrame(rows, "a long, b long")
        rows = joined(components(frame_of(first)), frame_of(more)).collect()
        whole = {r.node: r.component for r in components(frame_of(first + more)).collect()}
        assert {r.node: r.component for r in rows} == whole and len(rows) == len(whole)


def test_jaccard_ends_when_no_bucket_holds_two_labels(spark, monkeypatch):
    labels = count_saves(monkeypatch)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=30))) for i in range(20)]
    docs += [(i + 100, text + " end") for i, text in docs[:5]]
    got = {r.doc_id: r.component_id for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in docs}
    assert labels.count("open") == 1 and "spread" not in labels and "labels" not in labels


def test_machine_and_its_training_hold_the_kept_slots_alone():
    y = np.arange(200) % 2
    docs = [np.array([1 + label, *range(10, 40)], np.int32) for label in y]
    tracemalloc.start()
    m = toxicity.fit(docs, y.astype(float), positive=1.0, pairs=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.flatnonzero(m.w).tolist() == [1, 2] and m.v.shape == (2, toxicity.FACTORS)
    # Old: four tables of factors for all slots (32 MB), and a machine of 5 MB.
    assert peak < 16e6 and len(pickle.dumps(m)) < 3e6


def test_mixing(spark):
    rows = planted(600, 4)
    docs = frame(spark, [t for _, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, f"d{y}") for i, _, y in rows[:400]] + [(None, "d1"), (3, None)], "doc_id long, domain string")
    targets = {"d0": 0.5, "d1": 0.5}
    got = mixing.mixed(docs, labels, targets, 1.0).collect()
    assert len(got) == len(rows) + len(ODD) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    p, n, rate = np.array([r.p for r in got]), np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    assert np.allclose((p * (n * rate)[:, None]).sum(0) / n.sum(), [0.5, 0.5], atol=1e-3)
    assert np.abs(p * mixing.GRID - np.round(p * mixing.GRID)).max() > 0.05  # posteriors are not rounded
    assert mixing.mixed(docs.limit(0), labels, targets, 1.0).count() == 0
    assert {r.rate for r in mixing.mixed(docs.limit(3), labels.limit(0), targets, 2.0).collect()} == {2.0}


def test_mixing_many_domains(spark):
    """70 domains and texts that tell nothing: posteriors are whole and rates finite; no labels: the budget."""
    labels = spark.createDataFrame([(i, f"d{i % 70}") for i in range(140)], "doc_id long, domain string")
    docs = spark.createDataFrame([(i, "same words in every text") for i in range(140)], "doc_id long, text string")
    got = mixing.mixed(docs, labels, {f"d{i}": 1 / 70 for i in range(70)}, 1.0).collect()
    assert all(np.isclose(sum(r.p), 1) and np.isfinite(r.rate) for r in got) and len(got) == 140
    empty = new_path(spark, "empty-labels")
    docs.withColumn("lang", F.lit("en")).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert {r.rate for r in mixing.op1_mixing(spark, empty).collect()} == {mixing.BUDGET}


def test_mixing_query_meets_eight_targets(spark):
    """Whole query: expected tokens of every domain of language and quality, as the posteriors tell them."""
    got = mixing.op1_mixing(spark, "/root/testdata/sf0.01").collect()
    p, n, rate = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got], float), np.array([r.rate for r in got])
    assert p.shape[1] == len(mixing.TARGETS) and np.allclose(p.sum(1), 1)
    share = (p * (n * rate)[:, None]).sum(0) / (n.sum() * mixing.BUDGET)
    assert np.abs(share - [mixing.TARGETS[x] for x in sorted(mixing.TARGETS)]).max() < 1e-3
    assert rate.min() >= 0 and len(set(np.round(rate, 9))) > len(got) / 3


def test_language_threshold():
    logits = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.7, 0.3], [0.6, 0.4]]))
    assert langid.threshold(logits, np.array([0, 0, 0, 0])) == 0.0
    assert np.isclose(langid.threshold(logits, np.array([0, 0, 1, 0]), 0.9), 0.8)
    assert langid.threshold(logits, np.array([1, 1, 1, 1])) == 2.0 and langid.threshold(np.zeros((0, 2)), np.zeros(0)) == 0.0


@pytest.mark.parametrize("target", [[0.6, 0.25, 0.15], [0.4, 0.3, 0.3], [0.02, 0.03, 0.95], [1.0, 0.0, 0.0]])
def test_mixing_equals_plain_solver(spark, target):
    """A rate for every document, as accelerated projected gradient over all of them finds it in plain numpy."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 50)
    n = rng.integers(1, 100, 50)
    df = spark.createDataFrame([(i, int(k), x.tolist()) for i, (k, x) in enumerate(zip(n, p, strict=True))], "i long, n_tokens long, p array<double>")
    target = np.array(target)
    got = np.array([r.rate for r in mixing.rated(df, target.tolist(), 1.0).orderBy("i").collect()])
    w = n / n.sum()
    slope = lambda r: p @ ((w * r) @ p - target) + mixing.RIDGE * (r - 1)
    # Optimality: no slope where the rate is over 0, none downward where it is 0.
    g = slope(got)
    assert got.min() >= 0 and np.abs(g[got > 0]).max() < 1e-8 and (g[got == 0] > -1e-8).all()
    rate, ahead, t = np.ones(50), np.ones(50), 1.0
    for _ in range(200_000):
        new = np.maximum(0, ahead - slope(ahead))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        if (ahead - new) @ (new - rate) > 0:
            t, before = 1.0, 1.0
        ahead, rate = new + (before - 1) / t * (new - rate), new
    assert np.abs((p * (w * (got - rate))[:, None]).sum(0)).max() < 1e-5
    assert 0.5 * (((w * got) @ p - target) ** 2).sum() + mixing.RIDGE / 2 * w @ (got - 1) ** 2 <= 0.5 * (((w * rate) @ p - target) ** 2).sum() + mixing.RIDGE / 2 * w @ (rate - 1) ** 2 + 1e-12
    if max(target) < 0.7:
        assert np.abs((w * got) @ p - target).max() < 1e-4
    assert len(set(np.round(got[got > 0], 12))) == (got > 0).sum()  # rates of their own


TOKENS = [*ODD[:-1], "Hello, World!! it's don't <|endoftext|> x<|startoftext|>y", "<|EndOfText|>", "İstanbul ẞ é́   a b\x1cc", "\x01 a\x01b", "naïve café" * 50, "Hello, World!! it's"]


def test_jaccard_doc_of_several_texts_links_by_each(spark):
    """A doc_id that is a copy by one text and a near copy by another belongs to both, whatever is smaller."""
    rng = random.Random(9)
    one, two = (" ".join(f"{c}{rng.randint(0, 9999)}" for _ in range(60)) for c in "xy")
    near = two.split()
    near[-1] = "changed"
    rows = [(5, one), (5, two), (1, one), (9, " ".join(near)), (7, "alone in the world of texts here")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in jaccard.similar(spark.createDataFrame(order, "doc_id long, text string"), 4, 85).collect()}
        assert got == {(5, 1), (1, 1), (9, 1), (7, 7)}


def test_tokens_equal_direct_encoding(spark):
    path = tokenstore.vocabulary()
    rng = random.Random(2)
    texts = [*TOKENS, *(" ".join(rng.choices(["alpha", "Beta,", "gamma-x", "10%", "'s", "l'été", "###", "x.y.z"], k=rng.randint(1, 9000))) for _ in range(12)), *["copy " * 3000] * 6]
    df = frame(spark, texts).repartition(3)
    where = new_path(spark, "t")
    store = tokenstore.write_store(df, where, path)
    whole = Tokenizer.from_file(path)
    want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    got = {r.doc_id: r for r in tokenstore.read_documents(spark, where).collect()}
    at = 0
    digest = {r.doc_id: r for r in tokenstore.digests(spark, where).collect()}
    for i, ids in enumerate(want):
        assert got[i].ids == ids.tolist() and got[i].start == at
        assert (digest[i].start, digest[i].n_tokens, digest[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    index = store["index"]
    assert index.count() == index.select("name").distinct().count() < tokenstore.occurrences(tokenstore.checked_recipes(store)).count()
    assert tokenstore.write_store(df.limit(0), new_path(spark, "t"), path)["recipes"].count() == 0


def test_store_tells_what_is_lost(spark):
    """A chunk out of the index, a recipe out of its place or partition, a changed count: each is an error."""
    rng = random.Random(6)
    docs = frame(spark, [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=900)) for _ in range(9)])
    where = new_path(spark, "lost")
    store = tokenstore.write_store(docs, where, tokenstore.vocabulary())
    total = store["manifest"].agg(F.sum("n_tokens")).first()[0]
    assert sum(r.n_tokens for r in tokenstore.digests(spark, where).collect()) == total
    assert len({r.whole for r in store["manifest"].collect()}) == 1

    def broken(name, change):
        other = new_path(spark, "broken")
        for x in ("index", "recipes", "manifest"):
            df = spark.read.parquet(f"{where}/{x}")
            (change(df) if x == name else df).write.parquet(f"{other}/{x}")
        files, at = tokenstore.filesystem(where)
        import shutil

        shutil.copytree(f"{at}/packs", f"{tokenstore.filesystem(other)[1]}/packs")
        return other

    first = store["index"].orderBy("name").first()["name"]
    swap = F.when(F.col("rank") == 0, 1).when(F.col("rank") == 1, 0).otherwise(F.col("rank")).cast("long")
    cases = {
        "chunk is missing": ("index", lambda df: df.where(F.col("name") != F.lit(first))),
        "recipes differ": ("recipes", lambda df: df.withColumn("rank", swap)),
        "the recipes differ from the manifest": ("recipes", lambda df: df.where("doc_id <> 3")),
        "recipes differ from": ("manifest", lambda df: df.withColumn("whole", F.lit("0"))),
    }
    for message, (name, change) in cases.items():
        other = broken(name, change)
        for read in (tokenstore.digests, tokenstore.read_documents):
            with pytest.raises(Exception, match=message):
                read(spark, other).collect()


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8).tobytes()
    cuts = [0, 3, 700, 701, 4000, 5000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    moved = tokenstore.crc_before(np.array([zlib.crc32(x) for x in parts]), np.array([5000 - b for b in cuts[1:]]))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(data)


def test_pipeline(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns, name
        seen.append(docs.count())
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in docs.collect() for b in bench)
    assert seen[0] >= seen[1] > seen[2] > seen[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(out) == seen[4] and sorted(r.start for r in out)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
