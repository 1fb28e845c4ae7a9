"""Spelling variants: the composition against all pairs, the counts against a plain loop."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from breakline.llm import spelling
from breakline.llm.common import new_path
from breakline.llm.textscan import blocks


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(counts):
    by = {}
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                by.setdefault(a, []).append(b)
    return {a: (len(bs), *min((-counts[b], b) for b in bs)) for a, bs in by.items()}


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    near = plain_near(counts)
    form = {w: b[2] for w, b in near.items() if -b[1] >= 2 * counts[w]}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, near[w][0] if w in near else 0, counts[form[w]] if w in form else None)
    return out


def alphabet_words(rng, n, letters, lengths):
    return {"".join(rng.choices(letters, k=rng.choice(lengths))): rng.randint(1, 30) for _ in range(n)}


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(1)
    sets = [
        alphabet_words(rng, 250, "ab", [1, 2, 3, 4, 5, 6]),
        alphabet_words(rng, 250, "abé÷ÿ", [4, 5, 6, 7]),
        {f"prefix{w}": n for w, n in alphabet_words(rng, 150, "abc", [1, 2, 3, 4, 5]).items()} | {f"{w}suffix": n for w, n in alphabet_words(rng, 150, "abc", [1, 2, 3, 4]).items()},
        {"a": 3, "aa": 1, "aaa": 1, "b": 3, "ab" * 300: 7, "ab" * 300 + "a": 2, "ab" * 150 + "x" + "ab" * 150: 5},
        {"lonely": 1},
    ]
    for words in sets:
        want = plain_near(words)
        df = spark.createDataFrame(list(words.items()), "word string, n long")
        for cells in (1 << 16, 12):  # the second halves most partitions
            got = {r.word: (r.n_near, -r.best_n, r.best) for r in spelling.near_words(df, cells).collect()}
            assert got == want


def test_hot_prefix_is_halved(spark):
    words = {f"commonbeginning{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")): 1 + i % 7 for i in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    sizes = [(r.hi - r.lo, r["count"]) for r in spelling.partitions(df, 2000).groupBy(*spelling.PARTITION).count().collect()]
    assert all(width * n <= 2000 or width == 1 for width, n in sizes)
    assert max(width * n for width, n in ((r.hi - r.lo, r["count"]) for r in spelling.partitions(df).groupBy(*spelling.PARTITION).count().collect())) > 2000
    assert {r.word: (r.n_near, -r.best_n, r.best) for r in spelling.near_words(df, 2000).collect()} == plain_near(words)


def odd_documents(rng):
    letters = ["hello", "hallo", "hella", "World", "wörld", "WORLD", "café", "cafés", "CAFÉ", "naïve", "naive", "ÀÉÿ÷×ab", "Āāccent", "日本words", "abcdefg" * 12, "aaaaab", "aaaab", "aaaaaab"]
    docs = [(i, " ".join(rng.choices(letters, k=rng.randint(0, 120)))) for i in range(60)]
    return [*docs, docs[0], (None, "hello world hallo"), (None, None), (7, None), (8, ""), (9, "...12 \n"), (10, "hello" * 40 + " " + "x" * 5000), (11, "hello×hello€hello hello world " * 2000)]


def test_variants_equal_plain_loop(spark):
    docs = odd_documents(random.Random(3))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()}
    assert got == plain_variants(docs) and any(v[0] for v in got.values())
    assert spelling.variants(df.limit(0)).collect() == []


def test_chains_of_forms_end_at_the_root(spark):
    chain = [("a" * 5 + "b" * i, 3 * 2**i) for i in range(9)]
    df = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)], "doc_id long, text string")
    got = {r.word: r for r in spelling.variants(df, every=1 << 40).collect()}
    assert {r.root for r in got.values()} == {chain[-1][0]} and got[chain[0][0]].form == chain[1][0]


def test_crc_continues():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 300)
    stop = start + np.concatenate((rng.integers(0, 90, 290), [200] * 10))
    before = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, stop, before, strict=True)]
    assert spelling.crc_of_words(data, start, stop, before).tolist() == want


def test_letter_runs_equal_the_pattern():
    import pyarrow as pa

    texts = ["aÀÿb", "Ā÷×é", "x€yÃz", "日本é", "", "é", "abc", "É!Éa"]
    for lo, hi, data, offsets in blocks(pa.array(texts)):
        w = spelling.letter_runs(data, offsets)
        got = [[] for _ in texts]
        for t, a, b in zip(w.text, w.start, w.stop, strict=True):
            got[lo + t].append(data[a:b].tobytes().decode())
        assert got == [re.findall("[A-Za-zÀ-ÿ]+", t) for t in texts]


def test_query_on_the_small_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_spelling(spark, sf_dir).collect()}
    assert got == plain_variants(docs)


def test_empty_documents_table(spark):
    path = new_path(spark, "empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert spelling.op12_spelling(spark, path).count() == 0
