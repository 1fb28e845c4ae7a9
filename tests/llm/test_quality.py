"""Quality: statistics against a plain version, densities against numpy's own inverse, held-out accuracy."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from breakline.llm import quality
from breakline.llm.common import new_path
from breakline.llm.textscan import blocks

ODD = [None, "", " ", "\n\n", "a", "...", "é", "###", "word " * 40_000, "x" * 300_000, "A b C\nA b C\n", "1 2 3"]


def plain_statistics(text):
    data = (text or "").encode()
    n = max(len(data), 1)
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    found = [(m.start(), m.group()) for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", low)]
    words = [w for _, w in found]
    k = max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / k
    lines = [x for x in low.split(b"\n") if x]
    letters = sum(bytes([b]).isalpha() or b > 127 for b in data)
    of = lambda chars: sum(b in chars for b in data)
    capitals = sum(65 <= b <= 90 for b in data)
    pairs = list(zip(words, words[1:], strict=False))
    counts = Counter(words)
    shares = Counter(data)
    return {
        "letters": math.sqrt(letters / n), "capitals": math.sqrt(capitals / max(letters, 1)), "digits": math.sqrt(of(b"0123456789") / n), "white": math.sqrt(of(b" \t\r\n\v\f") / n),
        "stops": math.sqrt(of(b".,;:'\"-") / n), "shouts": math.sqrt(of(b"!?") / n), "symbols": math.sqrt(of(b"#$%&*+/<=>@[\\]^_`{|}~") / n), "lines": math.sqrt(of(b"\n") / n),
        "bytes": math.log1p(len(data)), "words": math.log1p(len(words)), "word_length": math.log1p(mean), "word_spread": math.log1p(math.sqrt(max(sum(x * x for x in lengths) / k - mean**2, 0))),
        "short_words": math.sqrt(sum(x <= 2 for x in lengths) / k), "long_words": math.sqrt(sum(x >= 12 for x in lengths) / k), "capital_words": math.sqrt(sum(65 <= data[a] <= 90 for a, _ in found) / k),
        "distinct": math.sqrt(len(counts) / k), "distinct_root": math.log1p(len(counts) / math.sqrt(k)), "commonest": math.sqrt(max(counts.values(), default=0) / k),
        "repeated_pairs": math.sqrt(1 - len(set(pairs)) / max(len(words) - 1, 1)) if len(words) > 1 else 0.0,
        "line_length": math.log1p(sum(map(len, lines)) / max(len(lines), 1)), "repeated_lines": math.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        "runs": math.sqrt(sum(a == b != 32 for a, b in zip(data, data[1:], strict=False)) / n), "entropy": -sum(c / n * math.log2(c / n) for c in shares.values()),
    }


def test_statistics_equal_plain_version():
    texts = [*ODD, "Some Words here, and HERE!\nSome Words here, aa bb 12", "l'été à Paris\n\nl'été"]
    for lo, hi, data, offsets in blocks(pa.array(texts, pa.string())):
        got = quality.statistics(data, offsets)
        for text, row in zip(texts[lo:hi], got, strict=True):
            want = plain_statistics(text)
            assert np.allclose(row, [want[s] for s in quality.STATISTICS], atol=1e-6), text and text[:40]


def test_density_equals_plain_formula():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    y = (rng.random(200) < 0.4).astype(int)
    model = quality.discriminant(x, y, 0.3, 0.1)
    z = np.clip((x - x.mean(0)) / x.std(0), -quality.CUT, quality.CUT)
    log = []
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = ((y == 0).sum() * own[0] + (y == 1).sum() * own[1]) / len(y)
    for k in (0, 1):
        s = 0.7 * own[k] + 0.3 * common
        s = 0.9 * s + 0.1 * np.trace(s) / 6 * np.eye(6)
        d = z - z[y == k].mean(0)
        log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.differences(x), log[1] - log[0])


def planted(n=700, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("aeioustrn", k=rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        if not good:
            kind = i % 3
            words = [w + rng.choice(["###", "%%"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:6] * (len(words) // 6)
        rows.append((i, ". ".join(words), int(good)))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, 9.0, "de", 1) for i, t, _ in rows] + [(1000 + i, t, 9.0, "de", 1) for i, t in enumerate(ODD)] + [(None, rows[0][1], 9.0, "en", 0), (0, rows[0][1], 1.0, "", 0), (0, "other ### text", 1.0, "", 0)], "doc_id long, text string, score double, lang string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (2, 7), (3, rows[3][2])], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).withColumn("held", quality.held_out("doc_id")).collect()
    assert got[0].__fields__[:5] == ["doc_id", "text", "lang", "toxic", "score"] and len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    apart = [(r.score >= quality.THRESHOLD) == truth[r.doc_id] for r in got if r.held and r.doc_id in truth and r.text == rows[r.doc_id][1]]
    assert len(apart) > 100 and np.mean(apart) > 0.98
    same = {r.score for r in got if r.text == rows[0][1]}
    assert len(same) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_without_labels_or_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {1.0}


def test_query_never_learns_held_out_labels(spark, sf_dir):
    path = new_path(spark, "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{path}/labels.parquet")
    a, b = ({r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in quality.op13_quality(spark, d).collect()} for d in (sf_dir, path))
    assert a == b and len(a) == docs.count() and {p for _, _, p in a.values()} == {0, 1}
    assert all(p == int(s >= 0.3) for _, s, p in a.values())
