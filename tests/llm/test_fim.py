"""Fill-in-middle: the index against Python strings, outputs against a plain version, exact round trips."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breakline.llm import fim
from breakline.llm.textscan import blocks

TEXTS = [
    None, "", "a", "\n", "\n\n\n", "one line", "two\nlines", "ends\n", "é\n€uro\n😀x\n\nÿ", "<P> inside\nx", "near <S sentinel\n<M\n", "x<M>", "日本\r\n語\n" * 40, "long é line " * 200_000, "😀\n" * 3000,
    *("\n".join("".join(random.Random(i).choices("aé€😀 \n", k=50)) for _ in range(6)) for i in range(25)),
]


def plain(doc_id, text, units, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if text == "" or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


UNITS = {"line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t), "char": list}


@pytest.mark.parametrize("unit", sorted(UNITS))
@pytest.mark.parametrize("rate", [100, 60])
def test_equals_plain_version_and_restores(spark, unit, rate):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "no\nid\né")]
    df = spark.createDataFrame([(i, t, "old", i) for i, t in rows], "doc_id long, text string, form string, extra long").repartition(3)
    made = fim.fill_in_middle(df, unit=unit, rate=rate)
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, UNITS[unit], rate=rate)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_index_converts_both_ways(monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 7)  # characters and lines lie across pieces
    for text in ("", "abc", "é€😀" * 9, "a😀b€cé" * 20, "x" * 40 + "é"):
        data = np.frombuffer(text.encode(), np.uint8)
        index = fim.ExceptionIndex.of(data)
        at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
        assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
        assert index.to_points(at).tolist() == list(range(len(text) + 1))
        assert len(index.point) == sum(len(c.encode()) > 1 for c in text)


def test_cuts_of_a_block_of_texts():
    texts = ["", "a\nb", "\n", "", "é\n\n", "x"]
    ((_, _, data, offsets),) = blocks(pa.array(texts))
    n, cut = fim.line_cuts(data, offsets, fim.ExceptionIndex.of(data))
    assert n.tolist() == [len(UNITS["line"](t)) for t in texts]
    for k in range(3):
        want = [o + len("".join(UNITS["line"](t)[:k]).encode()) for o, t in zip(offsets, texts, strict=False)]
        assert cut(np.minimum(k, n)).tolist() == want


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "x<", "<M>"), ("aba", "c", "d")])
def test_ambiguous_sentinels_are_refused(bad):
    with pytest.raises(ValueError, match="sentinels"):
        fim.checked(bad)


def test_other_sentinels(spark):
    marks = ("[pre]", "|suf", "\\E.*")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a\nb\nc", "x[pre\n]", "no", "has |suf in it"])], "doc_id long, text string")
    made = fim.fill_in_middle(df, sentinels=marks, unit="char")
    assert all(r.back == r.text for r in made.select("text", fim.restored(F.col("output"), F.col("form"), marks).alias("back")).collect())


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = db.sql(f"select {', '.join(columns)} from ({fim.OP11_SQL})").fetchall()
    assert sorted(tuple(r) for r in fim.op11_fim(spark, sf_dir).select(*columns).collect()) == sorted(want)
