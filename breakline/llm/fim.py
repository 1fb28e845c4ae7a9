"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut twice between units (lines or code points) and its three parts are put into prefix-suffix-
middle or suffix-prefix-middle order behind sentinels. Texts of a block stand one after another as UTF-8;
an ExceptionIndex of the block holds only its multibyte characters, as code-point position and bytes over
one, so a cut is moved between code points and bytes by one binary search and a sum: between two
exceptions all positions differ by the same number. Line cuts are found as bytes and told as code points,
code-point cuts are drawn as code points and made as bytes.

The draws are the first four 8-digit groups of the SHA-256 of `<seed>:<doc_id>`, so they depend on no
order or partition; one pass, no shuffle, and a worker holds a block of about 1 MB or one text.

Edge cases: a null text is an empty one, and empty texts are `plain`, as are those that hold a sentinel or
that `rate` leaves out; a null doc_id is hashed as if it were an empty text; repeated rows get equal results;
an empty table gives an empty one; a very long text is a block of its own, whose index is built piece by
piece; columns that share a name with a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .textscan import blocks

#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Bytes that are looked at together while an index is built.
PIECE = 1 << 20
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def places(data: np.ndarray, test) -> np.ndarray:
    """Positions where `test` holds, with masks of PIECE bytes at most."""
    found = [lo + np.flatnonzero(test(data[lo : lo + PIECE])) for lo in range(0, len(data), PIECE)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class ExceptionIndex:
    """Multibyte characters of some bytes: code-point positions, ends in bytes, and excess bytes before each."""

    point: np.ndarray
    end: np.ndarray
    excess: np.ndarray  # one longer: the last entry is the excess of all

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        lead = places(data, lambda b: b >= 0xC0)
        first = data[lead]
        more = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        excess = np.concatenate(([0], np.cumsum(more)))
        return cls(lead - excess[:-1], lead + 1 + more, excess)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.excess[np.searchsorted(self.point, points, side="left")]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """`at`: bytes where a character begins, or the end."""
        return at - self.excess[np.searchsorted(self.end, at, side="right")]


def line_cuts(data: np.ndarray, offsets: np.ndarray, index: ExceptionIndex):
    """(units of each text, function from (text, unit) to the byte where that many units end)."""
    ends = places(data, lambda b: b == 10) + 1
    first = np.searchsorted(ends, offsets, side="right")
    full = np.diff(first)
    start, stop = offsets[:-1], offsets[1:]
    closed = np.zeros(len(start), bool)
    some = stop > start
    closed[some] = data[stop[some] - 1] == 10
    n = full + (some & ~closed)
    known = np.append(ends, 0)

    def cut(k: np.ndarray) -> np.ndarray:
        inner = known[np.minimum(first[:-1] + k - 1, len(ends))]
        return np.where(k == 0, start, np.where(k >= n, stop, inner))

    return n, cut


def point_cuts(data: np.ndarray, offsets: np.ndarray, index: ExceptionIndex):
    points = index.to_points(offsets)
    return np.diff(points), lambda k: index.to_bytes(points[:-1] + k)


UNITS = {"line": line_cuts, "char": point_cuts}


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """No text part can complete a sentinel with the beginning of the next one."""
    heads = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or "" in sentinels or any(c in heads for s in sentinels for c in s[1:]):
        raise ValueError("sentinels must differ, and their first characters may stand nowhere else in them")
    return sentinels


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """`docs(doc_id, text, ...)` to the columns of `keep` (all) and n, form, prefix_chars, middle_chars, output.

    `rate` percent of the texts are transformed, `spm_rate` percent of them suffix first.
    """
    cuts, marks = UNITS[unit], [s.encode() for s in checked(sentinels)]
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (draw[2] % 100 >= rate)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    form = F.when(plain, "plain").when(draw[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(*keep, text.alias("_text"), draw[0].alias("_a"), draw[1].alias("_b"), form.alias("form"))
    schema = docs.select(*keep).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["_text"]):
                part = batch.slice(lo, hi - lo)
                index = ExceptionIndex.of(data)
                n, cut = cuts(data, offsets, index)
                a, b = (part[c].to_numpy() % (n + 1) for c in ("_a", "_b"))
                one, two = cut(np.minimum(a, b)), cut(np.maximum(a, b))
                begin, first, second = (index.to_points(x) for x in (offsets[:-1], one, two))
                forms = part["form"].to_pylist()
                text_, pieces = memoryview(data), []
                for f, i, j, k, e in zip(forms, offsets[:-1], one, two, offsets[1:], strict=True):
                    if f == "plain":
                        pieces += (text_[i:e],)
                    elif f == "psm":
                        pieces += (p, text_[i:j], s, text_[k:e], m, text_[j:k])
                    else:
                        pieces += (s, text_[k:e], p, text_[i:j], m, text_[j:k])
                moved = np.array([f != "plain" for f in forms])
                size = np.diff(offsets) + moved * sum(map(len, marks))
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                out = pa.StringArray.from_buffers(len(forms), pa.py_buffer(ends), pa.py_buffer(b"".join(pieces)))
                told = [pa.array(x, mask=~moved) for x in (first - begin, second - first)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(n), part["form"], *told, out], schema.names)

    return rows.mapInArrow(apply, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of the given form was made from."""
    part = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    piece = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut between lines; digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
l as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as ls, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(0, 4)] as r from d),
c as (select *, cast(len(ls) as bigint) as n, least(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) as a, greatest(r[1] % (len(ls) + 1), r[2] % (len(ls) + 1)) as b from l),
f as (select *, array_to_string(ls[1:a], '') as p, array_to_string(ls[a + 1:b], '') as m, array_to_string(ls[b + 1:n], '') as s,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from f
"""
