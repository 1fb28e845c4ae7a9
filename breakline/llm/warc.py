"""WARC archives with a two-level capture index.

Writing: equal payloads are found by their SHA-1 with a grouping that combines on the map side; a
page is then a `response` or a `revisit` that refers to the smallest page_id of its payload. Each
task appends gzip members to a WARC file of its own in the shared folder and returns one capture per
record; the captures are a committed table, so a file that a lost or repeated task left behind is
never read. Index: captures are range-partitioned by key (host reversed, then path), sorted, and
written as gzip blocks of `BLOCK` lines; the directory keeps one row per block. A lookup cuts wanted keys
and directory at the same points, searches the directory slice by binary search, reads only the blocks
that may hold the key, searches those, and then reads the bytes of the records.

Edge cases: a null html is an empty payload; a null url has the empty key; rows with a null page_id
are responses and never referred to; rows that repeat the smallest page_id of a payload are all
responses; an empty table makes no file and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, saved, table

#: Captures per index block; records per file are bounded by ROTATE bytes.
BLOCK, ROTATE = 1000, 512 << 20
#: Directory rows of a slice of the lookup, slices at most, and characters of the key that a cut keeps.
SLICE, SPLITS, SPLIT_CHARS = 4, 4096, 64
#: A payload of fewer bytes is always a response.
MIN_PAYLOAD = 0
CAPTURE = "key string, page_id long, file string, offset long, length long"


def filesystem(uri: str):
    """pyarrow's file system and the path inside it, for any store that tasks can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def key_of(url: Column) -> Column:
    """`com,example,www)/path?query` in lower-case host, without scheme, user and port."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers: int | None) -> bytes:
    """One WARC/1.1 record with its two blank lines."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers is not None else head + payload
    own = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record, and its payload; the HTTP head's length stands for a revisit's payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return {"fields": fields, "payload": payload, "size": size}


def page_of(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn and urn.startswith("<urn:page:") else None


def with_refers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers (null for responses). Only payloads that repeat are kept to join."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    eligible = rows.where((F.octet_length("html") >= MIN_PAYLOAD) & F.col("page_id").isNotNull())
    first = saved(eligible.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "warc-repeated")
    joined = rows.join(maybe_broadcast(first, first.count()), "sha", "left")
    refers = F.when((F.col("page_id") != F.col("first")) & (F.octet_length("html") >= MIN_PAYLOAD), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers"))


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives below `path`; returns the committed captures (see CAPTURE)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = filesystem(path)
        store.create_dir(at, recursive=True)
        out, name, offset = None, "", 0
        for pdf in batches:
            rows = []
            for key, page_id, url, html, refers in zip(pdf.key, pdf.page_id, pdf.url, pdf.html, pdf.refers, strict=True):
                if out is None or offset >= ROTATE:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                page = None if pd.isna(page_id) else int(page_id)
                member = gzip.compress(record(page, url or "", html.encode("utf-8", "surrogatepass"), None if pd.isna(refers) else int(refers)), 5, mtime=0)
                out.write(member)
                rows.append((key, page, name, offset, len(member)))
                offset += len(member)
            yield pd.DataFrame({"key": [r[0] for r in rows], "page_id": pd.array([r[1] for r in rows], "Int64"), "file": [r[2] for r in rows], "offset": [r[3] for r in rows], "length": [r[4] for r in rows]})
        if out is not None:
            out.close()

    rows = with_refers(pages).select(key_of(F.col("url")).alias("key"), "page_id", "url", "html", "refers")
    return saved(rows.mapInPandas(write, CAPTURE), "warc-captures")


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Write sorted blocks below `path`; returns the sparse directory (first, last, file, offset, length, n)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = filesystem(path)
        store.create_dir(at, recursive=True)
        name, out, offset, lines, made = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def flush() -> None:
            nonlocal out, offset, lines
            out = out or store.open_output_stream(f"{at}/{name}", compression=None)
            block = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 6, mtime=0)
            out.write(block)
            made.append((lines[0][0], lines[-1][0], name, offset, len(block), len(lines)))
            offset, lines = offset + len(block), []

        for pdf in batches:
            for row in pdf[["key", "page_id", "file", "offset", "length"]].astype(object).itertuples(index=False):
                lines.append([None if pd.isna(x) else x for x in row])
                if len(lines) == BLOCK:
                    flush()
            if made:
                yield pd.DataFrame(made, columns=["first", "last", "file", "offset", "length", "n"])
                made = []
        if lines:
            flush()
        if out:
            out.close()
            yield pd.DataFrame(made, columns=["first", "last", "file", "offset", "length", "n"])

    # page_id joins the range key: one key may hold a third of all captures.
    n = max(1, captures.rdd.getNumPartitions())
    ordered = captures.repartitionByRange(n, "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "offset")
    return saved(ordered.mapInPandas(write, "first string, last string, file string, offset long, length long, n long"), "warc-directory")


def read_range(store, at: str, file: str, offset: int, length: int) -> bytes:
    with store.open_input_file(f"{at}/{file}") as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def split_points(directory: DataFrame) -> list[str]:
    """At most SPLITS sorted cuts of the key range (first SPLIT_CHARS characters of block keys), about SLICE blocks apart."""
    cut = F.substring("first", 1, SPLIT_CHARS)
    n = min(SPLITS, directory.count() // SLICE)
    if not n:
        return []
    ranked = directory.select(cut.alias("cut")).distinct().orderBy(F.xxhash64("cut"), "cut").limit(n)
    return sorted(r["cut"] for r in ranked.collect())


def find_captures(directory: DataFrame, path: str, keys: DataFrame) -> DataFrame:
    """Captures of the rows of `keys(key)`, read from the index blocks that the directory names.

    Key range and directory are cut at the same points; a block that spans several slices is in each. In a
    slice the directory rows come first and stay in memory, and each batch of wanted keys is found among them
    by binary search. Blocks hit are then read, each once per slice, and searched in the same way. A key with
    many captures has many blocks, which are dealt out on their own.
    """
    cuts = split_points(directory)
    told = directory.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def slice_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(told.value, k) for k in key], dtype="int64")

    blocks = directory.select(F.explode(F.sequence(slice_of("first"), slice_of("last"))).alias("slice"), F.lit(0).alias("kind"), F.col("first").alias("key"), "last", "file", "offset", "length")
    wanted = keys.where("key is not null").select("key").distinct()
    none = [F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("length")]
    both = blocks.unionByName(wanted.select(slice_of("key").alias("slice"), F.lit(1).alias("kind"), "key", *none))
    n = max(1, keys.rdd.getNumPartitions(), directory.rdd.getNumPartitions())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, parts, table_, firsts, lasts = None, [], None, None, None
        for pdf in batches:
            for at, group in pdf.groupby("slice", sort=False):
                if at != here:
                    here, parts, table_ = at, [], None
                own = group[group.kind == 0]
                if len(own):
                    parts.append(own)
                    table_ = None
                ask = group.loc[group.kind == 1, "key"].to_numpy(object)
                if not len(ask) or not parts:
                    continue
                if table_ is None:
                    table_ = pd.concat(parts, ignore_index=True)
                    firsts, lasts = table_.key.to_numpy(object), table_["last"].to_numpy(object)
                # Blocks are disjoint and in order: those of a key lie between the first that ends at it or
                # later and the last that starts at it or before.
                lo, hi = np.searchsorted(lasts, ask, "left"), np.searchsorted(firsts, ask, "right")
                for b in range(int(lo.min()), int(hi.max())):
                    hit = ask[np.searchsorted(hi, b, "right") : np.searchsorted(lo, b, "right")]
                    if len(hit):
                        row = table_.iloc[b]
                        yield pd.DataFrame({"file": [row.file], "offset": [row.offset], "length": [row.length], "keys": [hit.tolist()]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = filesystem(path)
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                rows = [json.loads(x) for x in read_range(store, at, b.file, b.offset, b.length).decode().split("\n")]
                names = [r[0] for r in rows]
                found = [r for k in b.keys for r in rows[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]]
                yield pd.DataFrame(found, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    hits = both.repartition(n, "slice").sortWithinPartitions("slice", "kind", "key", "last", "file", "offset").mapInPandas(search, "file string, offset long, length long, keys array<string>")
    return hits.repartition(n, "file", "offset").mapInPandas(read, CAPTURE)


def read_warc(captures: DataFrame, path: str) -> DataFrame:
    """Records of the captures: each file is opened once per stretch and read in order of offset."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = filesystem(path)
        open_name, source = None, None
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                if c.file != open_name:
                    if source is not None:
                        source.close()
                    open_name, source = c.file, store.open_input_file(f"{at}/{c.file}")
                source.seek(c.offset)
                got = parse(zlib.decompress(source.read(c.length), 31))
                f, kind = got["fields"], got["fields"]["WARC-Type"]
                named = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (digest(got["payload"]) != named or len(got["payload"]) != got["size"]):
                    raise ValueError(f"the payload of page {c.page_id} differs from its digest")
                rows.append((page_of(f["WARC-Record-ID"]), f["WARC-Target-URI"], got["size"], named, kind, page_of(f.get("WARC-Refers-To")), got["payload"].decode("utf-8", "surrogatepass") if kind == "response" else None))
            out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    spread = captures.withColumn("slice", F.floor(F.col("offset") / (8 << 20)))
    n = max(1, captures.rdd.getNumPartitions())
    return spread.repartition(n, "file", "slice").sortWithinPartitions("file", "offset").drop("slice").mapInPandas(read, schema)


def lookup(directory: DataFrame, index_path: str, warc_path: str, urls: DataFrame) -> DataFrame:
    """Records whose url has the key of a row of `urls(url)`, however many rows there are."""
    return read_warc(find_captures(directory, index_path, urls.select(key_of(F.col("url")).alias("key"))), warc_path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written with their index, looked up by their urls and read back from the archives."""
    path, index = new_path(spark, "warc"), new_path(spark, "warc-index")
    pages = table(spark, sf_dir, "pages")
    directory = write_index(write_warc(pages, path), index)
    return lookup(directory, index, path, pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INTEGER)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (hex)
"""
