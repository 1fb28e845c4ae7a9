"""Genomics-shaped views of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments from lineitem: an order is a read, a line a segment.
SEGMENTS = """
with d as (select *, row_number() over (partition by l_orderkey, l_linenumber
             order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) rn from lineitem),
a as (select l_orderkey as qname, l_linenumber as ln,
  concat('chr', cast(((l_orderkey % 97) + case when l_linenumber = 5 then 1 else 0 end) % 3 + 1 as varchar(9))) as rname,
  case when (cast(floor(l_orderkey / 97) as bigint) % 4 = 0) <> (l_linenumber = 6) then 16 else 0 end as flag,
  cast(10000 + (l_orderkey % 97) * 8000 + l_linenumber * 600 + l_partkey % 7 as bigint) as pos,
  cast(case when l_returnflag = 'R' and l_linestatus = 'O' then 900 else 280 + cast(floor(l_quantity) as int) % 5 end as bigint) as length,
  cast(20 + 5 * cast(round(l_tax * 100) as int) as int) as mapq, 0.70 + 3 * l_discount as pid,
  cast(case when l_returnflag = 'A' and l_linenumber % 2 = 0 then 400 else 5 end as bigint) as pad
  from d where rn = 1),
b as (select *, pos + length - 1 as stop, cast(coalesce(sum(pad + length) over (partition by qname order by ln
        rows between unbounded preceding and 1 preceding), 0) + pad as bigint) as clip from a)
select qname, ln, rname, flag, pos, stop, length, mapq, pid, clip,
  cast((max(clip + length) over (partition by qname)) + case when qname % 5 = 0 then 30 else 0 end as bigint) as rlength,
  cast(case when ln = (max(ln) over (partition by qname)) and qname % 5 = 0 then 30 else 0 end as bigint) as clip_2
from b
"""

#: Alignments with long and short gaps, from the segments.
ALIGNMENTS = """
select qname, ln, rname, flag, pos - 1 as pos0, mapq,
  concat(cast(5 + ln as varchar(9)), 'S', cast(length as varchar(9)), 'M', cast(20 + qname % 25 as varchar(9)),
    case when ln % 2 = 0 then 'I' else 'D' end, cast(60 + ln as varchar(9)), 'M', cast(28 + pos % 5 as varchar(9)),
    case when ln % 3 = 0 then 'D' else 'I' end, cast(40 + qname % 7 as varchar(9)), 'M', cast(1 + qname % 4 as varchar(9)), 'H') as cigar,
  case when ln % 2 = 0 then concat(cast(length - 12 as varchar(9)), 'A', cast(50 + ln as varchar(9)), '^AC', cast(30 + qname % 9 as varchar(9))) end as md
from segments
"""

#: Alignments with bases and qualities, from the segments. Reads of a place share the reference position of an
#: X or MD mismatch, which four in nine show; some have an insertion, a deletion, a skipped stretch, a long gap.
READS = """
with r as (select *, cast(pos % 100 as int) as jit, 3 + ln as clip5, case when qname % 9 < 4 then 'X' else '=' end as mid, case when ln % 3 = 0 then 'I' else 'D' end as gap,
    2 + cast(qname % 4 as int) as small, 31 + cast(qname % 3 as int) as wide, cast(length as int) - 220 as tail from segments),
c as (select *, case when ln % 2 = 0 then 'M' else '=' end as eq, case when ln % 2 = 0 then 'M' else mid end as at_site from r)
select qname, ln, rname, flag, pos - 1 as pos0, mapq,
  concat(cast(clip5 as varchar(9)), 'S', cast(200 - jit as varchar(9)), eq, '1', at_site, '19', eq, cast(small as varchar(9)), gap, '8', eq,
    case when ln = 5 then concat(cast(wide as varchar(9)), 'D') when ln = 4 then '40N' else '' end, cast(tail as varchar(9)), eq, '2H') as cigar,
  case when ln % 2 = 0 then concat(case when mid = 'X' then concat(cast(200 - jit as varchar(9)), 'C', case when gap = 'D' then '19' else cast(27 + tail as varchar(9)) end)
      else case when gap = 'D' then cast(220 - jit as varchar(9)) else cast(228 - jit + tail as varchar(9)) end end,
    case when gap = 'D' then concat('^', repeat('G', small), cast(8 + tail as varchar(9))) else '' end) end as md,
  clip5 + 200 - jit as site, clip5 + 228 - jit + tail + case when gap = 'I' then small else 0 end as bases, mid
from c
"""

#: Bases and qualities of READS: digits of a hash, but one base for all that differ at the shared position.
BASES = """
select qname, ln, rname, flag, pos0, mapq, cigar, md, concat(substr(s, 1, site), case when mid = 'X' then 'T' else 'A' end, substr(s, site + 2)) as seq, q as qual_text
from (select *, substr(repeat(translate(md5(concat(cast(qname as varchar(20)), ';', cast(ln as varchar(9)))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 32), 1, bases) as s,
  substr(repeat(translate(md5(concat(cast(ln as varchar(9)), ';', cast(qname as varchar(20)))), 'abcdef', '789789'), 32), 1, bases) as q from reads)
"""

#: Asked positions: some around every place.
SPOTS = """
select distinct rname, pos - pos % 100 + o as pos from segments cross join (select 7 as o union all select 200 union all select 221 union all select 224 union all select 250 union all select 275) x
"""

#: Read bases at positions on a grid of 100, from lineitem.
PILEUP = """
with d as (select *, row_number() over (partition by l_orderkey, l_linenumber
             order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) rn from lineitem),
k as (select l_orderkey as qname, l_linenumber as ln, l_partkey, l_suppkey from d where rn = 1)
select s.rname as chr, s.pos - s.pos % 100 as pos, concat(cast(s.qname as varchar(20)), ';', cast(s.clip as varchar(20))) as seg_key,
  case k.l_partkey % 5 when 0 then 'A' when 1 then 'C' when 2 then 'G' when 3 then 'T' else '-' end as base, cast(k.l_suppkey % 40 as bigint) as qual
from segments s join k on s.qname = k.qname and s.ln = k.ln
"""

#: Sampled positions: 800 to a contig, 997 apart.
SAMPLE_STEP, SAMPLE_COUNT = 997, 800

#: Masked intervals from parts and suppliers.
MASKS = {
    "repeats": "select concat('chr', cast(p_partkey % 3 + 1 as varchar(9))) as rname, cast(10000 + (p_partkey * 7919) % 790000 as bigint) as start, cast(10000 + (p_partkey * 7919) % 790000 + 20 + p_size as bigint) as stop from part",
    "gaps": "select concat('chr', cast(s_suppkey % 3 + 1 as varchar(9))) as rname, cast(10000 + (s_suppkey * 104729) % 790000 as bigint) as start, cast(10000 + (s_suppkey * 104729) % 790000 + 500 as bigint) as stop from supplier",
}

#: Contigs from nations.
CONTIGS = "select n_name as rname, cast(1000 + 137 * n_nationkey as bigint) as length, n_nationkey as ord from nation"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The SQL over DataFrames in place of the names of its tables."""
    for name in tables:
        sql = sql.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name}", f"join {{{name}}}")
    return spark.sql(sql, **tables)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All windows are by parts of an order, so one shuffle by order serves them.
    return view(spark, SEGMENTS, lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, ALIGNMENTS, segments=segments(spark, sf_dir))


def pileup(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """`known`: the segments, where they were written."""
    return view(spark, PILEUP, lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"), segments=segments(spark, sf_dir) if known is None else known)


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READS with seq and qual (array<int>)."""
    rows = view(spark, BASES, reads=view(spark, READS, segments=segments(spark, sf_dir)))
    digits = F.filter(F.split("qual_text", ""), lambda x: x != "")
    return rows.select("qname", "ln", "rname", "flag", "pos0", "mapq", "cigar", "md", "seq", F.transform(digits, lambda x: x.cast("int") * 4).alias("qual"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, SPOTS, segments=segments(spark, sf_dir))


def mask(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = "part" if name == "repeats" else "supplier"
    return view(spark, MASKS[name], **{source: table(spark, sf_dir, source)})


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, CONTIGS, nation=table(spark, sf_dir, "nation"))
