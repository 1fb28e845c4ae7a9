"""SQL for each registered query, for DuckDB on the driver's tables."""

from __future__ import annotations

from breakline.plans import fixtures as X


def _ctes(*parts: tuple[str, str]) -> str:
    return "with " + ",\n".join(f"{name} as ({sql.strip()})" for name, sql in parts) + "\n"


SEGMENTS = ("segments", X.SEGMENTS)
ALIGNMENTS = ("alignments", X.ALIGNMENTS)
PILEUP = ("pileup", X.PILEUP)

#: Operations of each alignment, one to a row.
OPS = (
    "ops",
    """
select qname, ln, flag, rname, pos0, mapq, md, i, ops[i] as o, cast(regexp_extract(ops[i], '\\d+') as bigint) as n, right(ops[i], 1) as op
from (select *, regexp_extract_all(cigar, '\\d+[MIDNSHP=X]') as ops, unnest(range(1, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) + 1)) as i from alignments)
""",
)
CLIPS = (
    "clips",
    """
select qname, ln, case when flag & 16 <> 0 then b else a end as clip, case when flag & 16 <> 0 then a else b end as clip_2
from (select *, coalesce(try_cast(nullif(regexp_extract(cigar, '^(\\d+)[SH]', 1), '') as bigint), 0) as a, coalesce(try_cast(nullif(regexp_extract(cigar, '(\\d+)[SH]$', 1), '') as bigint), 0) as b from alignments)
""",
)
CUT = (
    "cut",
    """
select *, op in ('D', 'I') and n >= 30 as sep,
  coalesce(sum(case when op in ('D', 'I') and n >= 30 then 1 else 0 end) over (partition by qname, ln order by i rows between unbounded preceding and 1 preceding), 0) as chunk
from ops
""",
)
CHUNKS = (
    "chunks",
    """
select qname, ln, chunk, any_value(flag) as flag, any_value(rname) as rname, any_value(pos0) as pos0, any_value(md) as md,
  sum(case when not sep and op in ('M', 'I', '=', 'X') then n else 0 end) as qal, sum(case when not sep and op in ('M', 'D', '=', 'X') then n else 0 end) as span,
  sum(case when not sep and op = 'M' then n else 0 end) as m, sum(case when not sep and op = '=' then n else 0 end) as eq, sum(case when sep and op = 'D' then n else 0 end) as d, sum(case when sep and op = 'I' then n else 0 end) as ins
from cut group by qname, ln, chunk
""",
)
SPLIT = (
    "split",
    """
select c.*, coalesce(sum(span + d) over w, 0) as ref_before, coalesce(sum(qal) over w, 0) as read_before, coalesce(sum(ins) over w, 0) as ins_before,
  (select sum(case when o2.op in ('M', 'I', '=', 'X') then o2.n else 0 end) from ops o2 where o2.qname = c.qname and o2.ln = c.ln) as total
from chunks c window w as (partition by qname, ln order by chunk rows between unbounded preceding and 1 preceding)
""",
)

READS = ("reads", "select *, count(*) over (partition by qname) as n_segments from segments qualify count(*) over (partition by qname) between 2 and 10")
ADJACENT = (
    "adjacent",
    """
select * from (select qname, clip, rname as rname1, case when flag & 16 <> 0 then pos else stop end as pos1, case when flag & 16 <> 0 then 16 else 0 end as flag1, mapq as mapq1, pid as pid1,
    cast(length as double) / rlength as plen1, lead(rname) over w as rname2, case when lead(flag) over w & 16 <> 0 then lead(stop) over w else lead(pos) over w end as pos2,
    case when lead(flag) over w & 16 <> 0 then 16 else 0 end as flag2, lead(mapq) over w as mapq2, lead(pid) over w as pid2, lead(cast(length as double) / rlength) over w as plen2,
    lead(clip) over w - (clip + length) as gap, rlength
  from reads window w as (partition by qname order by clip)) where rname2 is not null
""",
)
CANONICAL = (
    "canonical",
    """
select qname, clip, case when s then rname2 else rname1 end as rname1, case when s then pos2 else pos1 end as pos1, case when s then 16 - flag2 else flag1 end as flag1,
  case when s then mapq2 else mapq1 end as mapq1, case when s then pid2 else pid1 end as pid1, case when s then plen2 else plen1 end as plen1,
  case when s then rname1 else rname2 end as rname2, case when s then pos1 else pos2 end as pos2, case when s then 16 - flag1 else flag2 end as flag2,
  case when s then mapq1 else mapq2 end as mapq2, case when s then pid1 else pid2 end as pid2, case when s then plen1 else plen2 end as plen2, gap, rlength
from (select *, rname1 > rname2 or (rname1 = rname2 and pos1 > pos2) as s from adjacent)
""",
)
JUNCTIONS = (
    "junctions",
    """
select qname, clip, case when ins then 'INS' else 'BND' end as svtype, rname1, pos1, case when ins then 0 else flag1 end as flag1, mapq1, pid1, plen1,
  rname2, case when ins then pos1 + 1 else pos2 end as pos2, case when ins then 0 else flag2 end as flag2, mapq2, pid2, plen2, gap, rlength
from (select *, abs(pos2 - pos1) < gap as ins from canonical)
""",
)
L1 = (
    "l1",
    """
select * exclude (new), sum(new) over (partition by svtype, rname1, rname2, flag1, flag2 order by pos1, pos2, qname, clip rows unbounded preceding) as c1
from (select *, case when pos1 - lag(pos1) over (partition by svtype, rname1, rname2, flag1, flag2 order by pos1, pos2, qname, clip) <= 10 then 0 else 1 end as new from junctions)
""",
)
L2 = (
    "l2",
    """
select * exclude (new), sum(new) over (partition by svtype, rname1, rname2, flag1, flag2, c1 order by pos2, pos1, qname, clip rows unbounded preceding) as c2
from (select *, case when pos2 - lag(pos2) over (partition by svtype, rname1, rname2, flag1, flag2, c1 order by pos2, pos1, qname, clip) <= 10 then 0 else 1 end as new from l1)
""",
)
SVS = (
    "svs",
    """
select *, row_number() over (order by svtype, chr, chr2, flag1, flag2, pos_lo, end_lo, c1, c2) as sv_id from (
  select svtype, rname1 as chr, rname2 as chr2, flag1, flag2, c1, c2, count(*) as dv, cast(trunc(median(pos1)) as bigint) as pos, cast(trunc(median(pos2)) as bigint) as "end",
    min(pos1) as pos_lo, max(pos1) as pos_hi, min(pos2) as end_lo, max(pos2) as end_hi, cast(trunc(median(gap)) as bigint) as gap,
    cast(trunc(min(pos1) - median(pos1)) as bigint) as cipos_lo, cast(trunc(max(pos1) - median(pos1)) as bigint) as cipos_hi,
    cast(trunc(min(pos2) - median(pos2)) as bigint) as ciend_lo, cast(trunc(max(pos2) - median(pos2)) as bigint) as ciend_hi,
    string_agg(cast(qname as varchar), ',' order by cast(qname as varchar)) as alt_read_ids
  from l2 group by svtype, rname1, rname2, flag1, flag2, c1, c2 having count(*) >= 2)
""",
)
MEMBERS = ("members", "select s.sv_id, l.* from l2 l join svs s on l.svtype = s.svtype and l.rname1 = s.chr and l.rname2 = s.chr2 and l.flag1 = s.flag1 and l.flag2 = s.flag2 and l.c1 = s.c1 and l.c2 = s.c2")
HANGING = (
    "hanging",
    """
select rname, case when flag & 16 <> 0 then 'T' else 'H' end as side, case when flag & 16 <> 0 then stop else pos end as pos, qname, clip, mapq, pid, cast(length as double) / rlength as plength, rlength
from reads where clip >= 20 and clip = (select min(r.clip) from reads r where r.qname = reads.qname)
union all
select rname, case when flag & 16 <> 0 then 'H' else 'T' end, case when flag & 16 <> 0 then pos else stop end, qname, clip, mapq, pid, cast(length as double) / rlength, rlength
from reads where clip_2 >= 20 and clip = (select max(r.clip) from reads r where r.qname = reads.qname)
""",
)
HUNG = (
    "hung",
    """
select s.sv_id, b.bp_side, h.* from svs s cross join (values (0), (1)) b(bp_side) join hanging h
  on h.rname = s.chr and h.pos between s.pos_lo - 10 and s.pos_hi + 10
  and h.side = case when b.bp_side = 0 then case when s.flag1 = 0 then 'T' else 'H' end else case when s.flag2 = 16 then 'T' else 'H' end end
""",
)
ENDS = ("ends", 'select sv_id, 0 as bp_side, chr, pos_lo as lo, pos_hi as hi from svs union all select sv_id, 1, chr2, end_lo, end_hi from svs')
SPANNING = ("spanning", "select e.sv_id, e.bp_side, g.pos, g.qname, g.clip, g.mapq from ends e join segments g on g.rname = e.chr and e.lo > g.pos + 100 and e.hi < g.stop - 100")
SUPPORT = (
    "support",
    """
select s.sv_id, s.dv, coalesce(h.h0, 0) as hr_1, coalesce(h.h1, 0) as hr_2, coalesce(r.r0, 0) as dr_1, coalesce(r.r1, 0) as dr_2, m.own + coalesce(h.v, 0) as vo, coalesce(r.v, 0) as ro
from svs s join (select sv_id, sum((1 - pow(10.0, -mapq1 / 10.0)) + (1 - pow(10.0, -mapq2 / 10.0))) as own from members group by sv_id) m on m.sv_id = s.sv_id
left join (select sv_id, count(*) filter (where bp_side = 0) as h0, count(*) filter (where bp_side = 1) as h1, sum(1 - pow(10.0, -mapq / 10.0)) as v from hung group by sv_id) h on h.sv_id = s.sv_id
left join (select sv_id, count(*) filter (where bp_side = 0) as r0, count(*) filter (where bp_side = 1) as r1, sum(1 - pow(10.0, -mapq / 10.0)) as v from spanning group by sv_id) r on r.sv_id = s.sv_id
""",
)
LIKELY = (
    "likely",
    """
select *, [pow(10, c + vo * log10(0.001) + ro * log10(0.999)), pow(10, c + vo * log10(0.5) + ro * log10(0.5)), pow(10, c + vo * log10(0.9) + ro * log10(1 - 0.9))] as p
from (select *, (lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)) / ln(10) as c from (select *, floor(ro + vo) as n, floor(vo) as k from support))
""",
)
GENOTYPE = (
    "genotype",
    """
select sv_id, dv, hr_1, hr_2, dr_1, dr_2, vo, ro, ['0/0', '0/1', '1/1', './.'][best] as gt, pl, case when best = 4 then 0 else pl[second] end as gq, pl[1] as qual
from (select *, case when best = 4 then [0, 0, 0] else list_transform(raw, lambda x, i: case when i = best then 0 else x end) end as pl from (
  select *, case when list_sum(p) > 0 then list_position(raw, list_min(raw)) else 4 end as best, list_position(raw, list_sort(raw)[2]) as second from (
    select *, list_transform(p, lambda x: case when x / list_sum(p) > 0 then cast(trunc(-10 * log10(x / list_sum(p))) as integer) else 9999 end) as raw from likely)))
""",
)
MEDIANS = (
    "medians",
    """
select sv_id, cast(trunc(median(case when n = 1 then mapq end)) as bigint) as mapq_med1, cast(trunc(median(case when n = 2 then mapq end)) as bigint) as mapq_med2,
  median(case when n = 1 then pid end) as pid_med1, median(case when n = 2 then pid end) as pid_med2, median(case when n = 1 then plen end) as plen_med1, median(case when n = 2 then plen end) as plen_med2,
  cast(trunc(median(rlength)) as bigint) as rlength_med
from (select sv_id, 1 as n, pid1 as pid, mapq1 as mapq, plen1 as plen, rlength from members union all select sv_id, 2, pid2, mapq2, plen2, null from members
  union all select sv_id, 1, pid, mapq, plength, rlength from hung) group by sv_id
""",
)
DEPTH = ("sampled", f"""
select rname, position, (select count(*) from segments g where g.rname = c.rname and c.position between g.pos and g.stop) as depth
from (select 'chr' || n as rname, 10000 + k * {X.SAMPLE_STEP} as position from range(1, 4) a(n), range(0, {X.SAMPLE_COUNT}) b(k)) c
""")
REGIONS = (
    "regions",
    """
select s.sv_id, s.flag1 = 16 as is_dup, coalesce(sum(least(g.stop, greatest(s.pos, s."end")) - greatest(g.pos, least(s.pos, s."end")) + 1), 0) / cast(abs(s."end" - s.pos) + 1 as double) as mean_depth
from svs s left join segments g on g.rname = s.chr and g.pos <= greatest(s.pos, s."end") and g.stop >= least(s.pos, s."end")
where s.svtype = 'BND' and s.chr = s.chr2 and s.flag1 = s.flag2 group by s.sv_id, s.flag1, s.pos, s."end"
""",
)
PVALS = ("pvals", "select sv_id, is_dup, mean_depth, (select count(*) from sampled where case when is_dup then depth > mean_depth else depth < mean_depth end) / cast((select count(*) from sampled) as double) as pval from regions")
RETYPED = (
    "retyped",
    "select s.* exclude (svtype), case when p.pval < 0.05 then case when p.is_dup then 'DUP' else 'DEL' end else s.svtype end as svtype, p.pval as depth_pval from svs s left join pvals p on p.sv_id = s.sv_id",
)
LIVE = ("live", "select r.*, g.gt, g.pl, g.gq, g.qual, g.hr_1, g.hr_2, g.dr_1, g.dr_2, m.* exclude (sv_id) from retyped r join genotype g on g.sv_id = r.sv_id join medians m on m.sv_id = r.sv_id where g.gt <> '0/0'")
DENSITY = ("density", 'select a.sv_id, 1 + count(b.sv_id) as svcluster from live a left join live b on a.chr = b.chr and a.chr2 = b.chr2 and a.sv_id <> b.sv_id and abs(a.pos - b.pos) <= 1000 and abs(a."end" - b."end") <= 1000 group by a.sv_id')
MATES = (
    "mates",
    "select a.sv_id, max(b.sv_id) as mate_id from live a join live b on a.chr = b.chr and a.chr2 = b.chr2 and a.sv_id <> b.sv_id and abs(a.pos - b.pos) <= 300 and abs(a.\"end\" - b.\"end\") <= 300 and a.flag1 <> b.flag1 and a.flag2 <> b.flag2 where a.svtype = 'BND' and b.svtype = 'BND' group by a.sv_id",
)
FILTERS = (
    "filtered",
    """
select l.*, d.svcluster, t.mate_id, concat_ws(';', case when qual < 20 then 'LowQual' end, case when svcluster > 2 then 'SVcluster' end, case when gap > 100 and svtype <> 'INS' then 'GAP' end,
  case when mapq_med1 < 80 or mapq_med2 < 80 then 'MapQual' end, case when round(pid_med1, 3) < 0.8 or round(pid_med2, 3) < 0.8 then 'PID' end,
  case when abs(cipos_lo) + cipos_hi > 30 then 'CIPOS' end, case when abs(ciend_lo) + ciend_hi > 30 then 'CIEND' end) as filters
from live l join density d on d.sv_id = l.sv_id left join mates t on t.sv_id = l.sv_id
""",
)
ALT = """case when svtype <> 'BND' then '<' || svtype || '>' when flag1 = 16 and flag2 = 16 then ']' || chr2 || ':' || "end" || ']N' when flag1 = 16 then '[' || chr2 || ':' || "end" || '[N'
  when flag2 = 16 then 'N]' || chr2 || ':' || "end" || ']' else 'N[' || chr2 || ':' || "end" || '[' end"""
REF_IDS = ("ref_ids", """
select sv_id, string_agg(cast(qname as varchar), ',' order by pos, qname, clip) filter (where bp_side = 0) as a, string_agg(cast(qname as varchar), ',' order by pos, qname, clip) filter (where bp_side = 1) as b from spanning group by sv_id
""")

_JUNCTIONS = (SEGMENTS, READS, ADJACENT, CANONICAL, JUNCTIONS)
_SVS = (*_JUNCTIONS, L1, L2, SVS, MEMBERS)
_EVIDENCE = (*_SVS, HANGING, HUNG, ENDS, SPANNING, SUPPORT, LIKELY, GENOTYPE, MEDIANS)
_CALLED = (*_EVIDENCE, DEPTH, REGIONS, PVALS, RETYPED, LIVE, DENSITY, MATES, FILTERS)
_ALLELES = (
    SEGMENTS,
    PILEUP,
    ("counts", "select chr, pos, base, count(*) as n, count(*) filter (where qual >= 11) as highq from pileup group by chr, pos, base"),
    ("ranked", "select *, row_number() over (partition by chr, pos order by n desc, base) as r from counts where base <> '-'"),
    (
        "alleles",
        """
select t.chr, t.pos, t.total, t.deletions, a.base as base1, a.n as n1, a.highq as highq1, b.base as base2, b.n as n2, b.highq as highq2
from (select chr, pos, cast(sum(n) as bigint) as total, cast(sum(case when base = '-' then n else 0 end) as bigint) as deletions from counts group by chr, pos) t
left join ranked a on a.chr = t.chr and a.pos = t.pos and a.r = 1 left join ranked b on b.chr = t.chr and b.pos = t.pos and b.r = 2
""",
    ),
)
_PHASE = (
    *_EVIDENCE,
    PILEUP,
    ("het", "select s.* from svs s join genotype g on g.sv_id = s.sv_id where g.gt = '0/1'"),
    ("windows", 'select sv_id, 0 as bp_side, chr, flag1 as flag, case when flag1 = 16 then pos else pos - 7000 end as lo, case when flag1 = 16 then pos + 7000 else pos end as hi from het union all select sv_id, 1, chr2, flag2, case when flag2 = 16 then "end" - 7000 else "end" end, case when flag2 = 16 then "end" else "end" + 7000 end from het'),
    ("snps", "select chr, pos from pileup group by chr, pos having count(distinct base) >= 2"),
    ("ref_reads", "select sv_id, bp_side, cast(qname as varchar) || ';' || clip as seg_key, 0 as is_sv, pos, pos as a from spanning where sv_id in (select sv_id from het)"),
    ("reads_of", "select sv_id, bp_side, seg_key, max(is_sv) as is_sv, pos, stop from (select r.sv_id, r.bp_side, r.seg_key, r.is_sv, g.pos, g.stop from (select sv_id, bp_side, seg_key, is_sv from ref_reads) r join segments g on cast(g.qname as varchar) || ';' || g.clip = r.seg_key union select m.sv_id, b.bp_side, cast(m.qname as varchar) || ';' || m.clip, 1, g.pos, g.stop from members m cross join (values (0), (1)) b(bp_side) join segments g on g.qname = m.qname and g.clip = m.clip where m.sv_id in (select sv_id from het)) group by sv_id, bp_side, seg_key, pos, stop"),
    (
        "cells",
        """
select r.sv_id, r.bp_side, r.seg_key, r.is_sv, s.pos as snp, coalesce(c.base, case when case when (r.bp_side = 0) = (w.flag = 16) then r.stop < s.pos else r.pos > s.pos end then '-' else '=' end) as base
from windows w join snps s on s.chr = w.chr and s.pos between w.lo and w.hi join reads_of r on r.sv_id = w.sv_id and r.bp_side = w.bp_side
left join (select chr, pos, seg_key, max(base) as base from pileup group by chr, pos, seg_key) c on c.chr = s.chr and c.pos = s.pos and c.seg_key = r.seg_key
""",
    ),
)

#: Alignments with sequences under the name of the alignments, their operations with what lies before each.
WITH_BASES = ("reads", X.READS)
BASES = ("alignments", X.BASES)
PLACED = (
    "placed",
    """
select *, coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then n else 0 end) over w, 0) as ref_at, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then n else 0 end) over w, 0) as read_at
from ops window w as (partition by qname, ln order by i rows between unbounded preceding and 1 preceding)
""",
)
KEPT = (
    "kept",
    """
select s.qname, s.ln, s.rname, s.pos0 + cast(s.ref_before as bigint) + 1 as pos, s.pos0 + cast(s.ref_before + s.span as bigint) as stop,
  c.clip + cast(case when s.flag & 16 <> 0 then s.total - s.read_before - s.qal - s.ins_before else s.read_before + s.ins_before end as bigint) as clip
from split s join clips c on c.qname = s.qname and c.ln = s.ln join alignments a on a.qname = s.qname and a.ln = s.ln
left join (select qname, ln, sum(cast(x as bigint)) as matches from (select qname, ln, unnest(regexp_extract_all(md, '\\d+')) as x from alignments) group by qname, ln) t on t.qname = s.qname and t.ln = s.ln
where s.qal > 0 and a.mapq >= 20 and round(cast(case when s.md is not null then t.matches when round(s.eq / cast(s.qal as double), 3) = 0 then s.m else s.eq end as double) / s.qal, 3) >= 0.7
""",
)
_DISCOVERED = (
    SEGMENTS,
    WITH_BASES,
    BASES,
    OPS,
    CLIPS,
    CUT,
    CHUNKS,
    SPLIT,
    PLACED,
    KEPT,
    ("shown", "select qname, ln, ref_at + unnest(range(0, n)) as off, op = 'D' as gone from placed where op = 'D' or (op = 'X' and md is null)"),
    ("tokens", "select qname, ln, i, parts[i] as x from (select *, unnest(range(1, len(parts) + 1)) as i from (select qname, ln, regexp_extract_all(md, '\\d+|\\^[A-Za-z]+|[A-Za-z]') as parts from alignments where md is not null))"),
    (
        "md_at",
        """
select qname, ln, off from (select *, coalesce(sum(case when x[1] = '^' then length(x) - 1 when x[1] between '0' and '9' then cast(x as bigint) else 1 end)
  over (partition by qname, ln order by i rows between unbounded preceding and 1 preceding), 0) as off from tokens) where regexp_matches(x, '^[A-Za-z]$')
""",
    ),
    # No fixture read has a mismatch behind a skipped stretch, so offsets of MD are those of the reference.
    ("off_all", "select qname, ln, off, gone from shown union all select qname, ln, off, false from md_at"),
    (
        "called",
        """
select a.rname as chr, a.pos0 + 1 + cast(o.off as bigint) as pos, k.clip, case when o.gone then '-' else substr(a.seq, cast(p.read_at + o.off - p.ref_at as bigint) + 1, 1) end as base,
  case when not o.gone then 4 * cast(substr(a.qual_text, cast(p.read_at + o.off - p.ref_at as bigint) + 1, 1) as bigint) end as qual
from off_all o join alignments a on a.qname = o.qname and a.ln = o.ln join placed p on p.qname = o.qname and p.ln = o.ln and o.off >= p.ref_at and o.off < p.ref_at + p.n and p.op in ('M', 'D', '=', 'X')
join kept k on k.qname = o.qname and k.ln = o.ln and a.pos0 + 1 + o.off between k.pos and k.stop
""",
    ),
    ("counted", "select chr, pos, base, count(*) as n, count(*) filter (where qual >= 11) as highq from called group by chr, pos, base"),
    ("sites", "select chr, pos, sum(n) as called from counted group by chr, pos"),
    ("covered", "select s.chr, s.pos, s.called, (select count(*) from kept k where k.rname = s.chr and s.pos between k.pos and k.stop) as depth from sites s"),
    ("every", "select * from counted union all select chr, pos, '=', depth - called, depth - called from covered where depth > called"),
    ("ranked", "select *, row_number() over (partition by chr, pos order by n desc, base) as r from every where base <> '-'"),
    (
        "alleles",
        """
select t.chr, t.pos, t.total, t.deletions, a.base as base1, a.n as n1, a.highq as highq1, b.base as base2, b.n as n2, b.highq as highq2
from (select chr, pos, cast(sum(n) as bigint) as total, cast(sum(case when base = '-' then n else 0 end) as bigint) as deletions from every group by chr, pos) t
left join ranked a on a.chr = t.chr and a.pos = t.pos and a.r = 1 left join ranked b on b.chr = t.chr and b.pos = t.pos and b.r = 2
""",
    ),
)
_ACCEPT = "total >= 10 and deletions < 0.25 * total and highq1 / cast(n1 as double) > 0.6 and highq2 / cast(n2 as double) > 0.6 and n2 / cast(n1 + n2 as double) > 0.4"

_J = "qname, clip, rname1, pos1, flag1, mapq1, pid1, rname2, pos2, flag2, mapq2, pid2, gap, rlength"
_SV = 'svtype, chr, chr2, flag1, flag2, dv, pos, "end"'

SQL: dict[str, str] = {
    "split_cigar": _ctes(SEGMENTS, ALIGNMENTS, OPS, CLIPS, CUT, CHUNKS, SPLIT)
    + """select s.qname, s.ln, cast(s.chunk as bigint) as chunk, s.pos0 + cast(s.ref_before as bigint) + 1 as pos, s.pos0 + cast(s.ref_before + s.span as bigint) as stop, cast(s.qal as bigint) as length,
  c.clip + cast(case when s.flag & 16 <> 0 then s.total - s.read_before - s.qal - s.ins_before else s.read_before + s.ins_before end as bigint) as clip,
  c.clip_2 + cast(case when s.flag & 16 <> 0 then s.read_before else s.total - s.read_before - s.qal end as bigint) as clip_2
from split s join clips c on c.qname = s.qname and c.ln = s.ln where s.qal > 0""",
    "clip_extract": _ctes(SEGMENTS, ALIGNMENTS, CLIPS) + "select qname, ln, clip, clip_2 from clips",
    "pid_filter": _ctes(SEGMENTS, ALIGNMENTS, OPS, CUT, CHUNKS)
    + """, md as (select qname, ln, sum(cast(x as bigint)) as matches from (select qname, ln, unnest(regexp_extract_all(md, '\\d+')) as x from alignments) group by qname, ln),
  p as (select a.qname, a.ln, a.mapq, round(cast(case when a.md is not null then md.matches else t.m end as double) / t.qal, 3) as pid
    from alignments a join (select qname, ln, sum(case when op in ('M', 'I') then n else 0 end) as qal, sum(case when op = 'M' then n else 0 end) as m from ops group by qname, ln) t on t.qname = a.qname and t.ln = a.ln
    left join md on md.qname = a.qname and md.ln = a.ln)
  select qname, ln, mapq, pid from p where mapq >= 20 and pid >= 0.7""",
    "dedup_segments": "select l_orderkey as qname, l_linenumber as clip, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_shipdate desc) as rn from lineitem) where rn = 1",
    "read_split_filter": _ctes(SEGMENTS, READS) + "select qname, cast(n_segments as bigint) as n_segments, clip, pos from reads",
    "read_junctions": _ctes(SEGMENTS, READS, ADJACENT) + f"select {_J} from adjacent",
    "junction_canonical": _ctes(SEGMENTS, READS, ADJACENT, CANONICAL) + f"select {_J} from canonical",
    "junction_svtype": _ctes(*_JUNCTIONS) + f"select svtype, {_J} from junctions",
    "hanging_ends": _ctes(SEGMENTS, READS, HANGING) + "select rname, side, pos, qname, clip, mapq, rlength from hanging",
    "gap_cluster_l1": _ctes(*_JUNCTIONS, L1) + "select qname, clip, svtype, min(pos1) over w as cluster_start, cast(count(*) over w as bigint) as cluster_size from l1 window w as (partition by svtype, rname1, rname2, flag1, flag2, c1)",
    "gap_cluster_l2": _ctes(*_JUNCTIONS, L1, L2) + "select qname, clip, svtype, min(pos1) over w as start1, min(pos2) over w as start2, cast(count(*) over w as bigint) as cluster_size from l2 window w as (partition by svtype, rname1, rname2, flag1, flag2, c1, c2)",
    "sv_support": _ctes(*_SVS) + "select svtype, chr, chr2, flag1, flag2, dv, alt_read_ids from svs",
    "sv_medians": _ctes(*_EVIDENCE) + "select s.svtype, s.chr, s.chr2, s.pos, s.\"end\", m.mapq_med1, m.mapq_med2, round(m.pid_med1, 6) as pid_med1, round(m.pid_med2, 6) as pid_med2, round(m.plen_med1, 6) as plen_med1, round(m.plen_med2, 6) as plen_med2, m.rlength_med, s.gap from svs s join medians m on m.sv_id = s.sv_id",
    "sv_ci": _ctes(*_SVS) + f"select {_SV}, cipos_lo, cipos_hi, ciend_lo, ciend_hi from svs",
    "sv_hanging_join": _ctes(*_SVS, HANGING, HUNG) + "select sv_id, bp_side, rname, side, pos, qname, clip from hung",
    "ref_read_range_join": _ctes(*_SVS, ENDS, SPANNING) + "select sv_id, bp_side, pos, qname, clip, mapq from spanning",
    "sv_genotype": _ctes(*_EVIDENCE) + "select sv_id, dv, hr_1, hr_2, dr_1, dr_2, round(vo, 6) as vo, round(ro, 6) as ro, gt, array_to_string(pl, ',') as pl, gq, qual from genotype",
    "sv_density": _ctes(*_CALLED) + "select sv_id, cast(svcluster as bigint) as svcluster from density",
    "sv_mates": _ctes(*_CALLED) + "select sv_id, mate_id from mates",
    "sv_filters": _ctes(*_CALLED) + "select sv_id, svtype, filters from filtered",
    "sv_alt_notation": _ctes(*_CALLED) + f"select sv_id, {ALT} as alt, case when svtype = 'INS' then gap when chr = chr2 then \"end\" - pos end as svlen from filtered",
    "coverage_depth": _ctes(SEGMENTS, DEPTH) + "select rname, position, depth from sampled",
    "coverage_hist_pvalue": _ctes(*_SVS, DEPTH, REGIONS, PVALS) + "select sv_id, is_dup, round(mean_depth, 6) as mean_depth, round(pval, 9) as pval from pvals",
    "sv_depth_retype": _ctes(*_SVS, DEPTH, REGIONS, PVALS, RETYPED) + "select sv_id, chr, pos, \"end\", svtype from retyped",
    "ref_base_mode": _ctes(SEGMENTS, PILEUP) + "select chr as rname, pos, base as ref, n from (select chr, pos, base, count(*) as n, row_number() over (partition by chr, pos order by count(*) desc, base) as r from pileup where base <> '-' group by chr, pos, base) where r = 1",
    "bed_depth": _ctes(
        SEGMENTS,
        ALIGNMENTS,
        OPS,
        PLACED,
        ("repeats", X.MASKS["repeats"]),
        ("gaps", X.MASKS["gaps"]),
        ("asked", "select distinct rname, unnest(range(start, stop + 1)) as position from (select * from repeats union all select * from gaps)"),
        ("steps", "select rname, pos0 + 1 + ref_at as place, 1 as d from placed where op in ('M', '=', 'X') and n > 0 union all select rname, pos0 + 1 + ref_at + n, -1 from placed where op in ('M', '=', 'X') and n > 0"),
        ("running", "select rname, place, sum(sum(d)) over (partition by rname order by place) as depth from steps group by rname, place"),
    )
    + "select cast(coalesce(r.depth, 0) as bigint) as depth, cast(count(*) as bigint) as n from asked a asof left join running r on a.rname = r.rname and a.position >= r.place group by 1",
    "pileup_bases": _ctes(SEGMENTS, WITH_BASES, BASES, OPS, CLIPS, PLACED, ("spots", X.SPOTS))
    + """select s.rname, s.pos, p.qname, k.clip, case when p.op = 'D' then '-' when p.op = 'N' then '>' else substr(c.seq, cast(p.read_at + s.pos - p.pos0 - 1 - p.ref_at as bigint) + 1, 1) end as base,
  case when p.op not in ('D', 'N') then 4 * cast(substr(c.qual_text, cast(p.read_at + s.pos - p.pos0 - 1 - p.ref_at as bigint) + 1, 1) as bigint) end as qual
from placed p join spots s on s.rname = p.rname and s.pos > p.pos0 + p.ref_at and s.pos <= p.pos0 + p.ref_at + p.n join clips k on k.qname = p.qname and k.ln = p.ln join alignments c on c.qname = p.qname and c.ln = p.ln where p.op in ('M', 'D', 'N', '=', 'X')""",
    "snp_discovery": _ctes(*_DISCOVERED) + f"select *, cast(coalesce({_ACCEPT}, false) as integer) as accepted from alleles",
    "snp_allele_top2": _ctes(*_ALLELES) + "select * from alleles",
    "snp_accept": _ctes(*_ALLELES)
    + "select chr, pos, total, base1, base2 from alleles where " + _ACCEPT,
    "phase_matrix": _ctes(*_PHASE) + "select sv_id, bp_side, seg_key, is_sv, snp, base from cells",
    "phase_similarity": _ctes(*_PHASE)
    + """, pairs as (select a.sv_id, a.bp_side, a.seg_key as read_a, b.seg_key as read_b, count(*) filter (where a.base <> '-' or b.base <> '-') as n, count(*) filter (where a.base = b.base and a.base <> '-') as e
  from cells a join cells b on a.sv_id = b.sv_id and a.bp_side = b.bp_side and a.snp = b.snp and a.seg_key < b.seg_key group by 1, 2, 3, 4)
  select sv_id, bp_side, read_a, read_b, round(case when n > 0 then e / cast(n as double) else 0 end, 9) as similarity from pairs""",
    "mask_anti_join": _ctes(("repeats", X.MASKS["repeats"]), ("gaps", X.MASKS["gaps"]), ("masks", "select * from repeats union select * from gaps"), ("points", "select 'chr' || cast(o_orderkey % 3 + 1 as varchar) as rname, 10000 + (o_orderkey * 6151) % 790000 as position, o_orderkey from orders"))
    + "select rname, position, o_orderkey from points p where not exists (select 1 from masks m where m.rname = p.rname and p.position between m.start and m.stop)",
    "contig_asof_offset": _ctes(("contigs", X.CONTIGS), ("sums", "select *, sum(length) over (order by ord) as stop from contigs"), ("points", "select o_orderkey, (o_orderkey * 7919) % (select sum(length) from contigs) as r from orders"))
    + "select p.o_orderkey, s.rname, cast(p.r - (s.stop - s.length) + 1 as bigint) as position from points p asof join sums s on p.r < s.stop",
    "events_sessionize": """with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end as new from events),
  n as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
  select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, round(sum(value), 6) as total from n group by user_id, session""",
    "union_masks": _ctes(("repeats", X.MASKS["repeats"]), ("gaps", X.MASKS["gaps"])) + "select rname, start, stop from repeats union select rname, start, stop from gaps",
    "sv_call_flagship": _ctes(*_CALLED)
    + f"select sv_id, {_SV}, gt, gq, qual, dr_1, dr_2, hr_1, hr_2, round(depth_pval, 9) as depth_pval, cast(svcluster as bigint) as svcluster, mate_id, filters from filtered",
    "vcf_lines": _ctes(*_CALLED, REF_IDS)
    + f"""select f.sv_id, concat_ws(chr(9), chr, pos, f.sv_id, 'N', {ALT}, qual, case when filters = '' then 'PASS' else filters end,
  concat_ws(';', case when cipos_lo <> 0 or cipos_hi <> 0 or ciend_lo <> 0 or ciend_hi <> 0 then 'IMPRECISE' end, 'SVTYPE=' || svtype, 'SVMETHOD=breakline_0.1', case when svtype <> 'BND' then 'END=' || "end" end,
    'CIPOS=' || cipos_lo || ',' || cipos_hi, 'CIEND=' || ciend_lo || ',' || ciend_hi, 'SVLEN=' || case when svtype = 'INS' then gap when chr = chr2 then "end" - pos end, 'RT=0,0,0', 'GAP=' || gap,
    'MAPQ=' || mapq_med1 || ',' || mapq_med2, 'PID=' || format('{{:.3f}}', pid_med1) || ',' || format('{{:.3f}}', pid_med2), 'PLENGTH=' || format('{{:.3f}}', plen_med1) || ',' || format('{{:.3f}}', plen_med2),
    'RLENGTH=' || rlength_med, 'MATEID=' || mate_id, 'DEPTHPVAL=' || format('{{:.3f}}', depth_pval),
    'ALT_READ_IDS=' || alt_read_ids, 'REF_READ_IDS_1=' || coalesce(a, 'NA'), 'REF_READ_IDS_2=' || coalesce(b, 'NA')),
  'GT:DR:DV:GQ:HR:PL', gt || ':' || dr_1 || ',' || dr_2 || ':' || dv || ',' || dv || ':' || gq || ':' || hr_1 || ',' || hr_2 || ':' || array_to_string(pl, ',')) as line
from filtered f left join ref_ids r on r.sv_id = f.sv_id""",
}
