"""Queries over the driver's tables, each an operator on the alignment of ``bridge``, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import scalars
from blockloom.operators import annotate, blocks, columns, coverage, links, masks, norm, paf, plotstats, regions, rows, stats
from blockloom.plans.bridge import DUCK, alignment
from blockloom.sources import maf, taf, wiggle

SORT_BY, FILTER_BY = ["ref.", "g4.", "g2.", "g0."], ["g1.", "g3."]
PARENTS = {"ref.": None, "g0.": "ref.", "g1.": "ref.", "g2.": "g0.", "g3.": "g0.", "g4.": "g1."}
NAMES = [("ref", "human"), ("g0", "chimp"), ("g1.chr1", "gorilla.one"), ("g2", "mouse.m38")]
REGIONS = [(0, "ref.chr0", 5000, 5100), (1, "ref.chr1", 9000, 12000), (2, "ref.chr0", 5050, 5400)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the alignment's rows (and the session) under its name, with its SQL after the common tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(alignment(spark, sf_dir), spark)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = DUCK + sql
        return f

    return add


BASES = """,
c as (select cast(unnest(range(0, 32)) as bigint) as col),
b as (select a.*, col, substr(a.bases, cast(col + 1 as int), 1) as base from aln a, c),
ref as (select block_id, bases as rb, start as rs, length as rl, sequence_name as rn from aln where row_index = 0),
p as (select b.*, substr(rb, cast(col + 1 as int), 1) as ref_base, rn,
             rs + length(replace(substr(rb, 1, cast(col as int)), '-', '')) as ref_pos from b join ref using (block_id))"""
RANK = "cast(row_number() over (partition by block_id order by {}) - 1 as bigint) as row_index"
OUT = "sequence_name, start, length, strand, sequence_length, bases"


@query(""", q as (select block_id, max(length(bases)) as w, count(*) as n, sum(length(bases) - length) as gaps, sum(length) as bases from aln group by 1),
s as (select count(*) as blocks, cast(sum(w) as bigint) as columns, cast(sum(bases) as bigint) as bases, cast(sum(gaps) as bigint) as gaps, cast(sum(w * n) as bigint) as depth from q)
select blocks, columns, bases, gaps,
       cast(cast(cast(cast(columns as float) as double) / cast(cast(blocks as float) as double) as float) as double) as columns_per_block,
       cast(cast(cast(cast(depth as float) as double) / cast(cast(columns as float) as double) as float) as double) as column_depth,
       cast(cast(cast(cast(bases as float) as double) / cast(cast(columns as float) as double) as float) as double) as bases_per_column,
       cast(cast(cast(cast(gaps as float) as double) / cast(cast(columns as float) as double) as float) as double) as gaps_per_column from s""")
def stats_alignment(aln, spark):
    return stats.alignment_stats(aln)


@query(""", o as (select *, case when lag(sequence_name) over w = sequence_name and lag(start + length) over w = start then 0 else 1 end as new from aln where row_index = 0 window w as (order by block_id)),
g as (select *, sum(new) over (order by block_id) as island from o)
select min(sequence_name) as sequence_name, min(start) as start, max(start + length) as "end" from g group by island""")
def stats_intervals_bed(aln, spark):
    return stats.contiguous_intervals(aln)


@query(""", o as (select *, case when lag(sequence_name) over (order by block_id) = sequence_name then 0 else 1 end as new from aln where row_index = 0),
g as (select *, sum(new) over (order by block_id) as island from o)
select min(sequence_name) as sequence_name, arg_min(start, block_id) as start, cast(sum(length) as bigint) as length from g group by island""")
def ref_intervals_by_name(aln, spark):
    return stats.named_intervals(aln)


@query(" select sequence_name, arg_min(sequence_length, block_id) as sequence_length from aln where row_index = 0 group by 1")
def seq_lengths(aln, spark):
    return stats.sequence_lengths(aln)


SHARES = """, o as (select *, case when lag(sequence_name) over (order by block_id) = sequence_name then 0 else 1 end as new from aln where row_index = 0),
g as (select *, sum(new) over (order by block_id) as ord from o),
i as (select ord, min(sequence_name) as sequence_name, arg_min(start, block_id) as start, sum(length) as length from g group by 1),
j as (select *, sum(length) over (order by ord) - length as off, sum(length) over () as total from i),
sz as (select *, ceil(total / 7.0) as size from j),
s as (select *, unnest(range(0, 7)) as share from sz)
select cast(share as bigint) as share, cast(ord as bigint) as ord, sequence_name, cast(start + greatest(off, share * size) - off as bigint) as start,
       cast(least(off + length, (share + 1) * size) - greatest(off, share * size) as bigint) as length
from s where least(off + length, (share + 1) * size) > greatest(off, share * size)"""


@query(SHARES)
def interval_shares(aln, spark):
    broken = F.col("p.sequence_name") != F.col("sequence_name")
    runs = stats._islands(aln, broken).groupBy(F.col("island").alias("ord")).agg(F.first("sequence_name").alias("sequence_name"), F.min_by("start", "block_id").alias("start"), F.sum("length").alias("length"))
    return stats.interval_shares(runs, 7)


COVER = BASES + """,
n as (select *, case when instr(sequence_name, '.') > 1 then split_part(sequence_name, '.', 1) else sequence_name end as genome from p),
k2 as (select block_id, genome, count(*) as copies from (select distinct block_id, row_index, genome from n) group by 1, 2),
h as (select block_id, rn as contig, genome, col, ref_pos, max(case when base not in ('-', 'N') then 1 else 0 end) as al, max(case when base = ref_base then 1 else 0 end) as id
      from n where ref_base not in ('-', 'N') group by all),
rc as (select block_id, copies as ref_copies from k2 where genome = 'ref'),
m as (select h.*, (copies = 1 and ref_copies = 1) as single from h join k2 using (block_id, genome) join rc using (block_id)),
cc as (select contig, genome, cast(sum(al) as bigint) as aligned, cast(sum(id) as bigint) as identical, cast(sum(case when single then al else 0 end) as bigint) as single_aligned,
              cast(sum(case when single then id else 0 end) as bigint) as single_identical from m group by 1, 2),
len as (select rn as contig, arg_min(sequence_length, block_id) as ref_length from (select block_id, sequence_name as rn, sequence_length from aln where row_index = 0) group by 1),
gp as (select contig, genome, ref_pos - lag(ref_pos, 1, 0) over (partition by contig, genome order by block_id, col) - 1 as gap from m where al = 1),
lp as (select contig, genome, arg_max(ref_pos, block_id * 100 + col) as last from m where al = 1 group by 1, 2),
gg as (select * from gp where gap > 0 union all
       select contig, genome, ref_length - coalesce(last, 0) - 1 as gap from cc join len using (contig) left join lp using (contig, genome) where ref_length - coalesce(last, 0) - 1 > 0),
nm as ({names}),
ln as (select name, cast(sum(ref_length) as bigint) as ref_length from len join nm using (contig) group by 1),
ct as (select name, genome, cast(sum(aligned) as bigint) as aligned, cast(sum(identical) as bigint) as identical, cast(sum(single_aligned) as bigint) as single_aligned, cast(sum(single_identical) as bigint) as single_identical
       from cc join nm using (contig) group by 1, 2),
gn as (select name, genome, gap from gg join nm using (contig)),
th as ({limits}),
lx as (select th.name, th.max_gap, ct.genome, aligned, identical, single_aligned, single_identical, cast(th.ref_length - coalesce((select sum(gap) from gn where gn.name = th.name and gn.genome = ct.genome and gap > th.max_gap), 0) as bigint) as len
       from th join ct on th.name = ct.name)
select name as contig, max_gap, len, genome as query, case when len > 0 then aligned / len else 0.0 end as aln, case when aligned > 0 then identical / aligned else 0.0 end as ident,
       case when len > 0 then single_aligned / len else 0.0 end as single_aln, case when single_aligned > 0 then single_identical / single_aligned else 0.0 end as single_ident,
       aligned, identical, single_aligned, single_identical from lx where {which}"""
WHOLE = "select name, ref_length, ref_length as max_gap from ln"
LIMITS = "select distinct name, ref_length, max_gap from (select name, ref_length, unnest([10, 100, ref_length]) as max_gap from ln)"
TOTALS = "select contig, contig as name from len union all select contig, '_Total_' from len"
SEXES = TOTALS + " union all select contig, case when contig = 'ref.chr1' then '_Sex_Chroms_' else '_Autosomes_' end from len"


@query(COVER.format(names=TOTALS, limits=WHOLE, which="name <> '_Total_'"))
def coverage_by_contig(aln, spark):
    return coverage.coverage(aln).where("contig <> '_Total_'")


@query(COVER.format(names=TOTALS, limits=WHOLE, which="name = '_Total_'"))
def coverage_totals(aln, spark):
    return coverage.coverage(aln).where("contig = '_Total_'")


@query(COVER.format(names=SEXES, limits=WHOLE, which="true"))
def coverage_sex_autosome(aln, spark):
    return coverage.coverage(aln, sex=["ref.chr1"])


@query(COVER.format(names=TOTALS, limits=LIMITS, which="true"))
def coverage_gap_thresholds(aln, spark):
    return coverage.coverage(aln, thresholds=[10, 100])



@query(BASES + ", m as (select *, case when row_index > 0 and base = ref_base then '*' else base end as x from p), m2 as (select block_id, row_index, sequence_name, start, length, strand, sequence_length, col, x from m) select block_id, row_index, sequence_name, start, length, strand, sequence_length, string_agg(x, '' order by col) as bases from m2 group by 1, 2, 3, 4, 5, 6, 7")
def mask_reference(aln, spark):
    return masks.mask_reference(aln)


@query(BASES + """,
tree(child, parent) as (values ('g0.', 'ref.'), ('g1.', 'ref.'), ('g2.', 'g0.'), ('g3.', 'g0.'), ('g4.', 'g1.')),
n as (select b.*, concat(split_part(sequence_name, '.', 1), '.') as node from b),
above as (select distinct block_id, node as parent, col, base from n),
m as (select n.*, case when base <> '-' and a.base is not null then '*' else n.base end as x
      from (select n.*, t.parent from n left join tree t on n.node = t.child) n left join above a on a.block_id = n.block_id and a.parent = n.parent and a.col = n.col and a.base = n.base)
select block_id, row_index, sequence_name, start, length, strand, sequence_length, string_agg(x, '' order by col) as bases from m group by 1, 2, 3, 4, 5, 6, 7""".replace("case when base <> '-'", "case when n.base <> '-'"))
def mask_lineage(aln, spark):
    return masks.mask_lineage(aln, PARENTS)


@query(""" select block_id, row_index, case when starts_with(sequence_name, 'ref.') then concat('human', substr(sequence_name, 4)) when starts_with(sequence_name, 'g0.') then concat('chimp', substr(sequence_name, 3))
when sequence_name = 'g1.chr1' then 'gorilla.one' when starts_with(sequence_name, 'g2.') then concat('mouse.m38', substr(sequence_name, 3)) else sequence_name end as sequence_name, start, length, strand, sequence_length, bases from aln""")
def rename_genomes(aln, spark):
    return rows.rename(aln, spark.createDataFrame(NAMES, "old string, new string"))


@query(" select case when instr(sequence_name, '.') > 1 then split_part(sequence_name, '.', 1) else sequence_name end as genome, count(*) as n_rows from aln group by 1")
def genome_default(aln, spark):
    return aln.groupBy(scalars.default_genome(F.col("sequence_name")).alias("genome")).agg(F.count("*").alias("n_rows"))


@query(" select case when split_part(sequence_name, '.', 1) in ('ref', 'g2') then split_part(sequence_name, '.', 1) else '' end as genome, count(*) as n_rows from aln group by 1")
def genome_extract(aln, spark):
    return aln.groupBy(F.coalesce(scalars.genome_in(F.col("sequence_name"), ["ref", "g2"]), F.lit("")).alias("genome")).agg(F.count("*").alias("n_rows"))


NO_FILTER = "not (starts_with(sequence_name, 'g1.') or starts_with(sequence_name, 'g3.'))"
ORD = "case when starts_with(sequence_name, 'ref.') then 0 when starts_with(sequence_name, 'g4.') then 1 when starts_with(sequence_name, 'g2.') then 2 when starts_with(sequence_name, 'g0.') then 3 else -1 end"


@query(f" select block_id, {RANK.format('row_index')}, {OUT} from aln where {NO_FILTER} or row_index = 0")
def filter_prefix(aln, spark):
    return rows.filter_rows(aln, FILTER_BY)


@query(f", x as (select *, {ORD} as p from aln), y as (select *, row_number() over (partition by block_id, p order by row_index) as nth from x) select block_id, {RANK.format('row_index')}, {OUT} from y where p < 0 or nth = 1")
def dedupe_prefix(aln, spark):
    return rows.dedupe_rows(aln, SORT_BY)


PAD = """, pre(k, prefix) as (values (0, 'ref.'), (1, 'g4.'), (2, 'g2.'), (3, 'g0.')),
bl as (select block_id, max(row_index) as top from {src} group by 1),
miss as (select bl.block_id, top, k, prefix from bl, pre where not exists (select 1 from {src} a where a.block_id = bl.block_id and starts_with(a.sequence_name, prefix))),
padded as (select block_id, row_index, """ + OUT + """ from {src} union all
select block_id, cast(top + row_number() over (partition by block_id order by k) as bigint), prefix, cast(0 as bigint), cast(0 as bigint), true, cast(0 as bigint), repeat('-', 32) from miss)"""


@query(PAD.replace("{src}", "aln") + " select * from padded")
def pad_rows(aln, spark):
    return rows.pad_rows(aln, SORT_BY)


@query(f" select block_id, {RANK.format(f'row_index <> 0, {ORD}, sequence_name, strand desc, start, row_index')}, {OUT} from aln")
def sort_rows(aln, spark):
    return rows.sort_rows(aln, SORT_BY)


@query(f" select block_id, {RANK.format('row_index <> 0, sequence_name, strand desc, start, row_index')}, {OUT} from aln")
def sort_rows_by_name(aln, spark):
    return rows.sort_rows(aln)


@query(f", f as (select block_id, {RANK.format('row_index')}, {OUT} from aln where {NO_FILTER})" + PAD.replace("{src}", "f") + f""",
so as (select block_id, {RANK.format(f'{ORD}, sequence_name, strand desc, start, row_index')}, {OUT} from padded),
x as (select *, {ORD} as p from so), y as (select *, row_number() over (partition by block_id, p order by row_index) as nth from x) select block_id, {RANK.format('row_index')}, {OUT} from y where p < 0 or nth = 1""")
def sort_pipeline(aln, spark):
    return rows.sort_pipeline(aln, SORT_BY, FILTER_BY, pad=True, dedupe=True, keep_first=False)


@query(f" select block_id, {RANK.format('row_index')}, {OUT} from aln where {NO_FILTER}")
def filter_unpinned(aln, spark):
    return rows.filter_rows(aln, FILTER_BY, keep_first=False)


@query(BASES + """, u as (select block_id, col from b group by 1, 2 having bool_or(base <> '-')),
m as (select b.* from b join u using (block_id, col))
select block_id, row_index, sequence_name, start, length, strand, sequence_length, string_agg(base, '' order by col) as bases from m group by 1, 2, 3, 4, 5, 6, 7""")
def drop_all_gap_columns(aln, spark):
    return blocks.drop_all_gap_columns(aln)


@query(BASES + """, s as (select block_id, col, sum(new) over (partition by block_id order by col) - 1 as segment, min(col) over (partition by block_id, grp) as a from (
  select block_id, col, ref_base, case when lag(ref_base, 1, '-') over (partition by block_id order by col) = '-' and ref_base <> '-' then 1 else 0 end as new, 0 as grp
  from (select distinct block_id, col, ref_base from p)) where ref_base <> '-'),
m as (select b.*, segment from b join s using (block_id, col)),
a as (select block_id, segment, min(col) as first from s group by 1, 2),
g as (select block_id, segment, row_index, sequence_name, strand, sequence_length, start, string_agg(base, '' order by col) as part from m group by 1, 2, 3, 4, 5, 6, 7),
h as (select g.*, g.start + length(replace(substr(aln.bases, 1, cast(first as int)), '-', '')) as place, length(replace(part, '-', '')) as n from g join a using (block_id, segment) join aln using (block_id, row_index))
select block_id, cast(segment as bigint) as segment, cast(row_number() over (partition by block_id, segment order by row_index) - 1 as bigint) as row_index, sequence_name, cast(place as bigint) as start, cast(n as bigint) as length, strand, sequence_length, part as bases from h where n > 0""")
def unnormalize(aln, spark):
    return blocks.unnormalise(aln)


@query(" select * from aln where block_id in (select block_id from aln where row_index = 0 and sequence_name = 'ref.chr0' and start < 9000 and start + length > 5000)")
def region_extract(aln, spark):
    return regions.overlapping(aln, *regions.parse_region("ref.chr0:5000-9000"))


CLIP = BASES + """, w(ord, name, s, e) as (values {regions}),
hit as (select ref.*, ord, s, e from ref join w on rn = name and rs < e and rs + rl > s),
lim as (select hit.ord, hit.block_id, s > rs or rs + rl > e as cut,
   coalesce((select max(col) + 1 from p where p.block_id = hit.block_id and p.row_index = 0 and p.base <> '-' and p.ref_pos < s), 0) as a,
   coalesce((select min(col) from p where p.block_id = hit.block_id and p.row_index = 0 and p.base <> '-' and p.ref_pos >= e), 32) as z from hit),
m as (select lim.ord, lim.cut, a, z, aln.*, substr(bases, cast(a + 1 as int), cast(z - a as int)) as kept, length(replace(substr(bases, 1, cast(a as int)), '-', '')) as bef from aln join lim using (block_id))
select {ord} block_id, row_index, sequence_name, cast(start + bef as bigint) as start, cast(case when cut then length(replace(kept, '-', '')) else length end as bigint) as length, strand, sequence_length, kept as bases from m"""


@query(CLIP.format(regions="(0, 'ref.chr0', 5000, 9000)", ord=""))
def region_clip(aln, spark):
    return regions.clip(aln, "ref.chr0", 5000, 9000)


@query(CLIP.format(regions=", ".join(map(str, REGIONS)), ord="cast(ord as bigint) as ord,"))
def multi_region(aln, spark):
    return regions.clip_all(aln, spark.createDataFrame(REGIONS, "ord bigint, name string, region_start bigint, region_end bigint"))


COLS = BASES + ", x as (select block_id, col, ref_base, ref_pos, string_agg(base, '' order by row_index) as bases from p group by 1, 2, 3, 4)"


@query(COLS + " select block_id, col, bases, cast(ref_pos as bigint) as ref_pos, ref_base from x")
def columns_string(aln, spark):
    return columns.columns(aln)


@query(COLS + " select block_id, col, bases, cast(ref_pos as bigint) as ref_pos, ref_base from x where ref_base <> '-'")
def columns_reference_only(aln, spark):
    return columns.columns(aln, only_reference=True)


@query(BASES + " select block_id, col, string_agg(cast(case instr('ACGT-', base) when 0 then 5 else instr('ACGT-', base) - 1 end as varchar), ',' order by row_index) as codes from p group by 1, 2")
def columns_int(aln, spark):
    return columns.columns(aln).select("block_id", "col", F.array_join(columns.codes(F.col("bases")), ",").alias("codes"))


@query(BASES + ", e as (select block_id, col, row_index, case instr('ACGT-', base) when 0 then 5 else instr('ACGT-', base) - 1 end as code from p) select block_id, col, string_agg(rpad(repeat('0', cast(code as int)) || '1', 6, '0'), ',' order by row_index) as one_hot from e group by 1, 2")
def columns_onehot(aln, spark):
    text = F.array_join(F.transform(columns.one_hots(F.col("bases")), lambda v: F.array_join(v.cast("array<int>").cast("array<string>"), "")), ",")
    return columns.columns(aln).select("block_id", "col", text.alias("one_hot"))


@query(" select block_id, string_agg(right(bases, 1), '' order by row_index) as bases from aln group by 1")
def column_last(aln, spark):
    return columns.column_at(aln, -1)


WINDOW = COLS + """, o as (select row_number() over (order by block_id, col) - 1 as o, bases from x),
z as (select o, bases, unnest(range(0, cast(o // {step} as bigint) + 1)) as k from o),
v as (select o, bases, cast(k as bigint) as k from (select o, bases, o // {step} - i as k from o, (select unnest(range(0, {spread})) as i)) where k >= 0 and o < k * {step} + {length})
select k as window, string_agg(bases, '|' order by o) as bases from v group by 1 having count(*) = {length}"""


@query(WINDOW.replace("z as (select o, bases, unnest(range(0, cast(o // {step} as bigint) + 1)) as k from o),\n", "").format(length=16, step=16, spread=1))
def windows_tumbling(aln, spark):
    return columns.row_windows(aln, 16, 16).select("window", F.array_join("bases", "|").alias("bases"))


@query(WINDOW.replace("z as (select o, bases, unnest(range(0, cast(o // {step} as bigint) + 1)) as k from o),\n", "").format(length=10, step=4, spread=3))
def windows_sliding(aln, spark):
    return columns.row_windows(aln, 10, 4).select("window", F.array_join("bases", "|").alias("bases"))


TRACK = "select concat('ref.chr', cast(pos % 3 as {s})) as sequence_name, pos, cast(pos % 97 as double) / 4 as value from (select explode(sequence(0L, 60000L)) as pos)"
DUCK_TRACK = ", track as (select concat('ref.chr', cast(pos % 3 as varchar)) as sequence_name, pos, cast(pos % 97 as double) / 4 as value from (select unnest(range(0, 60001)) as pos))"


@query(COLS + DUCK_TRACK + """ select x.block_id, col, bases, cast(ref_pos as bigint) as ref_pos, coalesce('score:' || format('{:.6f}', value), '') as tag
from x join ref using (block_id) left join track on rn = sequence_name and ref_base <> '-' and pos = ref_pos""")
def annotate_wiggle(aln, spark):
    track = spark.sql(TRACK.format(s="string"))
    tagged = annotate.annotate(aln, track, "score")
    return tagged.select("block_id", "col", "bases", "ref_pos", F.array_join(F.transform("tags", lambda t: F.concat(t["key"], F.lit(":"), t["value"])), " ").alias("tag"))


@query(COLS + DUCK_TRACK + """ select x.block_id, col, coalesce(value, -1.0) as label from x join ref using (block_id) left join track on rn = sequence_name and ref_base <> '-' and pos = ref_pos""")
def column_tags_label(aln, spark):
    tagged = annotate.annotate(aln, spark.sql(TRACK.format(s="string")), "score")
    return tagged.select("block_id", "col", columns.tag_label(F.col("tags"), "score", -1.0).alias("label"))


@query(""" select concat('ref.chr', cast(block_id % 3 as varchar)) as sequence_name, 100 * block_id + case when block_id % 2 = 0 then 5 else 10 end * row_index + s as pos, cast(length as double) as value
from aln, (select unnest(range(0, 3)) as s) where s < case when block_id % 2 = 0 then 2 else 3 end""")
def wiggle_expand(aln, spark):
    """A track made of the alignment: a declaration for each block, a line for each row."""
    at, even = F.col("block_id") * 100 + 1, F.col("block_id") % 2 == 0
    chrom = F.concat(F.lit("chrom=chr"), F.col("block_id") % 3)
    declared = F.when(even, F.concat(F.lit("fixedStep "), chrom, F.lit(" start="), at, F.lit(" step=5 span=2"))).otherwise(F.concat(F.lit("variableStep "), chrom, F.lit(" span=3")))
    line = F.when(even, F.col("length").cast("string")).otherwise(F.concat_ws(" ", at + 10 * F.col("row_index"), "length"))
    heads = aln.where("row_index = 0").select((F.col("block_id") * 1024).alias("line_no"), declared.alias("value"))
    return wiggle.expand(heads.unionByName(aln.select((F.col("block_id") * 1024 + 1 + F.col("row_index")).alias("line_no"), line.alias("value"))), "ref.")


LINK = """, o as (select *, dense_rank() over (order by block_id) - 1 as ord, count(*) over (partition by block_id) as n from aln),
pr as (select r.*, l.block_id as lb, l.row_index as li, l.start + l.length as le, l.n as m, coalesce(l.strand = r.strand and l.start + l.length <= r.start and l.sequence_name = r.sequence_name, false) as ok
       from o r left join o l on l.ord = r.ord - 1 and l.row_index = r.row_index),
fs as (select *, bool_and(ok and n = m) over (partition by block_id) as fast from pr)"""


@query(LINK + " select block_id, row_index, lb as l_block_id, li as l_row_index from fs where fast")
def row_links_fast(aln, spark):
    return links.fast_links(aln)


@query(LINK + " select block_id, cast(sum(case when ok then 1 else 0 end) as bigint) as common, coalesce(max(case when ok then start - le end), 0) as max_gap from fs group by 1")
def common_rows(aln, spark):
    return links.common_rows(aln, same_index=True)


@query(LINK + " select block_id, row_index, start - le as gap from fs where ok")
def gap_lengths(aln, spark):
    return links.gap_lengths(aln, same_index=True)


@query(LINK + """, q as (select sequence_name as name, repeat(translate(md5(sequence_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), cast(ceil(max(sequence_length) / 32.0) as int)) as seq from aln group by 1)
select block_id, row_index, case when strand then substr(seq, cast(le + 1 as bigint), start - le) else translate(reverse(substr(seq, sequence_length - start + 1, start - le)), 'ACGT', 'TGCA') end as left_gap_sequence
from fs join q on sequence_name = name where ok and start > le and start - le <= 50""")
def gap_bases(aln, spark):
    return links.gap_bases(aln, _pieces(aln), 50, same_index=True, made=_invented())


def _invented():
    """Bases of one of ``_pieces``."""
    return f"repeat(translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT'), cast(least(n - piece * {links.PIECE}, {links.PIECE}) div 32 as int))"


def _pieces(aln):
    """The pieces of each sequence of the alignment, ``name, piece`` and the sequence's length ``n``."""
    size = links.PIECE
    ends = aln.groupBy(F.col("sequence_name").alias("name")).agg(F.max("sequence_length").alias("n")).withColumn("n", F.expr("cast(ceil(n / 32.0) as bigint) * 32"))
    return ends.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {size})")))


@query()
def row_links_diff(aln, spark):
    return links.diff_links(aln)


@query()
def common_rows_linked(aln, spark):
    return links.common_rows(aln)


@query()
def gap_lengths_linked(aln, spark):
    return links.gap_lengths(aln)


@query()
def gap_bases_linked(aln, spark):
    return links.gap_bases(aln, _pieces(aln), 50, made=_invented())


PAF = """, tg as (select * from aln {target}),
pp as (select q.block_id, t.row_index as target_row, q.row_index as query_row, q.sequence_name as query_name, q.sequence_length as query_length,
   case when q.strand then q.start else q.sequence_length - q.start - q.length end as query_start, q.length as ql, case when q.strand = t.strand then '+' else '-' end as strand,
   t.sequence_name as target_name, t.sequence_length as target_length, case when t.strand then t.start else t.sequence_length - t.start - t.length end as target_start, t.length as tl,
   case when t.strand then t.bases else reverse(t.bases) end as tb, case when t.strand then q.bases else reverse(q.bases) end as qb
   from tg t join aln q on t.block_id = q.block_id and q.row_index > t.row_index),
ev0 as (select block_id, target_row, query_row, i, substr(tb, i, 1) as t, substr(qb, i, 1) as q from (select *, cast(unnest(range(1, 33)) as int) as i from pp)),
ev as (select *, case when t <> '-' and q <> '-' then {match} when q <> '-' then 'I' else 'D' end as e from ev0 where t <> '-' or q <> '-'),
f as (select *, case when lag(e) over (partition by block_id, target_row, query_row order by i) = e and e <> '*' then 0 else 1 end as new from ev),
g as (select *, sum(new) over (partition by block_id, target_row, query_row order by i) as run from f),
h as (select block_id, target_row, query_row, run, min(e) as e, count(*) as n, string_agg(q, '' order by i) as q, string_agg(t, '' order by i) as t from g group by 1, 2, 3, 4),
j as (select block_id, target_row, query_row, string_agg({text}, '' order by run) as cigar, sum(n) as bl, sum(case when e in ('M', '*') then n else 0 end) as ma from h group by 1, 2, 3)
select pp.block_id, target_row, query_row, query_name, query_length, query_start, query_start + ql as query_end, strand, target_name, target_length, target_start, target_start + tl as target_end,
   cast(coalesce(ma, 0) as bigint) as matches, cast(coalesce(bl, 0) as bigint) as block_length, concat('{kind}', coalesce(cigar, '')) as cigar from pp left join j using (block_id, target_row, query_row)"""
COUNT_TEXT, BASE_TEXT = "concat(cast(n as varchar), e)", "case e when 'M' then concat('=', q) when '*' then concat('*', t, q) when 'I' then concat('+', q) else concat('-', t) end"


@query(PAF.format(target="where row_index = 0", match="'M'", text=COUNT_TEXT, kind="cg:Z:"))
def paf_all_to_one(aln, spark):
    return paf.pairs(aln)


@query(PAF.format(target="", match="'M'", text=COUNT_TEXT, kind="cg:Z:"))
def paf_all_to_all(aln, spark):
    return paf.pairs(aln, all_to_all=True)


@query(PAF.format(target="where row_index = 0", match="case when t <> q then '*' else 'M' end", text=BASE_TEXT, kind="cs:Z:").replace("string_agg(q, '' order by i) as q", "replace(string_agg(q, '' order by i), '-', '') as q").replace("string_agg(t, '' order by i) as t", "replace(string_agg(t, '' order by i), '-', '') as t"))
def paf_cs(aln, spark):
    return paf.pairs(aln, differences=True)


@query(""" select name, pos, "offset" from (
    with recursive a as materialized (select sequence_name as name, start as pos, block_id * 1000 as "offset" from aln where row_index = 0),
    e as (select name, min(pos) as pos from a group by name
          union all select e.name, (select min(a.pos) from a where a.name = e.name and a.pos >= e.pos + 500) as pos from e where e.pos is not null)
    select a.* from e join a on e.name = a.name and e.pos = a.pos)""")
def tai_build(aln, spark):
    anchors = aln.where("row_index = 0").select(F.col("sequence_name").alias("name"), F.col("start").alias("pos"), (F.col("block_id") * 1000).alias("offset"))
    return regions.build_index(anchors, 500)


@query(" select sequence_name as name, start as pos, block_id * 1000 as \"offset\" from aln where row_index = 0")
def tai_expand(aln, spark):
    anchors = aln.where("row_index = 0").select(F.col("sequence_name").alias("name"), F.col("start").alias("pos"), (F.col("block_id") * 1000).alias("offset"))
    return regions.expand_index(regions.index_lines(anchors))


@query(BASES + """, o as (select block_id, sum(rl) over (order by block_id) - rl as off from ref),
n as (select p.*, off, rs, split_part(sequence_name, '.', 1) as species from p join o using (block_id) join ref using (block_id) where row_index > 0 and ref_base <> '-')
select cast(floor((off + ref_pos - rs) / 500.0) as bigint) as bin, species, cast(sum(case when base <> '-' then 1 else 0 end) as bigint) as aligned, cast(sum(case when base <> '-' and (base = ref_base or base = '*') then 1 else 0 end) as bigint) as matched from n group by 1, 2""".replace("join ref using (block_id) where", "join (select block_id as bb, rs from ref) on bb = p.block_id where").replace("select p.*, off, rs", "select p.*, off, rs"))
def plot_bins(aln, spark):
    return plotstats.bins(aln, 500)


@query(BASES + """, o as (select block_id, sum(rl) over (order by block_id) - rl as off from ref),
n as (select p.*, off, rs, split_part(sequence_name, '.', 1) as species from p join o using (block_id) join (select block_id as bb, rs from ref) on bb = p.block_id where row_index > 0 and ref_base <> '-'),
bb as (select floor((off + ref_pos - rs) / 500.0) as bin, species, sum(case when base <> '-' then 1 else 0 end) as aligned, sum(case when base <> '-' and (base = ref_base or base = '*') then 1 else 0 end) as matched from n group by 1, 2)
select species, round(quantile_cont(aligned / 500.0, 0.5), 9) as median_coverage, round(avg(aligned / 500.0), 9) as mean_coverage, round(quantile_cont(case when aligned > 0 then matched / aligned end, 0.5), 9) as median_identity, round(avg(case when aligned > 0 then matched / aligned end), 9) as mean_identity from bb group by 1""")
def plot_bin_summary(aln, spark):
    s = plotstats.bin_summary(plotstats.bins(aln, 500), 500)
    return s.select("species", *(F.round(c, 9).alias(c) for c in s.columns[1:]))


@query(""", o as (select *, start - lag(start + length) over (partition by sequence_name, strand order by start, block_id, row_index) as gap from aln where row_index > 0),
g as (select *, sum(case when gap >= 0 and gap <= 30 then 0 else 1 end) over (partition by sequence_name, strand order by start, block_id, row_index) as run from o)
select sequence_name, strand, min(start) as start, max(start + length) as "end", count(*) as n_rows, cast(sum(length) as bigint) as aligned from g group by sequence_name, strand, run""")
def plot_runs(aln, spark):
    return plotstats.collinear_runs(aln, 30)


@query(""", s as (select split_part(sequence_name, '.', 1) as species, cast(sum(length) as bigint) as covered from aln where row_index > 0 group by 1)
select species, covered, row_number() over (order by covered desc, species) - 1 as rank from s qualify rank < 3""")
def species_topk(aln, spark):
    t = plotstats.top_species(plotstats.species_coverage(aln), 3)
    return t.withColumn("rank", F.col("rank").cast("long"))


@query(""", s as (select sequence_name, cast(sum(case when strand then 1 else 0 end) as bigint) as forward, cast(sum(case when strand then 0 else 1 end) as bigint) as backward, quantile_cont(start, 0.5) as median_start from aln where row_index > 0 group by 1)
select *, case when forward >= backward then '+' else '-' end as majority from s""")
def orientation(aln, spark):
    return plotstats.orientation(aln)


@query(""", o as (select distinct block_id from aln), n as (select block_id, row_number() over (order by block_id) - 1 as k from o) select aln.* from aln join n using (block_id) where k % 5 = 0""")
def block_sample(aln, spark):
    return plotstats.sample_blocks(aln, links.block_ordinals(aln), 5)


@query(""" select block_id, concat('a', chr(10), string_agg(concat_ws(chr(9), 's', sequence_name, cast(start as varchar), cast(length as varchar), case when strand then '+' else '-' end, cast(sequence_length as varchar), bases), chr(10) order by row_index), chr(10)) as value from aln group by 1""")
def maf_text(aln, spark):
    return maf.text(aln)


@query()
def taf_text(aln, spark):
    return taf.text(aln).select("block_id", "value")


@query(" select * from aln where row_index >= 0")
def taf_roundtrip(aln, spark):
    ids = links.block_ordinals(aln)
    back = taf.decode(taf.text(aln)).withColumnRenamed("block_id", "ordinal")
    return back.join(ids, "ordinal").select("block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length", "bases")


@query()
def norm_merge(aln, spark):
    return norm.merge_blocks(aln, norm.Policy(most_gap=60))


@query()
def greedy_prune(aln, spark):
    return norm.merge_blocks(aln, norm.Policy(most_gap=60, prune=True))


@query(COLS + ", rr as (select block_id, col, bases, regexp_extract_all(bases, '(A+|C+|G+|T+|N+|-+)') as runs from x) select block_id, col, array_to_string(list_transform(runs, lambda r: concat(r[1], ' ', cast(length(r) as varchar))), ' ') as value from rr")
def rle_columns(aln, spark):
    return columns.columns(aln).select("block_id", "col", scalars.run_length(F.col("bases")).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
