"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

QUALITY_RULES = r"""
with d as (
    select doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
tri as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as c from tri) where c > 1),
covered as (
    select doc_id, count(distinct i + k) as n_repeat_words
    from twice, (values (0), (1), (2)) as o(k) group by doc_id),
ln as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
    select d.doc_id, host, cast(len(w) as bigint) as n_words,
           cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
           cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
           coalesce(n_lines, 0) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
           cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
    from d left join ln using (doc_id) left join covered using (doc_id)),
f as (
    select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
g as (
    select *, cast(base_failed as int) + cast(10 * n_symbols > n_words as int) + cast(10 * n_dup_lines > 3 * n_lines as int)
              + cast(word_chars < 3 * n_words or word_chars > 12 * n_words as int) as n_failed from f),
h as (select host, count(*) as n_docs, cast(sum(case when n_failed > 0 then 1 else 0 end) as bigint) as n_bad from g group by host),
p as (
    select m, greatest(2.0, least(10000.0, case when v > 0 and m > 0 and m < 1 then m * (1 - m) / v - 1 else 2.0 end)) as s
    from (select avg(n_bad / n_docs) as m, var_samp(n_bad / n_docs) as v from h)),
r as (select host, (n_bad + m * s) / (n_docs + s) as host_rate from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and host_rate <= 0.8 and case when host_rate >= 0.02 then n_failed = 0 else n_failed < 2 end) as kept,
       host, n_failed, round(host_rate, 9) as host_rate
from g join r using (host)
"""

WARC_FIXITY = r"""
with k as (select *, cast('0x' || substr(md5(cast(page_id as varchar)), 1, 2) as int) % 40 as k from pages),
b as (
    select page_id, url, case when k = 4 then concat('x', html) when k = 5 then reverse(html) else html end as html from k where k is null or k <> 3
    union all select page_id + 1000000000, url, html from k where k = 6),
rec as (
    select side, coalesce(page_id, -1) as page_id,
           concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', cast(coalesce(page_id, -1) as varchar), '>', chr(13), chr(10),
                  'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', cast(strlen(coalesce(html, '')) as varchar), chr(13), chr(10), chr(13), chr(10),
                  coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as r
    from (select 'a' as side, page_id, url, html from pages union all select 'b', page_id, url, html from b)),
leaf as (
    select side, page_id, count(*) as n_records, cast(sum(strlen(r)) as bigint) as length, min(sha256(r)) as lo, max(sha256(r)) as hi,
           bit_xor(cast('0x' || substr(sha256(r), 1, 15) as bigint)) as x from rec group by side, page_id),
d as (
    select side, page_id, n_records, length,
           case when n_records = 1 then lo else sha256(concat_ws('|', cast(n_records as varchar), lo, hi, cast(x as varchar), cast(length as varchar))) end as digest from leaf),
a as (
    select *, cast(floor(page_id / 4096.0) as bigint) as file_id,
           cast(coalesce(sum(length) over (partition by floor(page_id / 4096.0) order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
    from d where side = 'a'),
g as (select cast(floor(page_id / 16.0) as bigint) as range_id, sha256(string_agg(concat(cast(page_id as varchar), ':', digest), chr(10) order by page_id)) as range_digest from a group by 1),
j as (
    select coalesce(a.page_id, o.page_id) as page_id, a."offset", a.length, a.n_records, a.digest, o.digest as replica_digest
    from a full join (select * from d where side = 'b') o on a.page_id = o.page_id)
select page_id, cast(floor(page_id / 4096.0) as bigint) as file_id, coalesce("offset", -1) as "offset", coalesce(length, 0) as length,
       coalesce(n_records, 0) as n_records, coalesce(digest, '') as digest, coalesce(replica_digest, '') as replica_digest, coalesce(range_digest, '') as range_digest,
       case when digest is null then 'extra' when replica_digest is null then 'missing' when digest <> replica_digest then 'corrupt' else 'ok' end as status
from j left join g on g.range_id = cast(floor(page_id / 16.0) as bigint)
"""

EXACT_DEDUP = r"""
with d as (
    select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last)
"""

#: Components as whole numbers of the rows whose vectors count.
_WHOLE = """whole as (
    select row_number() over () as id, vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""

HARD_NEGATIVES = f"""
with {_WHOLE},
r as (select id, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from whole where label is not null),
s as (
    select a.id as anchor, a.vec_id as anchor_id, a.label = b.label as alike, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
    from r a, r b where a.vec_id % 50 = 0 and a.id <> b.id),
p as (
    select anchor, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, vec_id nulls last) as place
    from s where alike qualify place <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor, place order by score desc, vec_id nulls last) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor = s.anchor where not alike and 100 * score between 50 * positive_score and 95 * positive_score
qualify rank <= 3
"""


def _vector_codes() -> str:
    near = """near{k} as (
    select x.id, x.part, any_value(x.p) as p, min((cast(list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, e.p) + list_inner_product(e.p, e.p) as bigint), e.entry)) as best
    from x join e{k} e on x.part = e.part group by x.id, x.part)"""
    step = """e{j} as (
    select e.part, e.entry, coalesce(m.p, e.p) as p from e{k} e left join (
        select part, entry, list(mean order by place) as p from (
            select part, best[2] as entry, place, floor(cast(sum(p[place]) as double) / count(*)) as mean from near{k}, range(1, {cut} + 1) as c(place) group by part, best[2], place)
        group by part, entry) m on e.part = m.part and e.entry = m.entry)"""
    cut = "(select ceil(max(len(v)) / 16)::bigint from whole)"
    return f"""
with {_WHOLE},
x as (select id, cast(part as bigint) as part, v[cast(part * {cut} + 1 as bigint) : cast((part + 1) * {cut} as bigint)] as p from whole, range(16) as n(part)),
first64 as (select id, row_number() over (order by vec_id nulls last, v) - 1 as entry from whole qualify entry < 64),
e0 as (select part, entry, p from x join first64 using (id)),
{near.format(k=0)},
{step.format(k=0, j=1, cut=cut)},
{near.format(k=1)},
{step.format(k=1, j=2, cut=cut)},
{near.format(k=2)},
books as (select sha256(string_agg(array_to_string(list_transform(p, lambda c: cast(cast(c as bigint) as varchar)), ','), ',' order by part, entry)) as h from e2),
done as (select id, string_agg(lower(printf('%02x', cast(best[2] as int))), '' order by part) as code, cast(sum(best[1]) as bigint) as error from near2 group by id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select h from books) as codebooks_sha256
from done join whole using (id)
"""


VECTOR_CODES = _vector_codes()
