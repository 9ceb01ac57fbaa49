"""SQL that must give the same rows as the queries, where SQL can express them."""

SQL: dict[str, str] = {}

_SIZED = r"""
sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                 md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as h
          from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (select source, source_size, 2.0::double * source_size as most,
                   case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
            from sources),
ladder as (select *, most / w as step,
                  coalesce(sum(most) over (order by most / w, source rows between unbounded preceding and 1 preceding), 0) as used,
                  sum(w) over (order by most / w, source rows between current row and unbounded following) as open_w
           from weighed),
rise as (select (1.5::double * (select sum(source_size) from sources) - used) / open_w as lvl from ladder
         where (1.5::double * (select sum(source_size) from sources) - used) / open_w <= step order by step, source limit 1),
aimed as (select source, source_size, least(most, w * coalesce((select lvl from rise), 1e300)) as target,
                 cast(('0x' || left(md5('mix:' || coalesce(source, 'null')), 13)) as bigint)::double / 4503599627370496.0::double as start
          from weighed),
dealt as (select *, (row_number() over (partition by source order by size desc, h) - 1) // 4 * 4 as stratum from sized),
placed as (select *, stratum + row_number() over (partition by source, stratum order by h, size desc) - 1 as k from dealt),
mixed as (select p.doc_id, p.source, p.size, a.source_size, a.target, a.start, p.k,
                 case when a.source_size > 0 then a.target / a.source_size else 0 end as rate
          from placed p join aimed a on p.source is not distinct from a.source)
"""

SQL["op8_mix_sources"] = f"""
with {_SIZED}
select doc_id, size, source_size, target,
       cast((floor(rate) + floor(start + (k + 1) * (rate - floor(rate))) - floor(start + k * (rate - floor(rate)))) * size as bigint) as taken
from mixed
"""

SQL["op13_stream_dedup"] = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n from documents)
select doc_id, max(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
       row_number() over (partition by n order by doc_id desc nulls last) = 1 as kept, sha256(n) as text_sha256
from t
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op11_lexical_search"] = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as terms from documents),
s as (select r, doc_id, cast(len(terms) as bigint) as n from d where len(terms) > 0),
g as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_terms from s),
tf as (select r, t, cast(count(*) as bigint) as tf from (select r, unnest(terms) as t from d) group by r, t),
w as (select t, cast(floor(1000 * ln(cast(2 * (select n_docs from g) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf group by t),
i as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
x as (select i.item_id, s.doc_id, s.r, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * s.n * (select n_docs from g)) // (select n_terms from g))))) as bigint) as score
      from i join tf using (t) join w using (t) join s on s.r = tf.r group by all),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
