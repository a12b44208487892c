"""Queries for exact deduplication and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.exact_dedup import exact_dedup
from wattline.llm.mixing import mix
from wattline.llm.registry import query, table
from wattline.llm.text import LOWER, UPPER

EXACT_SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""

MIX_SQL = r"""
with d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         (('0x' || md5('17:' || doc_id)[1:13])::bigint::double + 0.5) / 4503599627370496.0 as u
  from documents),
q as (select doc_id, max(quality) as quality from labels where quality is not null group by doc_id),
k as (select d.*, -ln(u) / case when quality > 0 then 2.0::double when quality <= 0 then 0.5::double else 1.0::double end as key
      from d left join q using (doc_id)),
s as (select source, sum(size)::bigint as source_size,
             row_number() over (order by source nulls last) - 1 as rank from k group by source),
w as (select *, [1, 2, 3][rank % 3 + 1] as weight, source_size * 3 as cap from s),
f as (select *, coalesce(sum(cap) over (order by cap / weight::double, rank rows between unbounded preceding and 1 preceding), 0) as taken_before,
             sum(weight) over (order by cap / weight::double, rank rows between current row and unbounded following) as weight_left,
             sum(source_size) over () as total from w),
h as (select *, max((total - taken_before)::double / weight_left) over () as share from f),
t as (select source, source_size, least(cap::double, weight * share) as target from h),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
o as (select k.doc_id, k.size, e.source_size, e.target, e.epochs,
             sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) as upto
      from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when upto - size / 2.0::double <= target - epochs * source_size
                               and target - epochs * source_size > 0 then 1 else 0 end))::bigint as taken
from o
"""


@query("op4_exact_dedup", EXACT_SQL)
def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_mix_sources", MIX_SQL)
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
