"""Query for license scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.licenses import COVERAGE, SLACK, scan, template_values
from wattline.llm.registry import query, table

SCAN_SQL = rf"""
with t(template, label, base, pairs, place, pair) as ({template_values()}),
d as (select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select doc_id, i - 1 as pos, w[i] || ' ' || w[i + 1] as pair
      from (select doc_id, w, unnest(range(1, len(w))) as i from d)),
v as (select doc_id, template, label, base, pairs, pos - place as diagonal, bit_or(1::bigint << place) as seen
      from g join t using (pair) group by all),
m as (select *, case when not base and diagonal - lag(diagonal) over line <= {SLACK} then 0 else 1 end as starts
      from v window line as (partition by doc_id, template order by diagonal)),
n as (select *, sum(starts) over (partition by doc_id, template order by diagonal) as span from m),
s as (select doc_id, label, base, min(diagonal) as start, bit_count(bit_or(seen))::double / pairs as share
      from n group by doc_id, template, label, base, pairs, span),
f as (select * from s where case when base then share = 1 else share >= {COVERAGE} end),
r as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word,
             max(start) filter (base) as last_word,
             string_agg(distinct label, ',' order by label) filter (base) as base_labels,
             string_agg(distinct label, ',' order by label) as labels, max(share) as score
      from f group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join r using (doc_id)
"""


@query("op1_license_scan", SCAN_SQL)
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
