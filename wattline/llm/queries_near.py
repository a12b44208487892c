"""Query for near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.near_dedup import near_duplicates
from wattline.llm.registry import query, table

#: Distinct shingles meet in a join, so pairs that share one are counted exactly.
NEAR_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w
  from documents),
g as (select distinct doc_id, array_to_string(case when len(w) < 5 then w else w[i:i + 4] end, ' ') as shingle
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select doc_id, md5(string_agg(shingle, chr(10) order by shingle)) as class, count(*) as n from g group by doc_id),
r as (select class, min(doc_id) as rep, any_value(n) as n from c group by class),
h as (select g.shingle, r.rep, r.n from g join r on g.doc_id = r.rep),
p as (select a.rep as a, b.rep as b from h a join h b on a.shingle = b.shingle and a.rep < b.rep
      where 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
      group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
t(node, root) as (select rep, rep from r union select e.b, t.root from t join e on e.a = t.node),
k as (select node, min(root) as component from t group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.component, d.doc_id) as component_id,
       coalesce(k.component, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c using (doc_id) left join r on c.class = r.class
left join k on k.node = r.rep
"""


@query("op3_minhash", NEAR_SQL)
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
