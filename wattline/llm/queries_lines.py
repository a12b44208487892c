"""Query for line deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.line_dedup import DISTANCE, LEAST, line_report
from wattline.llm.registry import query, table

#: DuckDB's edit distance counts bytes, as the operator does. The order of places within a document is that of its lines.
LINES_SQL = rf"""
with recursive s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select doc_id, i as line_no, parts[i + 1] as line from (select doc_id, parts, unnest(range(len(parts))) as i from s)),
m as (select *, strlen(line) as n, not regexp_matches(line, '[^\x20\x09-\x0D]') as blank from l),
f as (select line, any_value(n) as n, min((doc_id, line_no)) as first from m where not blank group by line),
p as (select a.first as a, b.first as b from f a join f b
      on b.n in (a.n, a.n + 1, a.n + 2) and a.line <> b.line
      where a.n >= {LEAST} and levenshtein(a.line, b.line) <= {DISTANCE}),
e as (select a, b from p union select b, a from p),
t(node, root) as (select a, a from e union select e.b, t.root from t join e on e.a = t.node),
k as (select node, min(root) as component from t group by node),
c as (select f.line, f.first, coalesce(k.component, f.first) as class from f left join k on k.node = f.first),
d as (select m.doc_id, m.n, m.blank, c.first = (m.doc_id, m.line_no) as first, c.class = (m.doc_id, m.line_no) as here
      from m left join c on not m.blank and m.line = c.line)
select doc_id, count(*) as n_lines, count(*) filter (blank or here) as n_kept,
       count(*) filter (not blank and not here and not first) as n_equal,
       count(*) filter (not blank and not here and first) as n_near,
       coalesce(sum(n) filter (blank or here), 0)::bigint as kept_bytes
from d group by doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
