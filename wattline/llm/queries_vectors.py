"""Queries for hard negatives and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm.negatives import mine
from wattline.llm.registry import query, table
from wattline.llm.whitening import whiten

NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor, a.label = b.label as alike, b.vec_id,
             list_dot_product(a.x, b.x)::bigint as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor, vec_id as positive_id, score as positive_score from s where alike
      qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5)
select p.anchor as anchor_id, positive_id,
       row_number() over (partition by p.anchor, positive_id order by s.score desc, s.vec_id)::int as rank,
       s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor = p.anchor and not s.alike
     and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
qualify rank <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 50 = 0")


@query("op13_whiten")
def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
