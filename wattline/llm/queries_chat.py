"""Query for chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.chat import format_turns, read_back
from wattline.llm.registry import query, table

#: A conversation whose texts look like marks of other templates.
EXTRA = r"\### Assistant: </turn> ok"

CHAT_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{EXTRA}' union all select -7, 1, 'assistant', '{EXTRA}'),
e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as shown,
             replace(replace(role, '\', '\\'), '<|', '<\|') as shown_role from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(8 + length(shown_role) + 8 + length(shown) + 8)::bigint as formatted_chars,
       0::bigint as n_attachments
from e group by conv_id
"""


@query("op7_chat_format", CHAT_SQL)
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoted = EXTRA.replace("\\", "\\\\")
    extra = spark.sql(
        f"select * from values (-7L, 0L, 'user', '{quoted}'), (-7L, 1L, 'assistant', '{quoted}') t(conv_id, turn, role, text)"
    )
    return read_back(format_turns(turns.union(extra)))
