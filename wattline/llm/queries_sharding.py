"""Query for sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm.registry import query, table
from wattline.llm.sharding import assign

#: Prefix sums over all rows in order; the CRC follows its bytewise table, which is computed from its polynomial.
SHARD_SQL = """
with t8(n, c) as (select n, n::bigint from range(256) r(n)),
crc as (select list(list_reduce(range(8), lambda a, _: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end, c) order by n) as bytes from t8),
d as (select doc_id, coalesce(text, '') as body from documents),
r as (select doc_id, sha256(body) as key, strlen(body)::bigint + 1 as size,
             xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::bigint),
                             lambda a, b: xor(a >> 8, bytes[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32
      from d, crc),
o as (select *, coalesce(sum(size) over (order by key, doc_id nulls first rows between unbounded preceding and 1 preceding), 0)::bigint as before,
             row_number() over (order by key, doc_id nulls first) - 1 as row from r),
g as (select key, min(before) * 8 as low, max(before + size) * 8 as high from o group by key),
n as (select sum(size)::bigint as total from r),
e as (select case when least(s * total - low, high - s * total) <= 0.01 * total
                  then case when s * total - low <= high - s * total then low else high end else s * total end as edge
      from n, range(1, 8) x(s), o join g using (key)
      where before * 8 < s * total and s * total <= (before + size) * 8),
a as (select o.*, (select count(*) from e where 2 * edge <= (2 * before + size) * 8) as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard::int as shard,
       (row_number() over (partition by shard order by row) - 1)::bigint as slot, null::int as grown_shard
from a
"""


@query("op11_shard", SHARD_SQL)
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), 8)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
