"""Landed files written from the test tables, then scanned.

Files hold quarter-hour means, so one weekly chunk has at most 672 points
however many events there are.
"""

from pyspark.sql import functions as F

from checks.fixtures import points_long, with_views
from checks.registry import query
from wattline.session import scratch_path, settle
from wattline.sources import increments, landing_json, landing_xml, tables

START, END = "2024-01-03", "2024-01-24"

# Event kinds stand in for the five feed series.
NAMES = {
    "view": "price_da_eur_mwh", "click": "wind_onshore_mwh", "signup": "wind_offshore_mwh", "purchase": "solar_mwh",
    "error": "load_mwh",
}
XML_KINDS = {
    "view": ("A44", "-"), "click": ("A75", "B19"), "signup": ("A75", "B18"), "purchase": ("A75", "B16"),
    "error": ("A65", "-"),
}

_SLOT = "(epoch_us(utc_timestamp) // 900000000)"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())
_SLOTS = f"""
slots AS (
  SELECT zone, CASE series {_CASES} END AS series, {_SLOT} AS slot,
    cast(floor(sum(value_c) / count(*)) AS bigint) AS v
  FROM points_long WHERE series IN ({", ".join(f"'{k}'" for k in NAMES)}) GROUP BY ALL),
points AS (SELECT zone, series, make_timestamp(slot * 900000000) AS utc_timestamp, cast(v AS double) AS value FROM slots)"""
_WINDOW = f"utc_timestamp BETWEEN timestamp '{START} 00:00:00' AND timestamp '{END} 23:59:00'"


def _slots(spark, sf_dir):
    known = points_long(spark, sf_dir).filter(F.col("series").isin(*NAMES))
    return known.groupBy(
        "zone", "series", F.expr("unix_micros(cast(utc_timestamp as timestamp)) div 900000000").alias("slot")
    ).agg(F.floor(F.sum("value_c") / F.count(F.lit(1))).alias("v"))


def _name(kind, names):
    expr = None
    for key, value in names.items():
        expr = F.when(kind == key, value) if expr is None else expr.when(kind == key, value)
    return expr


def _chunks(spark, sf_dir):
    week = 7 * 96
    chunks = (
        _slots(spark, sf_dir)
        .withColumn("chunk", F.expr(f"slot div {week}"))
        .groupBy("zone", "series", "chunk")
        .agg(F.sort_array(F.collect_list(F.array((F.col("slot") * 900000).cast("double"), F.col("v").cast("double")))).alias("points"))
    )
    ids = {kind: landing_json.SERIES_IDS[name] for kind, name in NAMES.items()}
    return chunks.select(
        F.col("points").alias("series"),
        _name(F.col("series"), ids).alias("series_id"),
        "zone",
        (F.col("chunk") * week * 900000).alias("chunk_ms"),
    )


def _land_json(spark, sf_dir):
    path = scratch_path(spark, "landing-json")
    _chunks(spark, sf_dir).write.partitionBy("series_id", "zone", "chunk_ms").json(path)
    return path


@query("scan_json_chunks", with_views(
    f"SELECT zone, series, utc_timestamp, value FROM points WHERE {_WINDOW}", "points_long", steps=_SLOTS))
def scan_json_chunks(spark, sf_dir):
    return landing_json.scan_chunks(spark, _land_json(spark, sf_dir), START, END, partitioned=True).drop("chunk_ms")


@query("landing_rejects", with_views(
    """SELECT zone, CAST(-1 AS bigint) AS series_id, count(DISTINCT slot // 672) AS n_files, 'unknown series' AS reason
    FROM slots WHERE series = 'wind_offshore_mwh' GROUP BY zone
    UNION ALL
    SELECT zone, CAST(4169 AS bigint), count(DISTINCT slot // 672), 'payload not readable' FROM slots
    WHERE series = 'price_da_eur_mwh' AND zone = 'Z2' GROUP BY zone""", "points_long", steps=_SLOTS))
def landing_rejects(spark, sf_dir):
    """Chunks under an unknown id, and cut-off payloads of one zone's prices."""
    path = scratch_path(spark, "landing-rejects")
    body = F.to_json(F.struct("series"))
    cut = (F.col("series_id") == landing_json.SERIES_IDS["price_da_eur_mwh"]) & (F.col("zone") == "Z2")
    unknown = F.col("series_id") == landing_json.SERIES_IDS["wind_offshore_mwh"]
    chunks = _chunks(spark, sf_dir).withColumn("body", body)
    chunks.select(
        F.when(cut, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body")).alias("value"),
        F.when(unknown, -1).otherwise(F.col("series_id")).alias("series_id"),
        "zone",
        "chunk_ms",
    ).write.partitionBy("series_id", "zone", "chunk_ms").text(path)
    rejects = landing_json.scan_rejects(spark, path, partitioned=True)
    return rejects.groupBy("zone", F.col("series_id").cast("bigint").alias("series_id"), "reason").agg(
        F.count(F.lit(1)).alias("n_files"))


def _market_sql(hourly: str, series: list[str], until: str) -> str:
    columns = ", ".join(f"max(value) FILTER (series = '{s}') AS {s}" for s in series)
    return f"""SELECT zone, h AS utc_timestamp, {columns} FROM ({hourly}) GROUP BY 1, 2
      HAVING h BETWEEN timestamp '{START} 00:00:00' AND timestamp '{END} {until}'"""


_GRID = """
grid AS (
  SELECT zone, series, unnest(generate_series(date_trunc('hour', min(utc_timestamp)), date_trunc('hour', max(utc_timestamp)),
                                              interval 1 hour)) AS h FROM inside GROUP BY 1, 2),
hourly AS (
  SELECT zone, series, date_trunc('hour', utc_timestamp) AS h, avg(value) AS m, sum(value) AS s FROM inside GROUP BY 1, 2, 3)"""
_SERIES = list(landing_json.SERIES_IDS)


@query("market_from_json", with_views(
    _market_sql("""SELECT zone, series, h,
        CASE WHEN series LIKE '%eur%' THEN round(m, 6) ELSE coalesce(s, 0) END AS value
      FROM grid LEFT JOIN hourly USING (zone, series, h)""", _SERIES, "23:59:00"),
    "points_long", steps=f"{_SLOTS.strip()},\ninside AS (SELECT * FROM points WHERE {_WINDOW}),{_GRID}"))
def market_from_json(spark, sf_dir):
    market = landing_json.market_table(spark, _land_json(spark, sf_dir), START, END, partitioned=True)
    return market.withColumn("price_da_eur_mwh", F.round("price_da_eur_mwh", 6))


@query("ingest_increment", with_views(
    _market_sql("""SELECT zone, series, h,
        CASE WHEN series LIKE '%eur%' THEN round(m, 6) ELSE coalesce(s, 0) END AS value
      FROM grid LEFT JOIN hourly USING (zone, series, h)""", _SERIES, "23:59:00"),
    "points_long", steps=f"{_SLOTS.strip()},\ninside AS (SELECT * FROM points WHERE {_WINDOW}),{_GRID}"))
def ingest_increment(spark, sf_dir):
    """Three runs: the first week with wrong values in one zone, then all weeks, then the right values under the same folders."""
    landing, root = scratch_path(spark, "landing-increment"), scratch_path(spark, "market-store")
    feed = increments.json_feed(landing, START, END, partitioned=True)
    chunks = settle(spark, _chunks(spark, sf_dir), "chunks")
    first = chunks.agg(F.min("chunk_ms")).first()[0]
    wrong = F.transform("series", lambda p: F.array(p[0], p[1] + 1000.0))
    one_zone = F.col("zone") == "Z1"

    def land(rows, mode):
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("series_id", "zone", "chunk_ms").json(landing)

    land(chunks.filter(F.col("chunk_ms") == first).withColumn("series", F.when(one_zone, wrong).otherwise(F.col("series"))), "append")
    increments.ingest(spark, feed, root)
    land(chunks.filter(F.col("chunk_ms") != first), "append")
    increments.ingest(spark, feed, root)
    land(chunks.filter((F.col("chunk_ms") == first) & one_zone), "overwrite")
    increments.ingest(spark, feed, root)
    return increments.market(spark, root).withColumn("price_da_eur_mwh", F.round("price_da_eur_mwh", 6))


def _land_xml(spark, sf_dir):
    """One document folder per kind and zone; a day of quarter hours is one Period."""
    path = scratch_path(spark, "landing-xml")
    is_price = F.col("series") == "view"
    value = F.col("v").cast("double")
    point = F.struct(
        (F.pmod("slot", F.lit(96)) + 1).cast("int").alias("position"),
        F.when(is_price, value).alias("price.amount"),
        F.when(~is_price, value).alias("quantity"),
    )
    days = _slots(spark, sf_dir).groupBy("zone", "series", F.expr("slot div 96").alias("day")).agg(
        F.sort_array(F.collect_list(point)).alias("Point"))
    iso = "yyyy-MM-dd'T'HH:mm'Z'"
    start = F.timestamp_seconds(F.col("day") * 86400)
    period = F.struct(
        F.struct(
            F.date_format(start, iso).alias("start"),
            F.date_format(start + F.expr("interval 1 day"), iso).alias("end"),
        ).alias("timeInterval"),
        F.lit("PT15M").alias("resolution"),
        "Point",
    )
    kinds = {k: v[0] for k, v in XML_KINDS.items()}, {k: v[1] for k, v in XML_KINDS.items()}
    days.select(
        F.array(period).alias("Period"),
        _name(F.col("series"), kinds[0]).alias("doc_type"),
        _name(F.col("series"), kinds[1]).alias("psr_type"),
        "zone",
    ).write.partitionBy("doc_type", "psr_type", "zone").format("xml").option("rowTag", "TimeSeries").option(
        "rootTag", "Market_Document").save(path)
    return path


@query("scan_xml_docs", with_views(
    "SELECT zone, series, utc_timestamp, value FROM points", "points_long", steps=_SLOTS))
def scan_xml_docs(spark, sf_dir):
    return landing_xml.scan_documents(spark, _land_xml(spark, sf_dir)).drop("chunk_no")


@query("market_from_xml", with_views(
    _market_sql("""SELECT zone, series, h, round(m, 6) AS value FROM grid LEFT JOIN hourly USING (zone, series, h)""",
                _SERIES, "23:59:59"),
    "points_long", steps=f"""{_SLOTS.strip()},
inside AS (SELECT * FROM points WHERE utc_timestamp BETWEEN timestamp '{START} 00:00:00' AND timestamp '{END} 23:59:59'),{_GRID}"""))
def market_from_xml(spark, sf_dir):
    """Days of a series lie in many documents, so the documents interleave."""
    market = landing_xml.market_table(spark, _land_xml(spark, sf_dir), START, END)
    return market.withColumns({c: F.round(c, 6) for c in _SERIES})


@query("scan_rejections", with_views(
    """SELECT zone, 'A44' AS doc_type, '-' AS psr_type, '999' AS code, concat('no data for ', zone) AS text
    FROM (SELECT DISTINCT zone FROM points_long)""", "points_long"))
def scan_rejections(spark, sf_dir):
    path = scratch_path(spark, "landing-rejections")
    zones = points_long(spark, sf_dir).select("zone").distinct()
    zones.select(
        F.struct(F.lit("999").alias("code"), F.concat(F.lit("no data for "), F.col("zone")).alias("text")).alias("Reason"),
        F.lit("A44").alias("doc_type"), F.lit("-").alias("psr_type"), "zone",
    ).write.partitionBy("doc_type", "psr_type", "zone").format("xml").option("rowTag", "Acknowledgement").option(
        "rootTag", "Documents").save(path)
    return landing_xml.scan_rejections(spark, path).drop("file_name")


@query("scan_parquet", with_views(
    "SELECT zone, utc_timestamp, price_c, load_c FROM market_sparse WHERE zone = 'Z1'", "market_sparse"))
def scan_parquet(spark, sf_dir):
    """Market table built and stored once, then read with zone pruning."""
    from checks.fixtures import market_sparse

    path = scratch_path(spark, "market")
    tables.load_or_build(spark, path, lambda: market_sparse(spark, sf_dir))
    stored = tables.load_or_build(spark, path, lambda: market_sparse(spark, sf_dir).limit(0))
    return stored.filter(F.col("zone") == "Z1").select("zone", "utc_timestamp", "price_c", "load_c")
