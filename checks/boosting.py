"""Queries for leaf-wise boosting. The SQL grows the same trees leaf by leaf, a histogram over all rows for each split."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.features import CALENDAR_SQL, CYCLIC_SQL, HOLIDAY_SQL, _full, _lag
from checks.fixtures import DAY_MICROS, daily_series, with_views
from checks.registry import query
from wattline.functions.quantiles import grouped_quantiles
from wattline.operators import features, leafwise
from wattline.session import settle

BINS, UNIT, STEP, LEAST = 16, 1024, 0.1, 20
#: Steps are rows, one a day; nothing newer than a week enters an input. The number of rows of a day is its fundamental.
SPEC = features.FeatureSpec(
    price="y", fundamentals=("n",), wind=(), solar="", unit="d", price_prefix="y", lags=(7, 14, 21, 28, 56), min_lag=7,
    short_window=7, long_window=28, fundamental_lags=(7, 28), step_micros=DAY_MICROS)
_INPUT_SQL = {
    **CALENDAR_SQL, **HOLIDAY_SQL, **CYCLIC_SQL,
    **{f"y_lag_{k}d": _lag("y", k) for k in SPEC.lags},
    "y_roll_7d_mean": _full("avg", "y", 7, 7), "y_roll_7d_max": _full("max", "y", 7, 7), "y_roll_7d_min": _full("min", "y", 7, 7),
    "y_roll_28d_mean": _full("avg", "y", 28, 7), "y_roll_28d_std": _full("stddev_samp", "y", 28, 7),
    "n_lag7": _lag("n", 7), "n_lag28": _lag("n", 28), "n_roll7_mean": _full("avg", "n", 7, 7),
}
INPUTS = sorted(_INPUT_SQL)

_CUTS = ", ".join(str(k / BINS) for k in range(1, BINS))
_BINNED = f"""
days AS (SELECT zone, utc_timestamp, y_c / 100.0::double AS y, n::double AS n FROM daily_series),
wide AS (SELECT zone, utc_timestamp, y, {", ".join(f"({e})::double AS {c}" for c, e in _INPUT_SQL.items())} FROM days),
base AS MATERIALIZED (SELECT row_number() OVER (ORDER BY zone, utc_timestamp) AS id, * FROM wide
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ("y", *INPUTS))}),
long AS MATERIALIZED (SELECT id, f, v FROM (UNPIVOT (SELECT id, {", ".join(INPUTS)} FROM base) ON {", ".join(INPUTS)} INTO NAME f VALUE v)),
edges AS MATERIALIZED (SELECT DISTINCT f, unnest(quantile_cont(v, [{_CUTS}])) AS edge FROM long GROUP BY f),
binned AS MATERIALIZED (SELECT id, long.f, count(edge) AS bin FROM long LEFT JOIN edges ON edges.f = long.f AND edge < v GROUP BY 1, 2),
scores0 AS MATERIALIZED (SELECT id, y, (SELECT avg(y) FROM base) AS score FROM base)"""


def _tree(t: int, leaves: int) -> str:
    """Steps of tree ``t``: splits ``s<t>_<k>``, leaves of the rows ``l<t>_<k>`` and the next scores."""
    steps = [
        f"g{t} AS MATERIALIZED (SELECT id, round_even((y - score) * {UNIT}, 0)::bigint AS g FROM scores{t})",
        f"l{t}_0 AS MATERIALIZED (SELECT id, 0 AS leaf FROM g{t})",
    ]
    for k in range(1, leaves):
        steps += [
            f"""s{t}_{k} AS MATERIALIZED (
  SELECT * FROM (
    SELECT leaf, f, bin, na AS n, gl * gl / nl + (ga - gl) * (ga - gl) / (na - nl) - ga * ga / na AS gain FROM (
      SELECT leaf, f, bin, sum(n) OVER w AS nl, (sum(g) OVER w)::double AS gl,
             sum(n) OVER a AS na, (sum(g) OVER a)::double AS ga
      FROM (SELECT leaf, f, bin, count(*) AS n, sum(g) AS g
            FROM binned JOIN l{t}_{k - 1} USING (id) JOIN g{t} USING (id) GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY leaf, f ORDER BY bin), a AS (PARTITION BY leaf, f))
    WHERE nl >= {LEAST} AND na - nl >= {LEAST})
  WHERE gain > 0 ORDER BY gain DESC, leaf, f, bin LIMIT 1)""",
            f"""l{t}_{k} AS MATERIALIZED (
  SELECT p.id, CASE WHEN b.bin > s.bin THEN {k} ELSE p.leaf END AS leaf
  FROM l{t}_{k - 1} p LEFT JOIN s{t}_{k} s ON s.leaf = p.leaf LEFT JOIN binned b ON b.id = p.id AND b.f = s.f)""",
        ]
    last = f"l{t}_{leaves - 1}"
    steps += [
        f"v{t} AS MATERIALIZED (SELECT leaf, count(*) AS n, {STEP}::double * {1 / UNIT}::double * sum(g)::double / count(*) AS value FROM {last} JOIN g{t} USING (id) GROUP BY 1)",
        f"scores{t + 1} AS MATERIALIZED (SELECT id, y, score + value AS score FROM scores{t} JOIN {last} USING (id) JOIN v{t} USING (leaf))",
    ]
    return ",\n".join(steps)


def _splits(trees: int, leaves: int) -> str:
    return "\nUNION ALL\n".join(f"SELECT f, bin, n, gain FROM s{t}_{k}" for t in range(trees) for k in range(1, leaves))


def _fitted(spark, sf_dir, trees: int, leaves: int) -> leafwise.Boosted:
    daily = daily_series(spark, sf_dir).select("zone", "utc_timestamp", (F.col("y_c") / 100.0).alias("y"), F.col("n").cast("double").alias("n"))
    matrix = features.feature_matrix(daily, SPEC)
    rows = settle(spark, matrix.select("y", *[F.col(c).cast("double").alias(c) for c in INPUTS]), "boosting-inputs")
    cuts = {f"q{k}": k / BINS for k in range(1, BINS)}
    found = grouped_quantiles(rows.unpivot([], INPUTS, "input", "value"), ["input"], "value", cuts).collect()
    edges = {r["input"]: np.unique([r[name] for name in cuts]) for r in found}
    settings = leafwise.LeafwiseSettings(
        iterations=trees, step=STEP, leaves=leaves, min_leaf_rows=LEAST, row_share=1.0, column_share=1.0, bins=BINS, resolution=1 / UNIT)
    return leafwise.boost(rows.select("y", F.array(*INPUTS).alias("inputs")), "y", "inputs", settings, [edges[c] for c in INPUTS])


@query("gbt_one_tree", with_views(
    f"""SELECT 'split' AS kind, f AS input, bin::bigint AS bin, n::bigint AS rows, round(gain / {UNIT * UNIT}, 3) AS amount FROM ({_splits(1, 16)})
    UNION ALL SELECT 'leaf', NULL, NULL, n, round(value, 6) FROM v0""", "daily_series", steps=_BINNED + ",\n" + _tree(0, 16)))
def gbt_one_tree(spark, sf_dir):
    """One tree of 16 leaves over the whole daily feature matrix: its splits with their gains, and its leaves with their values."""
    boosted = _fitted(spark, sf_dir, 1, 16)
    table = leafwise.tree_table(spark, boosted.trees, INPUTS)
    amount = F.when(F.col("input").isNull(), F.round("value", 6)).otherwise(F.round(F.col("gain") / (UNIT * UNIT), 3))
    return table.select(
        F.when(F.col("input").isNull(), "leaf").otherwise("split").alias("kind"), "input", F.col("bin").cast("long").alias("bin"), "rows", amount.alias("amount"))


@query("split_importance", with_views(
    f"""SELECT c.f AS input, count(s.f) AS splits, round(coalesce(sum(gain), 0) / {UNIT * UNIT}, 2) AS gain
    FROM (SELECT unnest([{", ".join(f"'{c}'" for c in INPUTS)}]) AS f) c LEFT JOIN ({_splits(3, 8)}) s ON s.f = c.f GROUP BY 1""",
    "daily_series", steps=",\n".join([_BINNED, *[_tree(t, 8) for t in range(3)]])))
def split_importance(spark, sf_dir):
    """Number of splits and summed gain of every input of the daily feature matrix, from three trees of 8 leaves."""
    splits, gains = _fitted(spark, sf_dir, 3, 8).importances()
    rows = [(c, int(n), round(float(g) / (UNIT * UNIT), 2)) for c, n, g in zip(INPUTS, splits, gains)]
    return spark.createDataFrame(rows, "input string, splits long, gain double")
