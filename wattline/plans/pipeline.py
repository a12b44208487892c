"""End-to-end run: market table, quality, features, forecast, delivery views, signal."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.config import DOMAIN_BOUNDS, FUNDAMENTALS, PRICE, TS, ZONE, JobConfig
from wattline.operators import cleaning, delivery, features, quality, reports, rules, signal, validation
from wattline.operators.leafwise import LeafwiseSettings
from wattline.operators.learners import GbtSettings, PriceForecaster, month_of, walk_forward
from wattline.operators.shaping import tail_rows
from wattline.session import prepare_session, settle
from wattline.sources import tables

MONTH = "feature_month"


@dataclass
class Run:
    """Results of one run; every table is lazy or read back from storage."""

    market: DataFrame
    report: DataFrame
    rule_results: DataFrame | None
    forecast: DataFrame
    fold_predictions: DataFrame
    performance: DataFrame
    importances: DataFrame
    views: DataFrame
    signals: DataFrame
    figures: dict[str, DataFrame]


def quality_tables(market: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """One small table per check. Column and timestamp statistics feed several
    of them and are stored after their single pass."""
    spark = market.sparkSession
    stats = settle(spark, quality.column_stats(market, columns, bounds=DOMAIN_BOUNDS), "column-stats")
    stamps = settle(spark, quality.timestamp_stats(market), "timestamp-stats")
    checks = quality.judge(stats, stamps)
    return {
        "overview": quality.overview(market, columns),
        "missing": quality.missing(stats),
        "timestamps": stamps,
        "duplicate_examples": quality.duplicate_examples(market),
        "gap_examples": quality.gap_examples(market),
        "outliers": quality.bound_violations(stats),
        "range_stats": quality.range_stats(market, columns),
        "monthly_coverage": quality.monthly_coverage(market, columns),
        "issues": quality.issues(checks),
        "verdict": quality.verdict(checks),
    }


def clean(market: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and columns kept for modelling, and the column decisions."""
    priced = cleaning.keep_price_range(market)
    decisions = settle(market.sparkSession, cleaning.sparse_columns(priced), "column-decisions")
    gone = [row["column"] for row in decisions.where("dropped").collect()]
    return priced.drop(*gone), decisions


def run(
    spark: SparkSession,
    config: JobConfig,
    build_market: Callable[[], DataFrame],
    output: str,
    *,
    rule_list: Sequence[rules.Rule] = (),
    spec: features.FeatureSpec = features.FeatureSpec(),
) -> Run:
    """Run all steps and write their files below ``output``.

    ``build_market`` reads landed files (see ``sources``) and is only called
    when no market table is stored or ``config.force_refetch`` is set.
    """
    prepare_session(spark)
    market = tables.load_or_build(spark, f"{output}/market", build_market, force=config.force_refetch)
    columns = [c for c in (PRICE, *FUNDAMENTALS) if c in market.columns]

    report_parts = quality_tables(market, columns)
    rule_results = None
    if rule_list:
        judged = market if config.rules_last_n is None else tail_rows(market, config.rules_last_n)
        rule_results = settle(spark, rules.run_rules(judged, rule_list), "rule-results")
        report_parts["rule_results"] = rule_results
        report_parts["rule_summary"] = rules.rule_summary(rule_results)

    kept, decisions = clean(market)
    # Every fold and the final fit read the features: they are stored once, by month.
    built = features.feature_matrix(kept, spec, lag_mode=config.lag_mode)
    inputs = [c for c in built.columns if c not in (ZONE, TS, PRICE)]
    matrix = settle(spark, built.withColumn(MONTH, month_of(TS)), "features", partition_by=[MONTH])

    split = validation.holdout_split(matrix, config.test_months)
    train = split.filter(F.col("part") == "train").drop("part", "split_ts")
    test = split.filter(F.col("part") == "test")
    # Test rows look one season back and no further: older rows are not shuffled.
    recent = split.filter(F.col(TS) >= F.col("split_ts") - F.make_dt_interval(hours=F.lit(validation.SEASON_STEPS)))
    naive = validation.seasonal_naive(
        recent.select(ZONE, TS, PRICE, "part"), target=PRICE, train_only=True
    ).filter(F.col("part") == "test")

    if config.learner == "leafwise":
        gbt = LeafwiseSettings(iterations=config.gbt_iterations, seed=config.random_seed)
    else:
        gbt = GbtSettings(iterations=config.gbt_iterations, depth=config.gbt_depth, seed=config.random_seed)
    forecaster = PriceForecaster(tuple(inputs), learner=gbt.estimator)
    folds = settle(
        spark,
        walk_forward(train, forecaster, config.cv_folds, parallel_fits=config.parallel_fits, month=MONTH),
        "fold-predictions",
    )
    forecaster.fit(train)
    point = forecaster.predict(test).select(ZONE, TS, F.col(PRICE).alias("y_true"), "y_pred")
    banded = validation.prediction_interval(point, validation.residual_quantiles(folds))
    forecast = settle(spark, banded, "forecast")
    scored = forecast.join(naive.select(ZONE, TS, "y_naive"), [ZONE, TS])
    performance = validation.performance_record(scored, validation.fold_metrics(folds))
    tables.write_csv(validation.forecast_output(forecast), f"{output}/forecast")

    rounded = tables.read_forecast(spark, f"{output}/forecast")
    views = delivery.all_views(rounded, digits=2)
    tables.write_csv(views, f"{output}/delivery_views")
    references = signal.prompt_reference(market, rounded, digits=2)
    mae = performance.select(
        ZONE, F.round("model_mae", 2).alias("mae"), F.col("mae_mean").alias("train_mae")
    )
    signals = signal.signal_record(signal.trading_signal(views, references, mae))
    tables.write_json(signals, f"{output}/trading_signal")

    report_parts["model_performance"] = performance
    decided = [F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()]) for row in decisions.collect()]
    if decided:
        report_parts["column_decisions"] = performance.select(ZONE, F.inline(F.array(*decided)))
    report = tables.report_json(report_parts)
    tables.write_report(report, f"{output}/quality_report")
    tables.write_json(decisions, f"{output}/column_decisions")

    fold_list = folds.select(ZONE, "fold").distinct()
    figures = {
        "weekly_price_renewables": reports.weekly_price_renewables(market),
        "recent_folds": reports.recent_folds(folds, fold_list),
        "price_heatmap": reports.price_heatmap(market),
        "recent_comparison": reports.recent_comparison(scored),
        "forecast_summary": reports.forecast_summary(rounded),
    }
    return Run(
        market, report, rule_results, forecast, folds, performance, forecaster.importances(), views, signals, figures
    )

