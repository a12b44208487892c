"""Runs all steps on landed files.

    spark-submit --py-files … -m wattline --landing /landing/json --format json --output /warehouse/run
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from wattline.config import JobConfig
from wattline.operators.rules import parse_rule_documents, rules_from_rows
from wattline.plans import pipeline
from wattline.session import build_session
from wattline.sources import landing_json, landing_xml


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> pipeline.Run:
    parser = argparse.ArgumentParser(prog="wattline", description="Fair value from landed market files.")
    parser.add_argument("--landing", required=True, help="folder of landed files")
    parser.add_argument("--format", choices=("json", "json-partitioned", "xml"), default="json")
    parser.add_argument("--output", required=True, help="folder for tables and reports")
    parser.add_argument("--rules", help="rule document (JSON text file)")
    parser.add_argument("--folds", type=int, default=JobConfig.cv_folds)
    parser.add_argument("--test-months", type=int, default=JobConfig.test_months)
    parser.add_argument("--iterations", type=int, default=JobConfig.gbt_iterations)
    parser.add_argument("--lag-mode", choices=("row", "time"), default=JobConfig.lag_mode)
    chosen = parser.parse_args(arguments)

    spark = spark or build_session()
    config = JobConfig.from_env(
        cv_folds=chosen.folds,
        test_months=chosen.test_months,
        gbt_iterations=chosen.iterations,
        lag_mode=chosen.lag_mode,
    )
    dates = config.start_date, config.end_date

    def build_market():
        if chosen.format == "xml":
            return landing_xml.market_table(spark, chosen.landing, *dates)
        partitioned = chosen.format == "json-partitioned"
        return landing_json.market_table(spark, chosen.landing, *dates, partitioned=partitioned)

    rule_list = []
    if chosen.rules:
        documents = spark.read.text(chosen.rules, wholetext=True).withColumnRenamed("value", "document")
        rule_list = rules_from_rows(parse_rule_documents(documents))
    return pipeline.run(spark, config, build_market, chosen.output, rule_list=rule_list)


if __name__ == "__main__":
    main().signals.show(truncate=False)
