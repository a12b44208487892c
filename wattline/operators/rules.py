"""Declarative validation rules evaluated as Spark SQL predicates.

A rule names one column and a predicate on ``s``, that column's value. Rows in
which the column is null are not judged; a row that is not true is a violation,
also where the predicate fails on its value. These forms exist:

``<predicate>``            a row predicate, e.g. ``s between 0 and 65000``
``<aggregate predicate>``  one truth value for the whole zone, e.g. ``avg(s) > 0``
``jump(k)``                change from the previous non-null value is at most k
``flatline(n)``            the last n values are not all equal
``spike(t, n, m)``         values above t only where the last n values hold at most m such

Expressions in series notation (``s.diff().abs() <= 150``) are translated to
these, or, see ``series_text``, to a predicate on columns that hold neighbours, windows, running values, ranks and single
values of the series. Division and remainders follow floating-point rules there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from wattline.config import TS, ZONE
from wattline.operators.rule_text import as_series, checked
from wattline.operators.series_rules import series_counts
from wattline.operators.series_text import Program
from wattline.operators.whole_series import fits, judged_rows, sequence_predicate, whole_columns
from wattline.plans.blocks import BLOCK_STEPS, block_series

_NUMBER = r"\s*(-?\d+(?:\.\d+)?)\s*"
_TEMPLATES = {
    "jump": re.compile(rf"jump\({_NUMBER}\)"),
    "flatline": re.compile(rf"flatline\({_NUMBER}\)"),
    "spike": re.compile(rf"spike\({_NUMBER},{_NUMBER},{_NUMBER}\)"),
}

_DIVISION = re.compile(r"[/%]")
_SERIES_LIKE = re.compile(r"\bs\s*\.|[&|~^]|==|\*\*|//|\)\s*\.\s*[a-z_]+\s*\(")

#: Rules of one plan; more are evaluated in several.
BATCH = 200

RULE_SCHEMA = "name string, description string, column string, severity string, expression string"


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    expression: str
    description: str = ""
    severity: str = "warning"


def parse_rule_documents(docs: DataFrame, text: str = "document") -> DataFrame:
    """One row per rule of every document; unreadable documents give ``parse_error``.

    A surrounding triple-backtick fence is removed. A document is either a list
    of rules or an object with a ``rules`` list.
    """
    raw = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(raw, r"^```[^\n]*\n?", ""), r"(?s)\s*```(?!.*```).*$", "")
    body = F.when(raw.startswith("```"), F.trim(inner)).otherwise(raw)
    listed = F.from_json(body, f"array<struct<{_as_fields(RULE_SCHEMA)}>>")
    wrapped = F.from_json(body, f"struct<rules:array<struct<{_as_fields(RULE_SCHEMA)}>>>")["rules"]
    wrapped = F.coalesce(wrapped, F.array().cast(f"array<struct<{_as_fields(RULE_SCHEMA)}>>"))
    rules = F.when(body.startswith("["), listed).when(body.startswith("{"), wrapped)
    keys = [c for c in docs.columns if c != text]
    # A JSON reader stops at the end of the first value; text behind it makes the document unreadable.
    closed = F.when(body.startswith("["), body.endswith("]")).otherwise(body.endswith("}"))
    read = docs.select(
        *keys, rules.alias("_rules"), (F.get_json_object(body, "$").isNull() | ~closed).alias("_bad")
    )
    bad = read.filter(F.col("_bad") | F.col("_rules").isNull()).select(
        *keys, *[F.lit(None).cast("string").alias(f.split()[0]) for f in RULE_SCHEMA.split(", ")],
        F.lit("document is not a rule list").alias("parse_error"),
    )
    good = read.filter(~F.col("_bad") & F.col("_rules").isNotNull()).select(*keys, F.inline("_rules")).withColumn("parse_error", F.lit(None).cast("string"))
    return good.withColumn("severity", F.coalesce("severity", F.lit("warning"))).unionByName(bad)


def _as_fields(schema: str) -> str:
    return schema.replace(" string", ":string").replace(", ", ",")


def rules_from_rows(rows: DataFrame) -> list[Rule]:
    """Rules of a parsed rule table; a document that could not be read raises."""
    found = rows.collect()
    bad = [r for r in found if r["parse_error"]] if "parse_error" in rows.columns else []
    if bad:
        raise ValueError(f"{len(bad)} rule documents: {bad[0]['parse_error']}")
    return [
        Rule(r["name"], r["column"], r["expression"], r["description"] or "", r["severity"] or "warning") for r in found
    ]


def _template(rule: Rule) -> tuple[str, list[float]] | None:
    if rule.expression is None:
        return None
    for kind, pattern in _TEMPLATES.items():
        match = pattern.fullmatch(rule.expression.strip())
        if match:
            return kind, [float(g) for g in match.groups()]
    return None


@contextmanager
def _lenient(spark: SparkSession) -> Iterator[None]:
    """Predicates resolved here give NULL where they would fail on a value
    (division by zero, unreadable cast), so one rule cannot stop the others."""
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _classify(empty: DataFrame, rule: Rule) -> tuple[str, str | None]:
    """Kind of a predicate rule, found by analysing it on an empty one-column table."""
    try:
        empty.select("s", F.expr(rule.expression).cast("boolean")).schema
        return "row", None
    except (AnalysisException, ParseException) as row_error:
        try:
            empty.agg(F.expr(rule.expression).cast("boolean")).schema
            return "scalar", None
        except (AnalysisException, ParseException):
            return "error", row_error.getCondition() or "INVALID_RULE"


def run_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    *,
    ts: str = TS,
    zone: str = ZONE,
    first_row_passes: bool = False,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Evaluate every rule per zone.

    All row predicates share one aggregate pass over ``df``, which also finds the
    zones. Rules that look at other values of their series share one pass over whole zones where no zone
    is longer than a block and their steps allow it; else they share blocked passes over the
    non-null values of their columns. A rule on an unknown column is ``skipped``,
    one that is not allowed or does not resolve is ``error``; neither stops the others.
    """
    if len(rules) > BATCH:
        parts = [
            run_rules(df, rules[at : at + BATCH], ts=ts, zone=zone, first_row_passes=first_row_passes, block_steps=block_steps)
            for at in range(0, len(rules), BATCH)
        ]
        results = parts[0]
        for part in parts[1:]:
            results = results.unionByName(part)
        return results
    spark = df.sparkSession
    row_rules, scalar_rules, sequence_rules, series_rules, unusable = [], [], [], [], []
    program = Program()
    empty = {}
    for number, rule in enumerate(rules):
        column = ts if rule.column == "index" else rule.column
        if column not in df.columns:
            unusable.append((number, "skipped", f"the table has no column {rule.column!r}"))
            continue
        numeric = isinstance(df.schema[column].dataType, NumericType)
        rewritten = as_series(rule.expression) if numeric and rule.expression else rule.expression
        try:
            # Division and remainders mean the same in both notations, but not what they give for zero.
            if numeric and rule.expression and (_DIVISION.search(rule.expression) or rewritten != rule.expression):
                raise ValueError("series notation")
            read = replace(rule, expression=checked(rule.expression) if not _template(rule) else rule.expression.strip())
            template = _template(read)
        except ValueError:
            try:
                found = program.read(rewritten, column) if numeric else None
            except ValueError as refused:
                found, error = None, str(refused)
            else:
                error = "sequence rules need a numeric column"
            if found is not None and found.names - {"_value"}:
                series_rules.append((number, column, found.text, found.kept))
                continue
            try:
                text = checked(rule.expression) if found is None else found.text.replace("_value", "cast(s as double)")
            except ValueError as plain:
                unusable.append((number, "error", error if _SERIES_LIKE.search(rule.expression or "") else str(plain)))
                continue
            read, template = replace(rule, expression=text), None
        if template and not numeric:
            unusable.append((number, "error", "sequence rules need a numeric column"))
            continue
        if template:
            sequence_rules.append((number, column, *template))
            continue
        if column not in empty:
            blank = F.lit(None).cast(df.schema[column].dataType)
            empty[column] = spark.range(0).select(blank.alias("s"))
        with _lenient(spark):
            kind, error = _classify(empty[column], read)
        if kind == "row":
            row_rules.append((number, column, read))
        elif kind == "scalar":
            scalar_rules.append((number, column, read))
        else:
            unusable.append((number, "error", error))

    results = _rule_rows(_count_rows(df, row_rules, zone), rules, unusable, {n for n, _, _ in row_rules}, zone)
    others = [
        _count_scalar(df, column, [r for r in scalar_rules if r[1] == column], zone)
        for column in sorted({c for _, c, _ in scalar_rules})
    ]
    if sequence_rules or series_rules:
        counted, sequence_rules, series_rules = _count_whole(df, sequence_rules, series_rules, program, ts, zone, first_row_passes, block_steps)
        others += counted
    if sequence_rules:
        others.append(_count_sequences(df, sequence_rules, ts, zone, first_row_passes, block_steps))
    if series_rules:
        rest = program.only({c for _, c, _, _ in series_rules})
        counted = series_counts(df, rest, series_rules, ts, zone, block_steps)
        others.append(_long_counts(counted, [n for n, *_ in series_rules], zone))
    if others:
        counts = others[0]
        for part in others[1:]:
            counts = counts.unionByName(part)
        more = counts.select(zone, "_number", F.col("violations").alias("_more_violations"), F.col("judged").alias("_more_judged"))
        results = results.join(more, [zone, "_number"], "left").withColumns(
            {"violations": F.coalesce("_more_violations", "violations"), "judged": F.coalesce("_more_judged", "judged")}
        )
    violations = F.coalesce("violations", F.lit(0)).cast("bigint")
    judged = F.greatest(F.coalesce("judged", F.lit(0)), F.lit(1))
    status = F.coalesce("_status", F.when(violations == 0, "pass").otherwise("fail"))
    return results.select(
        zone, "name", "description", "column", "severity", "expression",
        status.alias("status"),
        violations.alias("violations"),
        (violations / judged).alias("fraction"),
        "error",
    )


def _rule_rows(counted: DataFrame, rules: Sequence[Rule], unusable, row_numbers: set[int], zone: str) -> DataFrame:
    """Every rule once per zone, with the counts of row rules and the status of
    those that cannot run."""
    verdicts = {number: (status, error) for number, status, error in unusable}
    unknown = F.lit(None).cast("bigint")
    cells = []
    for n, r in enumerate(rules):
        status, error = verdicts.get(n, (None, None))
        cells.append(
            F.struct(
                F.lit(n).alias("_number"),
                F.lit(r.name).alias("name"),
                F.lit(r.description).alias("description"),
                F.lit(r.column).alias("column"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.expression).alias("expression"),
                F.lit(status).cast("string").alias("_status"),
                F.lit(error).cast("string").alias("error"),
                (F.col(f"v{n}") if n in row_numbers else unknown).alias("violations"),
                (F.col(f"n{n}") if n in row_numbers else unknown).alias("judged"),
            )
        )
    return counted.select(zone, F.inline(F.array(*cells)))


def _long_counts(aggregated: DataFrame, numbers: Sequence[int], zone: str) -> DataFrame:
    cells = [
        F.struct(F.lit(n).alias("_number"), F.col(f"v{n}").alias("violations"), F.col(f"n{n}").alias("judged"))
        for n in numbers
    ]
    return aggregated.select(zone, F.inline(F.array(*cells)))


def _count_rows(df: DataFrame, row_rules, zone: str) -> DataFrame:
    """Violations and judged rows of all row rules, one row per zone."""
    # Each column is named ``s`` in turn while its predicates are resolved;
    # the optimizer folds the projections into one.
    columns = sorted({c for _, c, _ in row_rules})
    held = {c: f"_c{i}" for i, c in enumerate(columns)}
    judged = df.select(F.col(zone).alias("_zone"), *[F.col(c).alias(held[c]) for c in columns])
    for column in columns:
        checks = [
            F.coalesce(F.expr(rule.expression).cast("boolean"), F.lit(False)).alias(f"ok{n}")
            for n, c, rule in row_rules
            if c == column
        ]
        with _lenient(df.sparkSession):
            judged = judged.withColumn("s", F.col(held[column])).select("*", *checks).drop("s")
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for n, column, _ in row_rules:
        present = F.col(held[column]).isNotNull()
        aggregates += [F.count_if(present & ~F.col(f"ok{n}")).alias(f"v{n}"), F.count_if(present).alias(f"n{n}")]
    return judged.groupBy(F.col("_zone").alias(zone)).agg(*aggregates)


def _count_scalar(df: DataFrame, column: str, rules, zone: str) -> DataFrame:
    values = df.select(zone, F.col(column).alias("s")).filter(F.col("s").isNotNull())
    aggregates = []
    for n, _, rule in rules:
        holds = F.coalesce(F.expr(rule.expression).cast("boolean"), F.lit(False))
        aggregates += [F.when(holds, F.lit(0)).otherwise(F.count("s")).alias(f"v{n}"), F.count("s").alias(f"n{n}")]
    with _lenient(df.sparkSession):
        counted = values.groupBy(zone).agg(*aggregates)
    return _long_counts(counted, [n for n, _, _ in rules], zone)


def _count_whole(df, sequence_rules, series_rules, program: Program, ts: str, zone: str, first_row_passes: bool, block_steps: int):
    """Counts of the rules whose columns can be evaluated with whole zones in a task; and the other sequence and series rules."""
    columns = {c for _, c, *_ in [*sequence_rules, *series_rules]}
    whole_program = program.only(columns)
    found = {n: sequence_predicate(whole_program, c, kind, args, first_row_passes) for n, c, kind, args in sequence_rules}
    columns -= {c for n, c, _, _ in sequence_rules if found[n] is None}
    columns = whole_columns(whole_program, sorted(columns))
    rows = fits(df, columns, ts, zone, block_steps) if columns else 0
    if not rows:
        return [], sequence_rules, series_rules
    judged = [(n, c, found[n], "") for n, c, _, _ in sequence_rules if c in columns] + [rule for rule in series_rules if rule[1] in columns]
    laid, verdicts = judged_rows(df, whole_program, judged, ts, zone, rows)
    counts = [[F.count_if(bad).alias(f"v{n}"), F.count_if(held).alias(f"n{n}")] for n, (held, bad) in verdicts.items()]
    counted = laid.groupBy(F.col("_zone").alias(zone)).agg(*sum(counts, []))
    left = ([rule for rule in rules if rule[1] not in columns] for rules in (sequence_rules, series_rules))
    return [_long_counts(counted, list(verdicts), zone)], *left


def _count_sequences(df, sequence_rules, ts: str, zone: str, first_row_passes: bool, block_steps: int) -> DataFrame:
    columns = sorted({c for _, c, _, _ in sequence_rules})
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    long = (
        df.select(zone, ts, *doubles)
        .unpivot([zone, ts], columns, "_column", "_value")
        .filter(F.col("_value").isNotNull())
    )
    reach = [int(args[0 if kind == "flatline" else 1]) - 1 for _, _, kind, args in sequence_rules if kind in ("flatline", "spike")]
    look_back = max([1, *reach])
    laid = block_series(long, [zone, "_column"], ts, look_back=look_back, block_steps=block_steps)
    laid = laid.with_columns({"_previous": laid.lag("_value", 1)})
    # Counts over the last n rows are differences of running counts, so the cost
    # per row does not grow with n.
    running = {"_changes": laid.running(F.count_if(F.col("_value") != F.col("_previous")))}
    for n, _, kind, args in sequence_rules:
        if kind == "spike":
            running[f"_high{n}"] = laid.running(F.count_if(F.col("_value") > args[0]))
    laid = laid.with_columns(running)
    oks: dict[str, Column] = {}
    for n, _, kind, args in sequence_rules:
        if kind == "jump":
            oks[f"ok{n}"] = _jump_ok(first_row_passes, *args)
        elif kind == "flatline":
            oks[f"ok{n}"] = _flatline_ok(laid, first_row_passes, *args)
        else:
            oks[f"ok{n}"] = _spike_ok(laid, f"_high{n}", *args)
    judged = laid.with_columns(oks).own_rows()
    aggregates = []
    for n, column, _, _ in sequence_rules:
        mine = F.col("_column") == column
        aggregates += [F.count_if(mine & ~F.col(f"ok{n}")).alias(f"v{n}"), F.count_if(mine).alias(f"n{n}")]
    return _long_counts(judged.groupBy(zone).agg(*aggregates), [n for n, *_ in sequence_rules], zone)


def _jump_ok(first_row_passes: bool, limit: float) -> Column:
    """Without a previous value there is no change to compare: a violation by default."""
    return F.coalesce(F.abs(F.col("_value") - F.col("_previous")) <= limit, F.lit(first_row_passes))


def _flatline_ok(laid, first_row_passes: bool, size: float) -> Column:
    """Some change among the last ``size`` values, which a single value does not have."""
    steps = int(size) - 1
    if steps < 1:
        return F.lit(False) if not first_row_passes else F.col("_previous").isNull()
    varied = F.col("_changes") > F.coalesce(laid.lag("_changes", steps), F.lit(0))
    return varied | F.col("_previous").isNull() if first_row_passes else varied


def _spike_ok(laid, running: str, threshold: float, size: float, allowed: float) -> Column:
    recent = F.col(running) - F.coalesce(laid.lag(running, int(size)), F.lit(0))
    return (F.col("_value") <= threshold) | (recent <= int(allowed))


def rule_summary(results: DataFrame, zone: str = ZONE) -> DataFrame:
    statuses = ("pass", "fail", "error", "skipped")
    return results.groupBy(zone).agg(
        F.count(F.lit(1)).alias("total_rules"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    )


def rule_report(results: DataFrame, zone: str = ZONE) -> DataFrame:
    """Table for display; only executed rules show a violation count."""
    executed = F.col("status").isin("pass", "fail")
    return results.select(
        zone, "name", "column", F.upper("status").alias("status"),
        F.when(executed, F.col("violations").cast("string")).otherwise("—").alias("violations"),
        "description",
    )
