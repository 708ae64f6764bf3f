"""Findings as a result document, a text report, triage lines, and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions import links, text

COUNTERS = ("FilesDiscovered", "FilesScanned", "Findings", "Errors")


def stored(findings: DataFrame) -> DataFrame:
    """findings under the names that result documents use."""
    return findings.select(F.col("rule_name").alias("RuleName"), F.col("rule_name").alias("PolicyName"), F.col("classifier_name").alias("ClassifierName"), F.col("resource_path").alias("ResourcePath"), F.col("severity").alias("Severity"), F.col("confidence").alias("Confidence"), F.col("confidence_level").alias("ConfidenceLevel"), F.col("value").alias("RedactedValue"), F.col("value_hash").alias("ValueHash"), F.col("snippet").alias("Snippet"), F.col("snippet_start").alias("SnippetMatchStart"), F.col("instance_count").alias("InstanceCount"), F.col("report_only").alias("IsReportOnly"))


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines: the table that grows. `document` makes the one document of a run that fits a row."""
    stored(findings).write.json(path)


def document(findings: DataFrame, counters: DataFrame) -> DataFrame:
    """One JSON document of a run in a column `document`, for results of a size that one row can hold; counters is one row
    (FilesDiscovered, FilesScanned, Errors)."""
    rows = stored(findings)
    every = rows.agg(F.coalesce(F.array_sort(F.collect_list(F.struct("ResourcePath", "RuleName", *[c for c in rows.columns if c not in ("ResourcePath", "RuleName")]))), F.array()).alias("FindingsList"), F.count("*").alias("Findings"))
    return every.crossJoin(counters).select(F.to_json(F.struct(F.lit("1.0").alias("SchemaVersion"), *COUNTERS, "FindingsList")).alias("document"))  # one row each


def append(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Counters of a run added to those before."""
    return previous.unionByName(current).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def report_text() -> Column:
    """A finding as a block of a text report."""
    return F.concat_ws("\n", F.concat(F.lit("Finding: "), F.col("rule_name")), F.concat(F.lit("  Risk: "), F.col("severity")), F.concat(F.lit("  Path: "), F.col("resource_path")), F.concat(F.lit("  Evidence: "), text.evidence(F.coalesce("snippet", "value"))))


def triage_line() -> Column:
    """A finding as `[File] {colour}<rule|access|value>(path) snippet`."""
    return F.format_string("[File] {%s}<%s|%s|%s>(%s) %s", links.triage(F.col("severity"), F.col("report_only")), F.col("rule_name"), F.coalesce("access", F.lit("R")), F.coalesce("value", F.lit("")), F.col("resource_path"), F.coalesce(text.one_line(F.col("snippet")), F.lit("")))


def write_lines(findings: DataFrame, line: Column, path: str) -> None:
    findings.select(line.alias("value")).write.text(path)


def summary(items: DataFrame, findings: DataFrame, status: DataFrame) -> DataFrame:
    """One row of counters of a run."""
    a = items.agg(F.count("*").alias("FilesDiscovered"))
    b = status.agg(F.count("*").alias("FilesScanned"), F.coalesce(F.sum((~F.col("is_complete")).cast("long")), F.lit(0)).alias("Errors"))
    c = findings.agg(F.count("*").alias("Findings"))
    return a.crossJoin(b).crossJoin(c).select(*COUNTERS)  # one row each


def warnings(rows: DataFrame, most: int = 8) -> DataFrame:
    """The first `most` warnings by text, and how many there are in all."""
    return rows.orderBy("message").limit(most).crossJoin(rows.agg(F.count("*").alias("total")))  # one row on the right
