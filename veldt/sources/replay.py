"""Stored results read back as findings: result documents, text reports, one-line triage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions import links

FINDING = "RuleName string, PolicyName string, ClassifierName string, ResourcePath string, Severity string, Confidence double, ConfidenceLevel string, RedactedValue string, ValueHash string, Snippet string, SnippetMatchStart int, InstanceCount long, IsReportOnly boolean, Owner string, Exposure string, LlmValidationStatus string, LlmIsSensitive boolean, LlmReason string"
DOCUMENT = f"SchemaVersion string, FilesDiscovered long, FilesScanned long, Findings long, Errors long, FindingsList array<struct<{FINDING}>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The findings of result documents."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).select(F.explode("FindingsList").alias("f")).select("f.*")


def from_json(documents: DataFrame) -> DataFrame:
    """The findings of result documents in a column `document`."""
    return documents.select(F.from_json("document", DOCUMENT).alias("d")).select(F.explode("d.FindingsList").alias("f")).select("f.*")


#: Labels of a report's lines and the columns they fill.
LABELS = {"Risk": "severity", "Path": "resource_path", "Evidence": "evidence", "Owner": "owner", "Last edit": "last_edited", "LLM": "llm_status", "Reason": "llm_reason"}


def from_report(lines: DataFrame) -> DataFrame:
    """The findings of text reports (file, line_no, line): a block begins with `Finding:`, labelled lines follow."""
    plain = F.regexp_replace("line", "\\x1B\\[[0-9;]*[A-Za-z]", "")
    order = Window.partitionBy("file").orderBy("line_no")
    block = F.sum(F.col("line").rlike(r"^\s*Finding:").cast("int")).over(order)
    rows = lines.withColumn("line", plain).withColumn("block", block).filter("block > 0")
    label, value = F.trim(F.regexp_extract("line", r"^\s*([A-Za-z ]+):\s?(.*)$", 1)), F.trim(F.regexp_extract("line", r"^\s*([A-Za-z ]+):\s?(.*)$", 2))
    of = lambda name: F.min_by(value, F.when((label == name) & (value != ""), F.col("line_no")))
    return rows.groupBy("file", "block").agg(of("Finding").alias("rule_name"), *[of(k).alias(v) for k, v in LABELS.items()])


def report_counters(lines: DataFrame) -> DataFrame:
    """The counters at a report's end: (file, name, value)."""
    pattern = r"^\s*(Files discovered|Files scanned|Findings|Errors):\s*([0-9,]+)\s*$"
    return lines.filter(F.col("line").rlike(pattern)).select("file", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", pattern, 2), ",", "").cast("long").alias("value"))


TRIAGE = r"^.*?\[File\] \{(\w+)\}<([^|>]*)\|([^|>]*)\|?([^>]*)>\((.*?)\)(?: (.*))?$"


def from_triage(lines: DataFrame) -> DataFrame:
    """Findings of `[File] {colour}<rule|access|...>(path) snippet` lines."""
    part = lambda k: F.regexp_extract("line", TRIAGE, k)
    return lines.filter(F.col("line").rlike(TRIAGE)).select(part(2).alias("rule_name"), links.severity_of_triage(part(1)).alias("severity"), part(3).alias("access"), part(5).alias("resource_path"), part(6).alias("snippet"))


def kind_of(head: Column) -> Column:
    """Which of the formats a file's first characters are of."""
    return F.when(F.ltrim(head).startswith("{"), "json").when(head.rlike(r"(?m)^\s*Finding:"), "report").when(head.rlike(r"\[File\] \{"), "triage").otherwise("unknown")
