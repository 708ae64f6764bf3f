"""Policies: which paths they cover, what they report, and how findings aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.functions import links, paths, text
from veldt.plans.catalogue import Catalogue, Policy


def covers(policy: Policy, path: Column) -> Column:
    """Any of the include patterns, if there are some, and none of the exclude patterns, on the whole path."""
    some = lambda ps: reduce(lambda a, b: a | b, (paths.likes(path, p) for p in ps))
    out = some(policy.include_paths) if policy.include_paths else F.lit(True)
    return out & ~some(policy.exclude_paths) if policy.exclude_paths else out


def table(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """A row for each link of an active policy to a detector; as large as the catalogue."""
    known = {r.name: k for k, r in enumerate(catalogue.flat())}
    rows = [(known[c], c, p.name, p.severity, p.report_only, p.min_match, p.stop, k) for k, p in enumerate(catalogue.reporting()) for c in dict.fromkeys(p.classifiers) if c in known]
    return spark.createDataFrame(rows, "ord int, classifier string, policy string, severity string, report_only boolean, min_match int, stop boolean, policy_ord int")


def scoped(rows: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Without rows whose policy doesn't cover their path; no test is made for policies without paths."""
    tests = [(F.col("policy") == p.name) & ~covers(p, F.col("path")) for p in catalogue.reporting() if p.include_paths or p.exclude_paths]
    return rows.filter(~reduce(lambda a, b: a | b, tests)) if tests else rows


def stop_early(rows: DataFrame) -> DataFrame:
    """Of each item, the matches up to and with the first of a policy that stops; by rule order, then place."""
    order = F.struct("ord", "idx", "policy_ord")
    first = F.min(F.when(F.col("stop"), order)).over(Window.partitionBy("item", "path"))
    return rows.withColumn("_stop", first).filter(F.col("_stop").isNull() | (order <= F.col("_stop"))).drop("_stop")


def raw_findings(spark: SparkSession, metadata: DataFrame, candidates: DataFrame, catalogue: Catalogue, keep_values: bool = False) -> DataFrame:
    """A row for each match and policy. Values are masked and hashed unless `keep_values`."""
    links_ = F.broadcast(table(spark, catalogue))  # rows of the catalogue, not of the data
    none = lambda t: F.lit(None).cast(t)
    direct = metadata.filter("direct").select("item", "path", F.col("resource"), "ord", F.lit(-1).alias("idx"), F.lit("[METADATA MATCH]").alias("value"), none("string").alias("snippet"), none("int").alias("snippet_start"), F.lit(1.0).alias("confidence"), F.lit("High").alias("confidence_level"), F.lit(True).alias("is_metadata"))
    found = candidates.select("item", "path", F.col("path").alias("resource"), "ord", "idx", "value", "snippet", "snippet_start", "confidence", F.lit("Medium").alias("confidence_level"), F.lit(False).alias("is_metadata"))
    rows = scoped(direct.unionByName(found).join(links_, "ord"), catalogue)
    if any(p.stop for p in catalogue.reporting()):
        rows = stop_early(rows)
    value = F.col("value") if keep_values else F.when(F.col("is_metadata"), F.col("value")).otherwise(text.mask(F.col("value")))
    hidden = F.col("snippet") if keep_values else F.when(F.col("is_metadata"), F.col("snippet")).otherwise(F.replace(F.col("snippet"), F.col("value"), text.mask(F.col("value"))))
    return rows.select("item", "path", "resource", "policy", "classifier", "severity", links.severity_rank(F.col("severity")).alias("severity_rank"), "confidence", "confidence_level", "is_metadata", (F.col("report_only") & F.col("is_metadata")).alias("report_only"), value.alias("value"), F.when(F.col("is_metadata"), F.lit(None)).otherwise(text.value_hash(F.col("value"))).alias("value_hash"), hidden.alias("snippet"), "snippet_start", "min_match", "ord", "idx")


def aggregate(raw: DataFrame) -> DataFrame:
    """One finding for each policy, detector and resource of an item: the first match by rule order and place, with the number
    of matches, where the policy's least number is reached. Partial aggregation goes before the one shuffle."""
    first = F.struct("ord", "idx", "value", "value_hash", "snippet", "snippet_start", "confidence", "confidence_level", "is_metadata", "report_only", "severity", "severity_rank")
    found = raw.groupBy("policy", "classifier", "resource", "item").agg(F.min_by(first, F.struct("ord", "idx")).alias("f"), F.count("*").alias("instance_count"), F.max("min_match").alias("min_match"))
    kept = found.filter(F.col("instance_count") >= F.col("min_match"))
    fields = ["value", "value_hash", "snippet", "snippet_start", "confidence", "confidence_level", "is_metadata", "report_only", "severity", "severity_rank"]
    return kept.select(F.col("policy").alias("rule_name"), F.col("classifier").alias("classifier_name"), F.col("resource").alias("resource_path"), F.col("item").alias("item_id"), *[F.col(f"f.{c}").alias(c) for c in fields], "instance_count")


def rule_stats(raw: DataFrame) -> DataFrame:
    """Matches by policy before they aggregate."""
    return raw.groupBy("policy", "classifier").agg(F.count("*").alias("matches"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"), F.sum("instance_count").alias("matches"))


def missing(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """Detectors that policies name and no rule has."""
    return policies.select("classifier").distinct().join(rules.select(F.col("rule").alias("classifier")), "classifier", "left_anti")


