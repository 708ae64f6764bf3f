"""Scans: items and a catalogue in, findings out.

    items -> without ignored -> metadata matches (expression) -> gates
          -> keywords and places of rules (Arrow) -> policies (broadcast) -> group by rule, resource and item

The whole of it is one narrow stage and one shuffle, of findings alone. An item is told by its item_id, or by its path where
it has none: items without an id that share a path count as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import content, ignore, metadata, policies
from veldt.plans.catalogue import DOCUMENTS, Catalogue


@dataclass(frozen=True)
class Options:
    """binary: read the text of documents; enumerate_only: metadata rules alone; keep_values: raw values in findings; reading:
    windows of texts, and sampling of long ones."""

    binary: bool = False
    enumerate_only: bool = False
    keep_values: bool = False
    reading: content.Reading = content.Reading()


def prepared(items: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Items that aren't ignored, with their metadata matches."""
    kept = ignore.keep(items, catalogue.ignore).withColumn("item", F.coalesce("item_id", "path"))
    return kept.withColumn("metadata", metadata.metadata_matches(catalogue.flat(), F.col("path"), F.col("name")))


def raw(items: DataFrame, catalogue: Catalogue, options: Options = Options()) -> DataFrame:
    """A row for each match and policy."""
    spark, rules = items.sparkSession, catalogue.flat()
    ready = prepared(items, catalogue)
    hits = metadata.explode_matches(ready.select("item", "path", "metadata"))
    texts = ready.filter("false") if options.enumerate_only else ready
    if not options.binary:
        texts = texts.filter(~content.one_of(F.col("ext"), DOCUMENTS))
    named = texts.select("item", "path", "ext", "text", metadata.opened(rules, F.col("path"), F.col("name")).alias("opened"))
    return policies.raw_findings(spark, hits, content.candidates(named, rules, options.reading), catalogue, options.keep_values)


def findings(items: DataFrame, catalogue: Catalogue, options: Options = Options()) -> DataFrame:
    return policies.aggregate(raw(items, catalogue, options))
