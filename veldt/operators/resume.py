"""What an earlier run has already inspected: fingerprints, scopes and the journal of completed items."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint() -> Column:
    """128 bits over an item's path, name, size, time and kind."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("path"), F.col("name"), F.col("size"), F.col("modified"), F.col("is_dir"))]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def scope_hash(**facts: object) -> str:
    """What a journal is for: a change of target, rules or options starts a new one."""
    return hashlib.sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def unseen(items: DataFrame, journal: DataFrame, scope: str) -> DataFrame:
    """Items whose fingerprint isn't in the scope's journal; remote items (with a web address) that have neither version nor
    time always are."""
    done = journal.filter(F.col("scope") == scope).select("fingerprint", F.lit(True).alias("_done")).distinct()
    always = F.lit(False)
    if {"version", "modified", "web_url"} <= set(items.columns):
        always = F.col("version").isNull() & F.col("modified").isNull() & F.col("web_url").isNotNull()
    marked = items.withColumn("fingerprint", fingerprint()).join(done, "fingerprint", "left")
    return marked.filter(F.col("_done").isNull() | always).drop("_done")


def completed(items: DataFrame, status: DataFrame, scope: str) -> DataFrame:
    """Journal rows of the items that were inspected in full."""
    return items.select("path", fingerprint().alias("fingerprint")).join(status.filter("is_complete").select("path"), "path", "left_semi").select(F.lit(scope).alias("scope"), "fingerprint")


def newer(rows: DataFrame, time: Column, boundary: Column, edited: Column | None = None) -> DataFrame:
    """Rows that a change feed sends: those made or edited after the boundary."""
    return rows.filter((time > boundary) | (F.coalesce(edited > boundary, F.lit(False)) if edited is not None else F.lit(False)))


def status(parts: DataFrame) -> DataFrame:
    """(path, is_complete, unexpected, reason) of items from their parts: all complete, any unexpected, the first reason."""
    return parts.groupBy("path").agg(F.bool_and("is_complete").alias("is_complete"), F.bool_or("unexpected").alias("unexpected"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ord"))).alias("reason"))


def run_status(found: DataFrame) -> DataFrame:
    """One row: ok, or partial if an item isn't complete."""
    return found.agg(F.when(F.coalesce(F.bool_and("is_complete"), F.lit(True)), "ok").otherwise("partial").alias("status"))
