"""Addresses and labels of findings: web links of connector paths, triage colours, discovery lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("Info", "Informational", "Low", "Medium", "High", "Critical")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s.lower()), F.lit(i))]), F.lower(severity)), F.lit(3))


def triage(severity: Column, report_only: Column) -> Column:
    """Black for report-only findings, Red for critical and high ones, Yellow for medium, Green for the rest."""
    s = F.lower(severity)
    return F.when(report_only, "Black").when(s.isin("critical", "high"), "Red").when(s == "medium", "Yellow").otherwise("Green")


def severity_of_triage(colour: Column) -> Column:
    """The severity that a colour stands for; colours hold less, so Red is High and Black is Info."""
    c = F.lower(colour)
    return F.when(c == "black", "Info").when(c == "red", "High").when(c == "yellow", "Medium").otherwise("Low")


def discovery(line: Column) -> list[Column]:
    """name, id, kind and url of a line `Discovered drive: name (id) [kind] - url`."""
    pattern = r"^Discovered drive: (.*) \(([^()]*)\) \[([^\[\]]*)\](?: - (.*))?$"
    return [F.regexp_extract(line, pattern, k).alias(n) for k, n in enumerate(("name", "id", "kind", "url"), 1)]


def web_link(path: Column, site: Column) -> Column:
    """The https address of a connector path under `site`; other paths stay."""
    base = F.regexp_replace(site, "/+$", "")
    of = lambda p, k=1: F.url_decode(F.regexp_extract(path, p, k))
    issue, page = r"^atlassian://[^/]+/jira/(?:projects/[^/]+/)?issues/([^/.]+)", r"^atlassian://[^/]+/confluence/(?:spaces/([^/]+)/)?(?:pages|blogposts)/([^/.]+)"
    message = r"^slack://([^/]+)/([^/]+)/message-([0-9]+)\.([0-9]+)"
    chat = F.concat(base, F.lit("/archives/"), of(message, 2), F.lit("/p"), of(message, 3), of(message, 4))
    return (
        F.when(path.rlike(issue), F.concat(base, F.lit("/browse/"), of(issue)))
        .when(path.rlike(page), F.concat(base, F.lit("/wiki/pages/viewpage.action?pageId="), of(page, 2)))
        .when(path.rlike(message), chat)
        .otherwise(path)
    )


def storage_link(path: Column, drive_url: Column) -> Column:
    """The https address of a file in a site's or person's storage, `sharepoint://drive/folder/name`, below the address of its
    drive; each part of the path is encoded by itself. Without a drive's address the path stays."""
    rest = F.regexp_extract(path, r"^sharepoint://[^/]+/(.*)$", 1)
    parts = F.array_join(F.transform(F.split(rest, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    return F.when(path.startswith("sharepoint://") & drive_url.rlike("(?i)^https?://"), F.concat(F.regexp_replace(drive_url, "/+$", ""), F.lit("/"), parts)).otherwise(path)


def blob_link(url: Column) -> Column:
    """An address without its query, fragment and access signature."""
    return F.regexp_replace(url, r"[?#].*$", "")


def with_drive(paths: DataFrame, drives: DataFrame) -> DataFrame:
    """paths (path, drive_kind, drive_name, drive_id) with the link of each: the discovered drive (kind, name, id, url) is the
    first by url of that id, or else of that kind and name, without regard to case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    by_id = drives.filter("id <> ''").groupBy(low(F.col("id")).alias("_id")).agg(F.min("url").alias("_by_id"))
    by_name = drives.groupBy(low(F.col("kind")).alias("_kind"), low(F.col("name")).alias("_name")).agg(F.min("url").alias("_by_name"))
    keyed = paths.withColumns({"_id": low(F.col("drive_id")), "_kind": low(F.col("drive_kind")), "_name": low(F.col("drive_name"))})
    found = keyed.join(by_id, "_id", "left").join(by_name, ["_kind", "_name"], "left")
    return found.select(*paths.columns, storage_link(F.col("path"), F.coalesce("_by_id", "_by_name")).alias("link"))
