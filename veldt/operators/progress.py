"""How far a scan has come: what it may commit, where its feeds go on, and what a run reports about itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, FAILED, PARTIAL, CANCELLED = 0, 2, 3, 130


def committed(items: DataFrame, status: DataFrame) -> DataFrame:
    """The items (path, ...) that were inspected in full by status (path, is_complete): the journal takes these alone."""
    return items.join(status.groupBy("path").agg(F.bool_and("is_complete").alias("_whole")).filter("_whole").select("path"), "path", "left_semi")


def advanced(feeds: DataFrame, queued: DataFrame, status: DataFrame) -> DataFrame:
    """(drive, token, reset) of feeds (drive, token, new_token): a drive gets its new token once every queued item (drive, path)
    has a status and is complete, and keeps its old one until then. An empty new token says that the old one has expired: the
    drive's state is discarded and it counts anew."""
    done = status.groupBy("path").agg(F.bool_and("is_complete").alias("whole"))
    held = queued.join(done, "path", "left").groupBy("drive").agg(F.bool_and(F.coalesce("whole", F.lit(False))).alias("all"))
    rows, expired = feeds.join(held, "drive", "left"), F.col("new_token") == ""
    token = F.when(expired, None).when(F.coalesce("all", F.lit(True)), F.col("new_token")).otherwise(F.col("token"))
    return rows.select("drive", token.alias("token"), F.coalesce(expired, F.lit(False)).alias("reset"))


def resumed(feeds: DataFrame, saved: DataFrame) -> DataFrame:
    """(feed, cursor, reset) of feeds (feed, filters): the saved cursor (feed, filters, cursor) where it was made with the same
    filters; else reading starts over."""
    last = saved.groupBy("feed").agg(F.max_by("filters", "cursor").alias("_filters"), F.max("cursor").alias("_cursor"))
    same = F.col("_filters") == F.sha2("filters", 256)
    return feeds.join(last, "feed", "left").select("feed", F.when(same, F.col("_cursor")).alias("cursor"), F.coalesce(~same, F.lit(False)).alias("reset"))


def guarded(pages: DataFrame, most: int) -> DataFrame:
    """(feed, n_pages, is_complete, reason) of pages (feed, page, next_link): a continuation that repeats or more than `most`
    pages leave a feed incomplete."""
    found = pages.groupBy("feed").agg(F.count("*").alias("n_pages"), (F.count("next_link") > F.count_distinct("next_link")).alias("again"))
    reason = F.when(F.col("again"), "a continuation repeats").when(F.col("n_pages") > most, "too many pages")
    return found.select("feed", "n_pages", reason.isNull().alias("is_complete"), reason.alias("reason"))


def falling(rows: DataFrame) -> DataFrame:
    """(feed, is_complete) of search pages (feed, page, doc_id): the ids of a page must be greater than those before it."""
    ends = rows.groupBy("feed", "page").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    order = F.array_sort(F.collect_list(F.struct("page", "low", "high")))  # a row for each page of a feed
    pairs = ends.groupBy("feed").agg(order.alias("p"))
    wrong = F.exists(F.transform("p", lambda x, i: F.coalesce(x["low"] <= F.get("p", i - 1)["high"], F.lit(False)) & (i > 0)), lambda w: w)
    return pairs.select("feed", (~wrong).alias("is_complete"))


def retry_at(responses: DataFrame) -> DataFrame:
    """(host, until) of responses (host, at, retry_after in seconds): the greatest wait holds for all requests of a host."""
    return responses.filter("retry_after is not null").groupBy("host").agg(F.max(F.col("at") + F.make_dt_interval(secs=F.col("retry_after"))).alias("until"))


class Bucket:
    """A limit of bytes a second with a burst of one second; what is over waits. `clock` gives seconds."""

    def __init__(self, rate: float, clock: Callable[[], float]):
        self.rate, self.clock, self.free, self.at = rate, clock, rate, clock()

    def wait(self, size: int) -> float:
        """Seconds to wait before `size` bytes are read; they are taken from the bucket at once."""
        now = self.clock()
        self.free = min(self.rate, self.free + (now - self.at) * self.rate) - size
        self.at = now
        return max(0.0, -self.free / self.rate)


def latest(rows: DataFrame, by: str, *times: Column) -> DataFrame:
    """(by, latest): the greatest of several decimal times, nulls apart; null where a key has none."""
    plain = [t.cast("decimal(20,6)") for t in times]
    return rows.groupBy(by).agg(F.max(F.greatest(*plain) if len(plain) > 1 else plain[0]).alias("latest"))


def source_counts(items: DataFrame) -> DataFrame:
    """(drive, n) of the items found in each source that has some."""
    return items.filter("drive is not null").groupBy("drive").agg(F.count("*").alias("n"))


def by_name(rows: DataFrame, name: str) -> DataFrame:
    """rows in the order of a name without regard to case, then of the name itself."""
    return rows.orderBy(F.lower(name), name)


def exit_code(status: DataFrame, failed: bool = False, cancelled: bool = False) -> DataFrame:
    """One row: 130 if the run was cancelled, 2 if it failed, 3 if an item isn't complete, else 0."""
    if cancelled or failed:
        return status.sparkSession.range(1).select(F.lit(CANCELLED if cancelled else FAILED).alias("code"))
    return status.agg(F.when(F.coalesce(F.bool_and("is_complete"), F.lit(True)), OK).otherwise(PARTIAL).alias("code"))


def diagnostics(items: DataFrame, status: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts of a run as (section, name, n): items by extension, items by why they are incomplete, findings by rule."""
    part = lambda rows, section, name: rows.groupBy(F.lit(section).alias("section"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return part(items, "items", "ext").unionByName(part(status.filter("not is_complete"), "incomplete", "reason")).unionByName(part(findings, "findings", "rule_name"))


def with_access(items: DataFrame, exposure: DataFrame, access: DataFrame) -> DataFrame:
    """items with what their access lists say: exposure and access (path, ...), null where nothing is known."""
    return items.join(exposure, "path", "left").join(access, "path", "left")


def single(items: DataFrame, path: str) -> DataFrame:
    """The one item of a path, whatever its separators and case; no row if there is none."""
    plain = path.replace("/", "\\").rstrip("\\").lower()
    return items.filter(F.lower(F.rtrim(F.translate("path", "/", "\\"), F.lit("\\"))) == plain)
