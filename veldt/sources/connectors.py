"""Landed records of chats, issues, wikis and sites as items, and the relational work around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions import markup
from veldt.sources.items import items


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))


def slack_messages(rows: DataFrame) -> DataFrame:
    """Messages (team, channel, ts, user, text, blocks, attachments, edited_ts): text, then what blocks and attachments say."""
    said = F.array_distinct(F.array_compact(F.array(F.col("text"), markup.json_text(F.col("blocks")), markup.json_scalars(F.col("attachments")))))
    text = F.concat_ws("\n", _line("Channel", F.col("channel")), _line("User", F.col("user")), _line("Time", F.col("ts")), F.lit(""), F.array_join(said, "\n"))
    path = F.concat(F.lit("slack://"), F.col("team"), F.lit("/"), F.col("channel"), F.lit("/message-"), F.col("ts"), F.lit(".txt"))
    return items(rows, path, text, drive=F.col("channel"), owner=F.col("user"), version=F.coalesce("edited_ts", "ts"))


def slack_files(rows: DataFrame) -> DataFrame:
    """Attached files of messages, those on the service's own hosts over https."""
    each = rows.select("team", "channel", "ts", F.explode("files").alias("f")).select("*", "f.*")
    return each.filter(F.col("url").rlike(r"^https://([a-z0-9-]+\.)*slack\.com(/|$)")).select("team", "channel", "ts", "id", "name", "url")


def jira_issues(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issues with labelled lines, comments in order at the end."""
    said = comments.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created", "author", "body"))), lambda c: F.concat(F.lit("Comment by "), c["author"], F.lit(": "), c["body"])), "\n").alias("comments"))
    rows = issues.join(said, "key", "left")
    fields = [("Key", "key"), ("Summary", "summary"), ("Status", "status"), ("Reporter", "reporter"), ("Assignee", "assignee"), ("Created", "created"), ("Updated", "updated")]
    text = F.concat_ws("\n", *[_line(a, F.col(b).cast("string")) for a, b in fields], _line("Labels", F.array_join("labels", ", ")), _line("Description", F.col("description")), _line("Environment", F.col("environment")), F.col("comments"))
    path = F.concat(F.lit("atlassian://"), F.col("site"), F.lit("/jira/issues/"), F.col("key"), F.lit(".txt"))
    return items(rows, path, text, item_id=F.col("key"), version=F.col("updated").cast("string"), owner=F.col("reporter"))


def wiki_pages(pages: DataFrame, comments: DataFrame, depth: int = 32) -> DataFrame:
    """Pages, and blog posts where a column kind says so, with their comment trees: children follow their parent, level by level. Comments that go on below `depth` are an
    error, not left out."""
    level = comments.filter("parent_id is null").select("page_id", "comment_id", "body", F.lit(0).alias("depth"))
    tree = level
    for d in range(1, depth + 1):
        level = comments.join(level.select(F.col("comment_id").alias("parent_id")), "parent_id").select("page_id", "comment_id", "body", F.lit(d).alias("depth"))
        if level.isEmpty():
            break
        if d == depth:
            raise ValueError(f"comments go on below depth {depth}")
        tree = tree.unionByName(level)
    said = tree.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "comment_id", "body"))), lambda c: markup.html_text(c["body"])), "\n").alias("comments"))
    rows = pages.join(said, "page_id", "left")
    text = F.concat_ws("\n", _line("Title", F.col("title")), markup.html_text(F.col("body")), F.col("comments"))
    path = F.concat(F.lit("atlassian://"), F.col("site"), F.lit("/confluence/spaces/"), F.col("space"), F.when(F.col("kind") == "blogpost", "/blogposts/").otherwise("/pages/") if "kind" in pages.columns else F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".txt"))
    return items(rows, path, text, item_id=F.col("page_id").cast("string"), version=F.col("version").cast("string"))


def wiki_attachments(rows: DataFrame) -> DataFrame:
    """(path, name, url, item_id, version) of pages' attachments (site, space, page_id, attachment_id, title, url, version), the
    newest version of each."""
    newest = rows.groupBy("site", "space", "page_id", "attachment_id").agg(F.max_by(F.struct("title", "url"), "version").alias("a"), F.max("version").alias("version"))
    path = F.concat(F.lit("atlassian://"), F.col("site"), F.lit("/confluence/spaces/"), F.col("space"), F.lit("/pages/"), F.col("page_id").cast("string"), F.lit("/attachments/"), F.col("a.title"))
    return newest.select(path.alias("path"), F.col("a.title").alias("name"), F.col("a.url").alias("url"), F.col("attachment_id").cast("string").alias("item_id"), F.col("version").cast("string").alias("version"))


def json_records(rows: DataFrame, kind: str) -> DataFrame:
    """Any service's records (id, json) as `.json` items of their flattened text."""
    path = F.concat(F.lit(f"sharepoint-data://{kind}/"), F.col("id").cast("string"), F.lit(".json"))
    return items(rows, path, markup.json_flatten(F.col("json")), item_id=F.col("id").cast("string"), drive=F.lit(kind))


def remote_path(url: Column, path: Column) -> Column:
    """A finding's path: the web address if there is one, with what follows an archive's name."""
    return F.when(url.rlike(r"(?i)^https?://"), F.concat(url, F.regexp_extract(path, r"(!/.*)$", 1))).otherwise(path)


def wanted(rows: DataFrame, external_links: bool = False) -> DataFrame:
    """Of a change feed, what is scanned: not deleted, no link unless it leads outside and that is allowed."""
    return rows.filter(~F.col("is_deleted") & (~F.col("is_link") | (F.col("is_external") & F.lit(external_links))))


def site_tree(sites: DataFrame, roots: DataFrame, depth: int = 128) -> DataFrame:
    """(id, depth) of all sites below roots, each once at its least depth; rounds stop when nothing is new. A tree that goes
    on below `depth` is an error, not a shorter tree."""
    seen = roots.select("id", F.lit(0).alias("depth")).dropDuplicates(["id"])
    level = seen
    for d in range(1, depth + 2):
        level = sites.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct().join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"))
        if level.isEmpty():
            return seen
        if d > depth:
            raise ValueError(f"the tree goes on below depth {depth}")
        seen = seen.unionByName(level)
    return seen


def follow_links(links: DataFrame, start: DataFrame, depth: int = 128, most: int = 10_000) -> DataFrame:
    """(id, depth, cut): targets that shortcuts lead to, each once, the first `most` by depth and id; `cut` says that there
    are more."""
    found = site_tree(links.select(F.col("target_id").alias("id"), F.col("id").alias("parent_id")), start, depth).filter("depth > 0")
    return found.orderBy("depth", "id").limit(most).withColumn("cut", F.lit(found.limit(most + 1).count() > most))


def merge_drives(libraries: DataFrame, channels: DataFrame) -> DataFrame:
    """Libraries with the team that their channels name, if it is one; ids compare without regard to case."""
    teams = channels.groupBy(F.lower("id").alias("key")).agg(F.collect_set("team").alias("teams"))
    rows = libraries.join(teams, F.lower(libraries.id) == F.col("key"), "left")
    return rows.select("id", F.when(F.size("teams") == 1, F.get("teams", F.lit(0))).otherwise(F.col("name")).alias("name"), F.when(F.col("teams").isNotNull(), "Teams").otherwise(drive_type(F.col("url"))).alias("type"), "url")


def drive_type(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("-my.sharepoint.") | low.contains("/personal/"), "OneDrive").when(low.contains("/teams/"), "Teams").otherwise("SharePoint")


def expand_targets(rows: DataFrame) -> DataFrame:
    """A row for each address of comma lists (target), decoded, once each."""
    return rows.select(F.explode(F.split("target", r"\s*,\s*")).alias("t")).select(F.regexp_replace(F.url_decode(F.regexp_replace("t", r"\+", "%2B")), r"[?#].*$|/+$", "").alias("target")).filter("target <> ''").distinct()


def best_site(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """For each target the longest site path that it starts with: its beginnings, one for each separator, meet the sites by
    equality, whatever their number."""
    parts = F.split(F.lower("target"), "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    each = targets.select("target", F.explode(starts).alias("_start"))
    named = sites.groupBy(F.lower("site").alias("_start")).agg(F.min("site").alias("site"))
    return each.join(named, "_start", "left").groupBy("target").agg(F.max_by("site", F.when(F.col("site").isNotNull(), F.length("_start"))).alias("site"))


def outside_forms(path: Column, root: Column) -> Column:
    """Not the library's own Forms folder; folders that only begin so, or lie deeper, stay."""
    rest = F.lower(F.substring(path, F.length(root) + 1, F.length(path)))
    return ~(rest.startswith("/forms/") | (rest == "/forms"))


def page_after(rows: DataFrame, last: int, size: int) -> DataFrame:
    """The next page of a search by document id; of rows with one address that of the least id, content storage is left out."""
    fresh = rows.filter((F.col("doc_id") > last) & ~F.lower("url").contains("/contentstorage/"))
    fresh = fresh.groupBy("url").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "url"]), "doc_id").alias("_r")).select("url", "_r.*").select(rows.columns)
    return fresh.orderBy("doc_id").limit(size)


def cells_to_row(rows: DataFrame, *names: str) -> DataFrame:
    """Key and value cells (array of structs) as columns."""
    return rows.withColumn("m", F.map_from_entries("cells")).select(*[F.col("m").getItem(n).alias(n) for n in names])


def change_rows(rows: DataFrame) -> DataFrame:
    """Change-feed rows (path, fs_type, version, modified, root): lookup values unwrapped, a leading / added, rows outside
    the root or in its Forms folder dropped."""
    plain = F.regexp_replace("path", r"^\d+;#", "")
    path = F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))
    made = rows.select(path.alias("path"), (F.regexp_replace("fs_type", r"^\d+;#", "") == "1").alias("is_dir"), F.coalesce(F.nullif(F.col("version"), F.lit("")), F.col("modified")).alias("version"), F.lit(False).alias("is_deleted"), "root")
    return made.filter(F.lower("path").startswith(F.lower("root")) & outside_forms(F.col("path"), F.col("root"))).drop("root")


def earlier_versions(versions: DataFrame, most: int) -> DataFrame:
    """(item_id, version_id) of the versions before the current one, the newest `most`; `cut` says that there are more."""
    order = Window.partitionBy("item_id").orderBy(F.col("modified").desc(), "version_id")
    old = versions.filter(F.col("version_id") != F.col("current_id")).dropDuplicates(["item_id", "version_id"]).withColumn("n", F.row_number().over(order))
    return old.withColumn("cut", F.count("*").over(Window.partitionBy("item_id")) > most).filter(F.col("n") <= most).drop("n")


def error_class(status: Column) -> Column:
    return F.when(status.isin(401, 403, 404, 410, 423), "expected").when(status.isin(408, 429, 500, 502, 503, 504), "retry").when(status >= 400, "unexpected").otherwise("none")


def options(text: str) -> dict[str, list[str]]:
    """`key=value` options; values are comma lists."""
    return {k.strip().lower(): [v.strip() for v in vs.split(",") if v.strip()] for k, eq, vs in (x.partition("=") for x in text.split(";")) if eq}
