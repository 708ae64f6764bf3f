"""Landed records of collaboration services (chats and channels, plans, tasks, shared mail, notebooks, search feeds) as items.

Records are JSON as the services give it, a row each; an item's text is its record's names and values, a line each. Nothing
is collected: every function is a plan over the landed tables, and what can't be read in full says so in `is_complete`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions import markup
from veldt.sources.connectors import site_tree
from veldt.sources.items import items

REFERENCE = "array<struct<contentType:string,contentUrl:string,name:string>>"


def _of(path: str, json: Column | str = "json") -> Column:
    return F.get_json_object(F.col(json) if isinstance(json, str) else json, path)


def is_storage(url: Column) -> Column:
    """An https address of the service's own file storage."""
    return url.rlike(r"(?i)^https://([a-z0-9-]+\.)+sharepoint(-df)?\.(com|us|cn|de)(:443)?(/|$)")


def sharing_id(url: Column) -> Column:
    """The identifier under which a shared address is asked for."""
    return F.concat(F.lit("u!"), F.translate(F.regexp_replace(F.base64(url.cast("binary")), "=+$", ""), "/+", "_-"))


def records(rows: DataFrame, workload: str, key: Column, name: Column, text: Column | None = None, complete: Column | None = None) -> DataFrame:
    """rows with a column `json` as items, each key once."""
    kept = rows.withColumn("_key", key).dropDuplicates(["_key"])
    path = F.concat(F.lit(f"sharepoint-data://{workload}/"), F.col("_key"), F.lit(".json"))
    return items(kept, path, markup.json_flatten(F.col("json")) if text is None else text, item_id=F.col("_key"), version=F.coalesce(_of("$.lastModifiedDateTime"), _of("$['@odata.etag']")), web_url=_of("$.webUrl"), drive=F.lit(workload), content_name=F.concat(name, F.lit(".json")), is_complete=F.lit(True) if complete is None else complete)


def teams(messages: DataFrame) -> DataFrame:
    """Messages (kind: channel or chat, team, channel, id, json), posts and replies alike."""
    key = F.concat_ws(":", "kind", "team", "channel", "id")
    return records(messages, "teams", key, F.concat(F.col("id"), F.lit(".message")))


def references(rows: DataFrame) -> DataFrame:
    """(key, name, url, sharing_id) of the files in storage that messages (key, json) attach by reference, each once."""
    each = rows.select("key", F.explode(F.from_json(_of("$.attachments"), REFERENCE)).alias("a")).filter("a.contentType = 'reference'")
    return each.filter(is_storage(F.col("a.contentUrl"))).select("key", F.coalesce("a.name", F.lit("attachment.bin")).alias("name"), F.col("a.contentUrl").alias("url"), sharing_id(F.col("a.contentUrl")).alias("sharing_id")).distinct()


def has_hosted_content(json: Column) -> Column:
    """Whether a message's body shows files that the service hosts with it."""
    return F.coalesce(F.lower(_of("$.body.content", json)).contains("hostedcontents"), F.lit(False))


def planner(rows: DataFrame) -> DataFrame:
    """Plans, their details, tasks and their details (kind, id, json)."""
    return records(rows, "planner", F.concat_ws(":", "kind", "id"), F.concat_ws(".", "id", "kind"))


def planner_references(rows: DataFrame) -> DataFrame:
    """(id, url) of the files in storage that task details refer to: the names of their references are encoded addresses."""
    names = F.map_keys(F.from_json(_of("$.references"), "map<string,string>"))
    return rows.filter("kind = 'task-details'").select("id", F.explode(names).alias("name")).select("id", F.url_decode(F.regexp_replace("name", r"\+", "%2B")).alias("url")).filter(is_storage(F.col("url"))).distinct()


def todo(lists: DataFrame, tasks: DataFrame, links: DataFrame, personal: bool = False) -> DataFrame:
    """Task lists (user, id, json) with their tasks (user, list_id, id, json) and linked resources (user, list_id, task_id, id,
    json). Unless `personal`, only lists that are shared: those of which that isn't known aren't read and count as incomplete."""
    shared = _of("$.isShared").cast("boolean")
    chosen = lists if personal else lists.filter(F.coalesce(shared, F.lit(False)))
    unknown = lists.limit(0) if personal else lists.filter(shared.isNull())
    known = chosen.select("user", F.col("id").alias("list_id")).distinct()
    of_list = records(chosen, "todo", F.concat_ws(":", "user", F.lit("list"), "id"), F.concat(F.col("id"), F.lit(".task-list")))
    of_task = records(tasks.join(known, ["user", "list_id"], "left_semi"), "todo", F.concat_ws(":", "user", "list_id", "id"), F.concat(F.col("id"), F.lit(".task")))
    of_link = records(links.join(known, ["user", "list_id"], "left_semi"), "todo", F.concat_ws(":", "user", "list_id", "task_id", F.lit("link"), "id"), F.concat(F.col("task_id"), F.lit(".linked-resource")))
    unread = records(unknown, "todo", F.concat_ws(":", "user", F.lit("list"), "id"), F.concat(F.col("id"), F.lit(".task-list")), F.lit(None).cast("string"), F.lit(False))
    return of_list.unionByName(of_task).unionByName(of_link).unionByName(unread)


def mail(mailboxes: DataFrame, folders: DataFrame, messages: DataFrame, own: str | None = None) -> DataFrame:
    """Messages (mailbox, folder_id, id, json) of the folders (mailbox, id, parent_id: null at the top) below the listed
    mailboxes (mailbox, purpose); only shared ones, never `own`; a message once, whatever folders it is in."""
    allowed = mailboxes.filter((F.col("purpose") == "shared") & ~F.coalesce(F.lower("mailbox") == F.lit((own or "").lower()), F.lit(False))).select("mailbox").distinct()
    nodes = folders.join(allowed, "mailbox", "left_semi").select(F.concat_ws("\0", "mailbox", "id").alias("id"), F.concat_ws("\0", "mailbox", "parent_id").alias("parent_id"))
    reached = site_tree(nodes, allowed.select(F.col("mailbox").alias("id"))).filter("depth > 0").select(F.col("id").alias("_folder"))
    inside = messages.join(reached, F.concat_ws("\0", "mailbox", "folder_id") == F.col("_folder"), "left_semi")
    return records(inside, "mail", F.concat_ws(":", "mailbox", "id"), F.concat(F.col("id"), F.lit(".mail")))


def mail_attachments(rows: DataFrame) -> DataFrame:
    """Attachments (parent, id, json): files as (key, kind, name), attached messages and other kinds as items of their JSON;
    a message that has attachments of its own and a mere reference are incomplete."""
    kind = F.element_at(F.split(_of("$['@odata.type']"), r"\."), -1)
    what = F.when(kind.isin("fileAttachment", "taskFileAttachment"), "file").when(kind == "itemAttachment", "message").otherwise("reference")
    whole = F.when(what == "message", ~F.coalesce(F.size(F.from_json(_of("$.item.attachments"), "array<string>")) > 0, F.lit(False))).otherwise(what == "file")
    return rows.select(F.concat_ws(":", "parent", F.lit("attachment"), "id").alias("key"), what.alias("kind"), F.coalesce(_of("$.name"), F.lit("attachment.bin")).alias("name"), whole.alias("is_complete"), F.when(what != "file", markup.json_flatten(F.col("json"))).alias("text"))


def onenote(pages: DataFrame) -> DataFrame:
    """Notebook pages (scope, id, json, html): the record's text, the page as it is, and the page's text."""
    plain = markup.html_text(F.regexp_replace("html", "<[^>]*>", " "))
    text = F.concat_ws("\n", markup.json_flatten(F.col("json")), F.col("html"), plain)
    return records(pages, "onenote", F.concat_ws(":", "scope", "id"), F.concat(F.coalesce(_of("$.title"), F.col("id")), F.lit(".page")), text)


def shared_search(hits: DataFrame) -> DataFrame:
    """Files that a search over everything accessible finds (page, json): (drive, id, name, web_url, is_complete), each file
    once; hits that name no drive or no file are rows of their own that aren't complete."""
    drive, ident = _of("$.resource.parentReference.driveId"), _of("$.resource.id")
    rows = hits.select(drive.alias("drive"), ident.alias("id"), _of("$.resource.name").alias("name"), _of("$.resource.webUrl").alias("web_url"), (drive.isNotNull() & ident.isNotNull()).alias("is_complete"))
    return rows.filter("is_complete").groupBy("drive", "id").agg(F.min("name").alias("name"), F.min("web_url").alias("web_url"), F.lit(True).alias("is_complete")).unionByName(rows.filter("not is_complete"))
