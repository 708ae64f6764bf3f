"""Items to scan, one schema whatever they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import markup, paths
from veldt.sources import archives, extract

#: What scans read; a source gives these and may give more.
#: and what says whether all of an item could be read, if that is known.
COLUMNS = ("path", "name", "ext", "is_dir", "size", "modified", "text", "drive", "item_id", "version", "owner", "web_url", "content_name")
STATUS = ("is_complete", "reason")


def items(rows: DataFrame, path: Column, text: Column, **more: Column) -> DataFrame:
    """rows as items: a path, a text, and what else is known; the name and extension follow from content_name or the path."""
    text = text.cast("string")
    given = {"is_dir": F.lit(False), "size": F.octet_length(text).cast("long"), "modified": F.lit(None).cast("timestamp"), "drive": F.lit(None).cast("string"), "item_id": path, "version": F.lit(None).cast("string"), "owner": F.lit(None).cast("string"), "web_url": F.lit(None).cast("string"), "content_name": F.lit(None).cast("string")} | more
    name = F.coalesce(given["content_name"], paths.leaf(path))
    given |= {"path": path, "text": text, "name": name, "ext": paths.extension(name)}
    return rows.select(*[given[c].alias(c) for c in (*COLUMNS, *STATUS) if c in given])


def documents(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return items(docs, path, F.col("text"), drive=F.col("source"), item_id=F.col("doc_id").cast("string"))


def pages(rows: DataFrame, as_text: bool = True) -> DataFrame:
    text = markup.html_text(F.col("html")) if as_text else F.col("html")
    name = F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".txt"))
    return items(rows, F.regexp_replace("url", r"#.*$", ""), text, item_id=F.col("page_id").cast("string"), web_url=F.col("url"), content_name=name)


def conversations(rows: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Chat messages with header lines before their text."""
    path = F.format_string(f"slack://{workspace}/conv-%d/message-%d.txt", "conv_id", "turn")
    text = F.concat_ws("\n", F.concat(F.lit("Channel: conv-"), F.col("conv_id").cast("string")), F.concat(F.lit("User: "), F.col("role")), F.concat(F.lit("Message: "), F.col("turn").cast("string")), F.lit(""), F.col("text"))
    return items(rows, path, text, drive=F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), owner=F.col("role"))


def events(rows: DataFrame) -> DataFrame:
    path = F.format_string("events/%s/%d.json", "event_type", "event_id")
    return items(rows, path, F.col("props"), modified=F.col("ts").cast("timestamp"), drive=F.col("event_type"), item_id=F.col("event_id").cast("string"))


def files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """The files below a folder with their bytes; filters on path and size are applied before content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    name = paths.leaf(F.col("path"))
    return rows.select("path", name.alias("name"), paths.extension(name).alias("ext"), F.lit(False).alias("is_dir"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def read_files(found: DataFrame, limits: archives.Limits | None = None) -> DataFrame:
    """files (path, name, content and what else is known) as items with their texts: archives as their entries, nested ones
    too, and as an item of their own without text; each with is_complete and reason."""
    packed = archives.is_archive_name(F.col("name"))
    inside = archives.entries(found.filter(packed).select("path", "name", "content"), limits)
    more = [c for c in ("modified", "owner", "drive") if c in found.columns]
    whole = found.filter(~packed).select("path", "name", "content", *more, F.lit(True).alias("is_complete"), F.lit(None).cast("string").alias("reason"))
    entries = inside.select("path", "name", "content", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more], "is_complete", "reason")
    parts = whole.unionByName(entries).withColumn("ext", paths.extension(F.col("name"))).withColumnsRenamed({"is_complete": "_whole", "reason": "_why"}).withColumn("size", F.octet_length("content").cast("long"))
    read = extract.texts(parts, ("name", "size", "_whole", "_why", *more))
    # An archive's own row has no content to read: its completeness is that of the unpacking.
    known = {"is_complete": F.col("_whole") & F.when(F.col("_has"), F.col("is_complete")).otherwise(True), "reason": F.coalesce("_why", F.when(F.col("_has"), F.col("reason")))}
    return items(read, F.col("path"), F.when(F.col("_has"), F.col("text")), size=F.col("size"), content_name=F.col("name"), **known, **{c: F.col(c) for c in more})


def with_directories(found: DataFrame) -> DataFrame:
    """The items' directories as rows of their own (path, name, is_dir), once each, beside the items' paths."""
    above = found.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    dirs = above.select("path", paths.leaf(F.col("path")).alias("name"), F.lit(True).alias("is_dir"))
    return found.select("path", "name", "is_dir").unionByName(dirs)
