"""WARC archives: writing captures as request, response or revisit, and metadata records, and assembling them again.

Writing is a DataFrame plan: a record is one text value, its terminator (two line ends) the writer's line separator, so Spark
writes real WARC files to any file system, each gzipped as a whole and of so few records that FILE_BYTES bound it, or one
page where that alone has more. Of captures with equal payloads the one with the least page_id is written in full; the others
are revisits, which carry the HTTP header, the payload's digest and the record that they refer to.

Reading parses each file by its records' lengths, whatever its name. A transaction is assembled by concurrent-to identifiers
in whichever direction they point and over as many records as they lead: those next to a response join it, then those next to
them, until none is left that can. It is one nested row with all its requests and metadata records; payloads only travel if
they are asked for. A capture's records are together in one row, so they must fit there.

Defined cases: a null html is an empty payload; equal payloads below `min_bytes` are all responses; a null page_id never is
the one that others revisit unless no other has the payload, and then none refers to it by id; rows that tie at the least
page_id are all responses; rows that repeat are captures of their own; line ends in a url are removed; repeated concurrent-to
headers are all followed; a record between two responses belongs to that of the least id; a transaction without response is
a row with a null response; a record that can't be read has a `problem` and hides those behind it in its file, one whose
payload hasn't the digest or length that its headers name has a `problem` and is kept; page ids are of any type that casts
to a string and back; an empty table writes no records and gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, new_path, table

DATE, END = "2024-01-01T00:00:00Z", "\r\n\r\n"
#: Records and bytes of a file at most; bytes of a page's records beside its payload, about.
FILE_RECORDS, FILE_BYTES, HEADERS = 6000, 64 << 20, 4096
#: The 32 digits as `conv` writes them and as base32 does.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of a text's SHA-1: 5 hex digits are 4 of base32."""
    hexed = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _uuid(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _record(kind: str | Column, ident: Column, block: Column, **headers: Column) -> Column:
    """A record without its terminator; a header whose value is null is left out."""
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(DATE))]
    lines += [(k.replace("_", "-"), v) for k, v in headers.items()] + [("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines])
    return F.concat(head, F.lit(END), block)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of each row of pages (page_id, url, html), one text a row."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    first = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(least.alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("least.page_id").alias("first"), F.col("least.row").alias("first_row"))
    known = rows.join(first, "digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    named = lambda row, page, kind: _uuid(F.concat_ws("|", row, page, "digest", F.lit(kind)))
    ident = {k: named("row", "page_id", k) for k in ("request", "response", "metadata")}
    refers_to = F.when(revisit, named("first_row", "first", "response"))
    url = F.regexp_replace("url", r"[\r\n]", "")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    path, host = F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    about = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.col("first").cast("string"))))
    type_http = {"Content_Type": F.lit("application/http; msgtype=response")}
    made = [
        _record("request", ident["request"], ask, WARC_Target_URI=url, WARC_Concurrent_To=ident["response"], Content_Type=F.lit("application/http; msgtype=request")),
        _record(
            F.when(revisit, "revisit").otherwise("response"), ident["response"], F.concat(http, F.when(revisit, "").otherwise(F.col("html"))), WARC_Target_URI=url, WARC_Payload_Digest=digest, WARC_Refers_To=refers_to,
            WARC_Profile=F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), **type_http,
        ),
        _record("metadata", ident["metadata"], about, WARC_Target_URI=url, WARC_Concurrent_To=ident["response"], Content_Type=F.lit("application/warc-fields")),
    ]
    return known.select(F.explode(F.array(*made)).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    per_file = min(FILE_RECORDS, 3 * max(1, file_bytes // (most + HEADERS)))
    records(pages, min_bytes).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Headers (names in lower case, each with all its values) and block of each record of a file's bytes."""
    at, view = 0, memoryview(data)
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : stop if stop >= 0 else at + 16].decode("utf-8", "replace").split("\r\n")
        if stop < 0 or not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, list[str]] = {}
        for name, _, value in (x.partition(":") for x in lines):
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        if stop + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} isn't whole")
        yield headers, view[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n"))}


RECORD = "record_id string, kind string, concurrent_to array<string>, target_uri string, payload_bytes long, payload_digest string, refers_to_record string, page_id string, refers_to string, problem string"
_TYPES = {"concurrent_to": pa.list_(pa.string()), "payload_bytes": pa.int64()}
_ARROW = pa.schema([(f.split()[0], _TYPES.get(f.split()[0], pa.string())) for f in RECORD.split(", ")])


def _described(headers: dict[str, list[str]], block: memoryview) -> tuple[dict, bytes | None]:
    """A record's row and its payload; a response's payload must have the digest and the length that its headers name."""
    one = lambda name: (headers.get(name) or [None])[0]
    kind, payload = one("warc-type"), None
    row = dict.fromkeys(_ARROW.names) | {"record_id": one("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to", []), "target_uri": one("warc-target-uri")}
    if kind in ("response", "revisit"):
        head, _, body = bytes(block).partition(b"\r\n\r\n")
        length = _fields(head).get("content-length")
        row |= {"payload_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": int(length) if length and length.isdigit() else None, "refers_to_record": one("warc-refers-to")}
        if kind == "response":
            payload, got = body, base64.b32encode(hashlib.sha1(body).digest()).decode()
            if row["payload_digest"] not in (None, got):
                row["problem"] = f"the payload's digest is {got}"
            elif row["payload_bytes"] not in (None, len(body)):
                row["problem"] = f"the payload has {len(body)} bytes"
            row |= {"payload_digest": row["payload_digest"] or got, "payload_bytes": len(body) if row["payload_bytes"] is None else row["payload_bytes"]}
    elif kind == "metadata":
        found = _fields(bytes(block))
        row |= {"page_id": found.get("page-id"), "refers_to": found.get("refers-to-page-id")}
    return row, payload


def _rows_of(data: bytes) -> Iterator[tuple[dict, bytes | None]]:
    """The rows of a file; where it can't be read on, a last one of no kind that says why."""
    try:
        for headers, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
            yield _described(headers, block)
    except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
        yield dict.fromkeys(_ARROW.names) | {"concurrent_to": [], "problem": str(e)}, None


def _parsed(with_payload: bool):
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                found = list(_rows_of(data.as_py() or b""))
                if not found:
                    continue
                rows, payloads = zip(*found, strict=True)
                out = pa.RecordBatch.from_pylist(list(rows), _ARROW)
                yield out.append_column("payload", pa.array(payloads, pa.binary())) if with_payload else out

    return parsed


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under `path`, gzipped or not."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), RECORD + ", payload binary" * with_payload)


def transactions(found: DataFrame, stage: Stage) -> DataFrame:
    """The staged records with the capture_id of their transaction: the record id of its response or revisit, else what its
    records name."""
    answer = F.col("kind").isin("response", "revisit")
    named = F.col("concurrent_to") if found.schema["concurrent_to"].dataType.typeName() == "array" else F.array_compact(F.array("concurrent_to"))
    rows = stage.put("records", found.filter("kind is not null").withColumn("_to", F.coalesce(named, F.array().cast("array<string>"))).withColumn("capture_id", F.when(answer, F.col("record_id"))))
    forth = rows.select("record_id", F.explode("_to").alias("other"))
    edges = forth.unionByName(forth.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    done, left, k = rows.filter(answer), rows.filter(~answer | F.col("kind").isNull()), 0
    while True:
        known = done.select(F.col("record_id").alias("other"), F.col("capture_id").alias("_capture"))
        near = edges.join(known, "other").groupBy("record_id").agg(F.min("_capture").alias("_capture"))
        step = left.join(near, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "_capture")).select(rows.columns)
        step = stage.put(f"step{k}", step)
        added, left = step.filter("capture_id is not null"), step.filter("capture_id is null")
        done = done.unionByName(added)
        if left.isEmpty() or (k and added.isEmpty()):
            break
        k += 1
    rest = left.withColumn("capture_id", F.coalesce(F.get("_to", F.lit(0)), "record_id"))
    return done.unionByName(rest).drop("_to")


def assemble(found: DataFrame, label: str = "warc") -> DataFrame:
    """(capture_id, request, response, metadata, requests, metadata_records) for each transaction of the records: its answer,
    the first request and metadata record by their ids, and all of them."""
    rows = transactions(found, Stage(found.sparkSession, label))
    row = F.struct("record_id", *[c for c in found.columns if c != "record_id"])
    some = lambda on: F.sort_array(F.collect_list(F.when(on, row)))
    answer = F.max(F.when(F.col("kind").isin("response", "revisit"), row))
    every = rows.groupBy("capture_id").agg(answer.alias("response"), some(F.col("kind") == "request").alias("requests"), some(F.col("kind") == "metadata").alias("metadata_records"))
    return every.select("capture_id", F.get("requests", F.lit(0)).alias("request"), "response", F.get("metadata_records", F.lit(0)).alias("metadata"), "requests", "metadata_records")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    write(pages, path := new_path(spark, "op8-warc"))
    got, kind = assemble(read(spark, path), "op8"), pages.schema["page_id"].dataType
    return got.select(F.col("metadata.page_id").cast(kind).alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), F.col("metadata.refers_to").cast(kind).alias("refers_to"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first_id from p group by h),
d as (select p.page_id, strlen(p.html) as payload_bytes, f.first_id,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(p.h, 1 + (k // 4) * 5, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::bigint + 1, 1)), 'string_agg', '') as payload_digest
  from p join f using (h))
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from d
"""
