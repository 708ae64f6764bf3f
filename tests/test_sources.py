import io
import json
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from veldt import queries
from veldt.functions import links, markup, paths, text
from veldt.operators import policies, resume, targets, verdicts
from veldt.plans import catalogue, scan
from veldt.plans.catalogue import Catalogue, Match, Rule
from veldt.sinks import report
from veldt.sources import archives, connectors, extract, items, replay
from veldt.streaming.scan import scan_stream


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_nest_and_keep_limits(spark):
    inner = zipped([("a.txt", b"deep")])
    outer = zipped([("x/y.txt", b"plain"), ("inner.zip", inner), ("../evil.txt", b"no"), ("C:\\evil.txt", b"no")])
    rows = {r["path"]: r for r in archives.expand("nest.zip", "nest.zip", outer)}
    assert set(rows) == {"nest.zip!/x/y.txt", "nest.zip!/inner.zip!/a.txt", "nest.zip"} and not rows["nest.zip"]["is_complete"]
    bomb = archives.expand("b.zip", "b.zip", zipped([("z.txt", b"0" * 1_000_000)]))
    assert len(bomb) == 1 and bomb[0]["reason"] == "an entry is compressed too far"
    few = archives.expand("f.zip", "f.zip", zipped([(f"{k}.txt", b"x") for k in range(5)]), archives.Limits(entries=3))
    assert len(few) == 4 and few[-1]["reason"] == "too many entries"
    assert archives.expand("bad.zip", "bad.zip", b"nonsense")[0]["reason"].startswith("unreadable")
    assert archives.expand("x.7z", "x.7z", b"7z")[0]["reason"] == "no reader for this format"
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo("d/e.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tar"))
    frame = spark.createDataFrame([("t.tgz", "t.tgz", bytearray(buffer.getvalue())), ("n.zip", "n.zip", bytearray(outer))], "path string, name string, content binary")
    assert {r.path for r in archives.entries(frame).collect()} >= {"t.tgz!/d/e.txt", "n.zip!/inner.zip!/a.txt"}


def test_text_of_files(spark):
    word = zipped([("word/document.xml", "<w:document xmlns:w='w'><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p></w:document>")])
    sheet = zipped([("xl/sharedStrings.xml", "<sst><si><t>shared</t></si></sst>"), ("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c t='s'><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>")])
    assert extract.text_of(".docx", word)[0].strip() == "Hello\tthere" and "shared 7" in extract.text_of(".xlsx", sheet)[0]
    assert extract.text_of(".docx", b"broken")[1] is False and extract.text_of(".one", b"x")[2] == "no reader for .one"
    assert extract.decode("\ufeffé".encode("utf-16-le")) == "é" and extract.decode("abcd".encode("utf-16-le")) == "abcd"
    assert extract.looks_binary(b"\0\1\2abc\3\0") and not extract.looks_binary("héllo".encode()) and not extract.looks_binary(b"")
    frame = spark.createDataFrame([("a.txt", ".txt", bytearray(b"hi")), ("b.bin", ".bin", bytearray(b"\0\1"))], "path string, ext string, content binary")
    assert {r.path: (r.text, r.is_complete) for r in extract.texts(frame).collect()} == {"a.txt": ("hi", True), "b.bin": (None, False)}


def pdf_file(content, extra=b""):
    packed = zlib.compress(content)
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n" + extra + b"%%EOF"


def test_text_of_pdf_files():
    page = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\)) Tj 0 -14 Td [(wor) -20 (ld) -400 (again)] TJ T* <48692021> Tj ET"
    assert extract.text_of(".pdf", pdf_file(page)) == ("Hello (PDF)\nworld again\nHi !", True, None)
    cmap = b"2 0 obj << >>\nstream\nbegincmap 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange endcmap\nendstream\nendobj\n"
    assert extract.pdf(pdf_file(b"BT <00010002000300040001> Tj ET", cmap)) == "AbcdA"
    assert extract.text_of(".pdf", pdf_file(page, b"trailer << /Encrypt 5 0 R >>"))[1:] == (False, "unreadable: encrypted")
    assert extract.text_of(".pdf", pdf_file(b"q Q", b"3 0 obj << /Subtype /Image >> endobj"))[2] == "unreadable: pages are pictures"
    assert extract.text_of(".pdf", b"%PDF")[1] is False


def test_text_of_embedded_parts():
    word = lambda text, *more: zipped([("word/document.xml", f"<w:document xmlns:w='w'><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>"), *more])
    inner = word("inner")
    outer = word("outer", ("word/embeddings/a.docx", inner), ("word/embeddings/again.docx", inner), ("word/embeddings/b.zip", zipped([("c.txt", b"zipped"), ("d.pdf", pdf_file(b"BT (page) Tj ET"))])), ("word/embeddings/e.txt", b"plain"))
    text, whole, _ = extract.text_of(".docx", outer)
    assert whole and text.split() == ["outer", "inner", "zipped", "page", "plain"]
    assert extract.text_of(".docx", word("x", ("word/embeddings/o.bin", b"\0\1\2")))[1:] == (False, "unreadable: no reader for the embedded part word/embeddings/o.bin")
    deep = word("4")
    for k in "3210":
        deep = word(k, ("word/embeddings/n.docx", deep))
    assert extract.text_of(".docx", deep)[2] == "unreadable: documents are embedded too deep"
    unsafe = zipped([("../x.txt", b"no")])
    assert "unsafe" in extract.text_of(".docx", word("x", ("word/embeddings/z.zip", unsafe)))[2]


def test_end_records_and_zstd():
    import struct

    import zstandard

    data = zipped([(f"{k}.txt", b"x") for k in range(5)])
    assert archives.zip_directory(data)[0] == 5 and archives.zip_directory(b"PK") is None
    lying = bytearray(data)
    struct.pack_into("<I", lying, data.rfind(b"PK\5\6") + 12, 100 << 20)
    assert archives.expand("a.zip", "a.zip", bytes(lying))[-1]["reason"] == "the directory is too large"
    squeezed = zstandard.ZstdCompressor().compress(b"text")
    assert [r["content"] for r in archives.expand("a.txt.zst", "a.txt.zst", squeezed)] == [b"text", None]


def test_progress_of_a_run():
    from veldt.operators.progress import Bucket

    now = [0.0]
    bucket = Bucket(100, lambda: now[0])
    assert bucket.wait(100) == 0 and bucket.wait(50) == 0.5
    now[0] = 10.0
    assert bucket.wait(100) == 0 and bucket.wait(200) == 2.0


def test_chat_issue_and_wiki_items(spark):
    chat = spark.createDataFrame([("T", "C", "1.5", "ann", "hi", json.dumps([{"text": {"text": "block"}}]), json.dumps([{"title": "att"}]), None)], "team string, channel string, ts string, user string, text string, blocks string, attachments string, edited_ts string")
    one = connectors.slack_messages(chat).first()
    assert one.path == "slack://T/C/message-1.5.txt" and one.text.endswith("hi\nblock\natt") and one.ext == ".txt"
    issues = spark.createDataFrame([("s", "K-1", "Sum", "Open", "ann", None, "2024", "2025", ["x", "y"], "desc", None)], "site string, key string, summary string, status string, reporter string, assignee string, created string, updated string, labels array<string>, description string, environment string")
    comments = spark.createDataFrame([("K-1", "2", "bob", "second"), ("K-1", "1", "ann", "first")], "key string, created string, author string, body string")
    body = connectors.jira_issues(issues, comments).first().text
    assert "Labels: x, y" in body and body.index("first") < body.index("second") and "Assignee" not in body
    pages = spark.createDataFrame([("s", "SP", 1, "T", "<p>b &amp; c</p>", 3)], "site string, space string, page_id long, title string, body string, version int")
    tree = spark.createDataFrame([(1, 10, None, "<i>root</i>"), (1, 11, 10, "child"), (1, 12, 11, "grandchild")], "page_id long, comment_id long, parent_id long, body string")
    assert connectors.wiki_pages(pages, tree).first().text == "Title: T\nb & c\nroot\nchild\ngrandchild"


def test_site_operators(spark):
    sites = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x")], "id string, parent_id string")
    assert {(r.id, r.depth) for r in connectors.site_tree(sites, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    lib = spark.createDataFrame([("ID1", "Docs", "https://x/teams/a"), ("id2", "Own", "https://x-my.sharepoint.com/personal/u")], "id string, name string, url string")
    channels = spark.createDataFrame([("id1", "Team A"), ("ID1", "Team A")], "id string, team string")
    assert {(r.id, r.name, r.type) for r in connectors.merge_drives(lib, channels).collect()} == {("ID1", "Team A", "Teams"), ("id2", "Own", "OneDrive")}
    forms = spark.createDataFrame([("/lib/Forms/x",), ("/lib/Forms2026/x",), ("/lib/a/Forms/x",)], "path string")
    assert {r.path for r in forms.filter(connectors.outside_forms(F.col("path"), F.lit("/lib"))).collect()} == {"/lib/Forms2026/x", "/lib/a/Forms/x"}
    versions = spark.createDataFrame([("i", f"v{k}", "v3", k) for k in range(4)], "item_id string, version_id string, current_id string, modified int")
    assert {(r.version_id, r.cut) for r in connectors.earlier_versions(versions, 2).collect()} == {("v2", True), ("v1", True)}
    feed = spark.createDataFrame([("1;#lib/a", "1;#1", "", "m", "/lib"), ("1;#lib/Forms/a", "1;#0", "7", "m", "/lib"), ("1;#other/a", "1;#0", "7", "m", "/lib")], "path string, fs_type string, version string, modified string, root string")
    assert [(r.path, r.is_dir, r.version) for r in connectors.change_rows(feed).collect()] == [("/lib/a", True, "m")]
    wanted = spark.createDataFrame([("a, https%3A%2F%2Fx/b/ ,a",)], "target string")
    assert {r.target for r in connectors.expand_targets(wanted).collect()} == {"a", "https://x/b"}
    assert connectors.options("A=1, 2;b=") == {"a": ["1", "2"], "b": []}


def test_target_lines(spark):
    lines = ['10.0.0.0/30 # net', '10.0.0.4/31', '"10.0.0.2", HOST.example', "host.EXAMPLE", "10.0.0.300", "# all", "http://x", "2001:db8::1", "a//b ; c"]
    parsed = targets.parse(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    kinds = {(r.line_no, r.target): r.kind for r in parsed.collect()}
    assert kinds[4, "10.0.0.300"] == "error" and kinds[6, "http://x"] == "error" and kinds[7, "2001:db8::1"] == "host" and not any(n == 5 for n, _ in kinds)
    assert {r.target for r in targets.expand(parsed).collect()} == {"10.0.0.1", "10.0.0.2", "10.0.0.4", "10.0.0.5", "HOST.example", "2001:db8::1"}


def test_reports_replay_and_verdicts(spark, tmp_path):
    rule = Rule("Pin", (Match("Content", ("pin=[0-9]+",), extensions=(".txt",)),), "High")
    rows = items.items(spark.createDataFrame([("a/x.txt", "pin=1234 pin=77"), ("b/y.txt", "pin=9")], "path string, text string"), F.col("path"), F.col("text"))
    found = scan.findings(rows, Catalogue([rule]))
    counters = spark.createDataFrame([(2, 2, 0)], "FilesDiscovered long, FilesScanned long, Errors long")
    again = replay.from_json(report.document(found, counters)).collect()
    assert {(r.ResourcePath, r.InstanceCount) for r in again} == {("a/x.txt", 2), ("b/y.txt", 1)}
    report.write_lines(found, F.lit("x"), f"file://{tmp_path}/l")
    lines = found.withColumn("access", F.lit("RW")).select(report.triage_line().alias("line"))
    assert {(r.rule_name, r.severity, r.resource_path) for r in replay.from_triage(lines).collect()} == {("Pin", "High", "a/x.txt"), ("Pin", "High", "b/y.txt")}
    blocks = found.select(F.col("resource_path").alias("file"), F.posexplode(F.split(report.report_text(), "\n")).alias("line_no", "line"))
    assert {(r.rule_name, r.severity, r.resource_path) for r in replay.from_report(blocks).collect()} == {("Pin", "High", "a/x.txt"), ("Pin", "High", "b/y.txt")}
    judged = verdicts.judged(found, lambda p: 'so: {"is_sensitive": false, "reason": "toy"}' if "b/y" in p or "pi***" in p else "no json")
    assert {r.llm_status for r in judged.collect()} <= {"Rejected", "Error"} and verdicts.judged(found, None).filter("llm_status <> 'Skipped'").count() == 0
    assert verdicts.answer('x {"is_sensitive": true, "reason": "r"} y') == ("Confirmed", True, "r")
    assert policies.rule_stats(scan.raw(rows, Catalogue([rule]))).first().matches == 3


def test_scalar_functions(spark):
    frame = spark.createDataFrame([("aabb", "\\\\?\\UNC\\srv.x\\Share\\d/f.TAR.GZ")], "v string, p string")
    got = frame.select(text.entropy(F.col("v")).alias("e"), text.entropy(F.lit("")).alias("z"), text.mask(F.lit("ab")).alias("m"), paths.share(F.col("p")).alias("s"), paths.extension(paths.leaf(F.col("p"))).alias("x"), paths.same_host(F.lit("srv"), F.lit("SRV.x")).alias("h"), paths.same_host(F.lit("10.0.0.1"), F.lit("10.0.0.1.x")).alias("n"), paths.likes(F.lit("A\\b.txt"), "a\\\\*.t?t").alias("w"), text.highlight(F.lit("abcd"), F.lit(1), F.lit(2)).alias("l"), links.web_link(F.lit("atlassian://s/jira/issues/K-1.txt"), F.lit("https://s/")).alias("u"), markup.merge_json(F.lit('{"a":"1"}'), F.lit('{"b":"2"}')).alias("j")).first()
    assert (got.e, got.z, got.m, got.s, got.x, got.h, got.n, got.w, got.l) == (1.0, 0.0, "**", "Share", ".gz", True, False, True, "a[[bc]]d")
    assert got.u.startswith("https://s/browse/K-1") and json.loads(got.j) == {"a": "1", "b": "2"}


def test_stream_skips_what_is_done(spark, tmp_path):
    rule = Rule("Pin", (Match("Content", ("pin=[0-9]+",), extensions=(".txt",)),))
    source = tmp_path / "in"
    schema = "path string, text string, item_id string, version string"

    def add(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        made = items.items(rows, F.col("path"), F.col("text"), item_id=F.col("item_id"), version=F.col("version"))
        scan_stream(made, Catalogue([rule]), f"{tmp_path}/out", f"{tmp_path}/journal", f"{tmp_path}/check", resume.scope_hash(rule="Pin")).awaitTermination()
        return sorted(r.resource_path for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add("a", ("x.txt", "pin=1", "1", "1"), ("y.txt", "none", "2", "1"))
    assert run() == ["x.txt"]
    add("b", ("x.txt", "pin=1", "1", "1"), ("z.txt", "pin=3", "3", "1"))
    assert run() == ["x.txt", "z.txt"]
    assert run() == ["x.txt", "z.txt"]


def test_zip_expand_reads_all_documents(spark, tmp_path):
    rows = [(i, "en", "s", f"text {i}") for i in range(0, 12_000, 7)] + [(3, "en", "s", "one"), (3, "en", "s", "again"), (4, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    archive = lambda i: "s.zip" if i < 1000 else f"s-{i // 1000}.zip"
    got = sorted((r.path, r.size) for r in queries.QUERIES["zip_expand"](spark, str(tmp_path)).collect())
    assert got == sorted((f"a/{archive(i)}!/en/{i}.txt", len(t or "")) for i, _, _, t in rows)


def test_bundled_rules_on_archives(spark):
    data = zipped([("conf/.env", b"x"), ("cards.txt", b"4111 1111 1111 1111")])
    frame = spark.createDataFrame([("a.zip", "a.zip", bytearray(data))], "path string, name string, content binary")
    entries = archives.entries(frame).filter("content is not null")
    rows = entries.withColumn("ext", paths.extension(F.col("name"))).select("path", "ext", "content")
    read = items.items(extract.texts(rows), F.col("path"), F.col("text"))
    assert {(r.rule_name, r.resource_path) for r in scan.findings(read, catalogue.load()).collect()} == {("Shell RC / Environment File", "a.zip!/conf/.env"), ("Credit Card Number", "a.zip!/cards.txt")}
