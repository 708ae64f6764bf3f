"""Text of files: decoding, a look for binary content, Office documents with what they embed, PDF; the rest is reported as
incomplete."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

MARKS = ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
MAGIC = ((b"%PDF", "pdf"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "ole"))
PARTS = 4096


@dataclass
class Embedded:
    """Budgets of what a document embeds, at any depth; equal parts are read once."""

    depth: int = 3
    parts: int = 1000
    total_bytes: int = 512 << 20
    seen: set[bytes] = field(default_factory=set)

    def take(self, data: bytes) -> bool:
        """Whether a part is read; one over the budgets is an error."""
        digest = hashlib.sha256(data).digest()
        if digest in self.seen:
            return False
        self.seen.add(digest)
        self.total_bytes -= len(data)
        if len(self.seen) > self.parts or self.total_bytes < 0:
            raise ValueError("too many embedded parts")
        return True


def _wide(head: bytes) -> str | None:
    """UTF-16 without a mark: many zeros, most of them on one side of the pairs."""
    n = len(head)
    even, odd = head[::2].count(0), head[1::2].count(0)
    if n < 4 or n % 2 or max(even, odd) <= 0.3 * n or even == odd:
        return None
    return "utf-16-le" if odd > even else "utf-16-be"


def looks_binary(head: bytes) -> bool:
    head = head[:4096]
    if not head or any(head.startswith(m) for m, _ in MARKS) or _wide(head):
        return False
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head)
    return 0 in head or control > 0.1 * len(head)


def decode(data: bytes) -> str:
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode(_wide(data[:4096]) or "utf-8", "replace")


def kind_of(data: bytes) -> str | None:
    return next((k for m, k in MAGIC if data.startswith(m)), None)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _part_text(xml: bytes, word: bool) -> str:
    """Text of a part: runs, tabs and breaks, a line end after each paragraph."""
    out = []
    wanted = {"t", "text"} | ({"instrText", "delText"} if word else {"v"})
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        name = _local(e.tag)
        if event == "start":
            out.append("\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
        elif name in wanted:
            out.append(e.text or "")
        elif name == "p":
            out.append("\n")
    return "".join(out)


def _sheets(z: zipfile.ZipFile, names: list[str]) -> str:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
    out = []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        for row in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
            cells = []
            for cell in (c for c in row if _local(c.tag) == "c"):
                value = "".join(v.text or "" for v in cell.iter() if _local(v.tag) == ("t" if cell.get("t") == "inlineStr" else "v"))
                if cell.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells.append(value)
                out += [f.text for f in cell if _local(f.tag) == "f" and f.text]
            out.append(" ".join(cells))
    out += ["".join(t.text or "" for t in ElementTree.fromstring(z.read(n)).iter() if _local(t.tag) == "t") for n in names if re.fullmatch(r"xl/comments[^/]*\.xml", n)]
    return "\n".join(out)


def office(data: bytes, budget: Embedded | None = None) -> str:
    """The text of a document, then that of the documents, archives and plain files that it embeds."""
    budget = budget or Embedded()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if len(names) > PARTS:
            raise ValueError(f"more than {PARTS} parts")
        inside = [embedded(n, z.read(n), budget) for n in sorted(names) if re.search(r"(?:^|/)embeddings/[^/]+$", n)]
        if any(n.startswith("xl/") for n in names):
            return "\n".join([_sheets(z, names), *inside])
        word = any(n.startswith("word/") for n in names)
        parts = sorted(n for n in names if re.fullmatch(r"(?:word|ppt)/(?:.*/)?[^/]+\.xml", n) and not re.search(r"/(?:theme|_rels|fonts|slideLayouts|slideMasters)/|styles|settings|fontTable|webSettings", n))
        return "\n".join([*(_part_text(z.read(n), word) for n in parts), *inside])


def embedded(name: str, data: bytes, budget: Embedded) -> str:
    """The text of an embedded part by its kind. What there is no reader for is an error: the document isn't complete then."""
    from veldt.sources import archives

    if not budget.take(data):
        return ""
    if budget.depth <= 0:
        raise ValueError("documents are embedded too deep")
    ext = ("." + name.rsplit(".", 1)[-1].lower()) if "." in name.rsplit("/", 1)[-1] else ""
    budget.depth -= 1
    try:
        if ext in READERS:
            return READERS[ext](data) if READERS[ext] is not office else office(data, budget)
        if archives.is_archive(name):
            rows = archives.expand(name, name, data, archives.Limits(entries=1000))
            if not rows[-1]["is_complete"]:
                raise ValueError(f"an embedded archive: {rows[-1]['reason']}")
            return "\n".join(embedded(r["name"], r["content"], budget) for r in rows[:-1])
        if looks_binary(data):
            raise ValueError(f"no reader for the embedded part {name}")
        return decode(data)
    finally:
        budget.depth += 1


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?[0-9.]+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> bytes:
    if token[:1] == b"<":
        plain = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((plain + b"0" * (len(plain) % 2)).decode())
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][:1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    """What a font's codes stand for."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, high, size, first = int(a, 16), int(b, 16), len(a) // 2, int(c, 16)
            if high - low > 0xFFFF:
                raise ValueError("a font's range is too wide")
            out |= {(low + k).to_bytes(size, "big"): (first + k).to_bytes(len(c) // 2, "big").decode("utf-16-be", "replace") for k in range(high - low + 1)}
    return out


def pdf(data: bytes) -> str:
    """The strings that a PDF's pages show, a line for each text move. Codes are read by the fonts' maps if there are some, else
    as Latin letters. Encrypted files, and files with pictures and no strings, are errors: there is text that isn't read."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    if re.search(rb"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", data):
        raise ValueError("encrypted")
    bodies = []
    for m in _STREAM.finditer(data):
        head = data[max(0, m.start() - 2000) : m.start()].rsplit(b"obj", 1)[-1]
        if b"/FlateDecode" in head:
            try:
                bodies.append(zlib.decompressobj().decompress(m[1], 256 << 20))
            except zlib.error as e:
                raise ValueError(f"a stream: {e}") from e
        elif b"/Filter" not in head:
            bodies.append(m[1])
    codes: dict[bytes, str] = {}
    for body in bodies:
        if b"begincmap" in body:
            codes |= _unicode_map(body)
    wide = max((len(c) for c in codes), default=0)

    def shown(value: bytes) -> str:
        if value.startswith(b"\xfe\xff"):
            return value[2:].decode("utf-16-be", "replace")
        if wide == 2 and len(value) % 2 == 0 and all(value[k : k + 2] in codes for k in range(0, len(value), 2)):
            return "".join(codes[value[k : k + 2]] for k in range(0, len(value), 2))
        return "".join(codes.get(value[k : k + 1], "") or chr(value[k]) for k in range(len(value)))

    out: list[str] = []
    for body in bodies:
        if b"BT" not in body or not re.search(rb"T[jJ]|['\"]", body):
            continue
        held: list[str] = []
        for m in _TOKEN.finditer(body):
            token = m[0]
            if token[:1] in b"(<":
                held.append(shown(_pdf_string(token)))
            elif token in (b"Tj", b"TJ"):
                out.append("".join(held))
                held = []
            elif token in (b"'", b'"'):
                out.append("\n" + "".join(held))
                held = []
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n")
            elif token[:1] == b"-" and token[1:].replace(b".", b"").isdigit() and float(token) < -200 and held:
                held.append(" ")  # a wide gap between the parts of a line
    found = re.sub(r"\n+", "\n", "".join(out)).strip("\n")
    if not found.strip() and re.search(rb"/Subtype\s*/Image", data):
        raise ValueError("pages are pictures")
    return found


#: By extension, what reads it; further readers (OCR, ...) are added by callers.
READERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf} | {e: office for e in (".docx", ".docm", ".dotx", ".dotm", ".pptx", ".pptm", ".ppsx", ".ppsm", ".potx", ".potm", ".xlsx", ".xlsm", ".xltx", ".xltm")}


def text_of(ext: str, data: bytes, readers: dict[str, Callable[[bytes], str]] = READERS) -> tuple[str | None, bool, str | None]:
    """(text, is_complete, reason) of a file."""
    from veldt.plans.catalogue import DOCUMENTS

    if ext in readers:
        try:
            return readers[ext](data), True, None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError, RuntimeError, NotImplementedError) as e:
            return None, False, f"unreadable: {e}"
    if ext in DOCUMENTS:
        return None, False, f"no reader for {ext}"
    return (None, False, "binary content") if looks_binary(data) else (decode(data), True, None)


def texts(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """files (path, ext, content) as (path, text, is_complete, reason). With `keep`, these columns stay, and `_has` says whether
    there was content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("content").to_pylist()
            rows = [text_of(e or "", d or b"") for e, d in zip(batch.column("ext").to_pylist(), data, strict=True)]
            made = {"text": pa.array([r[0] for r in rows], pa.string()), "is_complete": pa.array([r[1] for r in rows], pa.bool_()), "reason": pa.array([r[2] for r in rows], pa.string())}
            kept = {c: batch.column(c) for c in keep} | ({"_has": pa.array([d is not None for d in data], pa.bool_())} if keep else {})
            yield pa.RecordBatch.from_arrays([batch.column("path"), *made.values(), *kept.values()], ["path", *made, *kept])

    more = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in keep) + (", _has boolean" if keep else "")
    return files.select("path", "ext", "content", *keep).mapInArrow(run, f"path string, text string, is_complete boolean, reason string{more}")
