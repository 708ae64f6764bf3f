"""Archives as items: one row for each entry, with a path inside the archive, nested ones too, under shared limits."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "path string, outer string, name string, size long, content binary, is_complete boolean, reason string"
_ARROW = pa.schema([("path", pa.string()), ("outer", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("is_complete", pa.bool_()), ("reason", pa.string())])
ZIPS, TARS, STREAMS = (".zip", ".msapp"), (".tar", ".tgz", ".tbz", ".tbz2", ".txz", ".tar.gz", ".tar.bz2", ".tar.xz", ".tar.zst", ".tzst"), (".gz", ".gzip", ".bz2", ".bzip2", ".xz", ".lz", ".lzma", ".zst", ".zstd")
#: Formats that there is no reader for: reported as incomplete.
UNREAD = (".7z", ".rar")


@dataclass
class Limits:
    """Budgets of one archive and all that is nested in it."""

    depth: int = 2
    entries: int = 10_000
    entry_bytes: int = 256 << 20
    total_bytes: int = 512 << 20
    ratio: float = 200.0
    directory_bytes: int = 64 << 20


@dataclass
class _Budget:
    limits: Limits
    entries: int = 0
    total: int = 0
    reasons: list[str] = field(default_factory=list)


def entry_name(name: str) -> str | None:
    """A safe relative name with / as separator; None for absolute names, drive letters, dots and empty parts."""
    plain = name.replace("\\", "/")
    parts = plain.rstrip("/").split("/")
    bad = plain.startswith("/") or ":" in plain or "\0" in plain or any(p in ("", ".", "..") for p in parts)
    return None if bad else plain.rstrip("/")


def is_archive(name: str) -> bool:
    return name.lower().endswith((*ZIPS, *TARS, *STREAMS, *UNREAD))


def is_archive_name(name: Column) -> Column:
    return F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in (*ZIPS, *TARS, *STREAMS, *UNREAD)) + ")$")


def zip_directory(data: bytes) -> tuple[int, int] | None:
    """The number of entries that a zip's end record declares and the bytes of its directory, by the 64-bit record where the
    short one is full; None without an end record."""
    at = data.rfind(b"PK\5\6", max(0, len(data) - 22 - 65_535))
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\5\6", max(0, len(data) - 22 - 65_535), at)
    if at < 0:
        return None
    count, size = struct.unpack_from("<HI", data, at + 10)
    if (count == 0xFFFF or size == 0xFFFFFFFF) and at >= 20 and data[at - 20 : at - 16] == b"PK\6\7":
        (place,) = struct.unpack_from("<Q", data, at - 12)
        if data[place : place + 4] == b"PK\6\6" and place + 56 <= at:
            count, size = struct.unpack_from("<QQ", data, place + 32)
    return count, size


def _zstd(data: bytes) -> io.BufferedIOBase:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)


def _members(name: str, data: bytes, budget: _Budget) -> Iterator[tuple[str, bytes]]:
    low, limits = name.lower(), budget.limits

    def read(stream: io.IOBase) -> bytes | None:
        room = min(limits.entry_bytes, limits.total_bytes - budget.total)
        got = stream.read(room + 1)
        if len(got) > room:
            budget.reasons.append("an entry is over the size limit")
            return None
        budget.total += len(got)
        return got

    if low.endswith(ZIPS):
        declared = zip_directory(data)
        if declared and (declared[1] > limits.directory_bytes or declared[1] > len(data)):
            budget.reasons.append("the directory is too large")
            return
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            seen: set[str] = set()
            for info in z.infolist():
                if info.is_dir():
                    continue
                budget.entries += 1
                plain = entry_name(info.filename)
                if budget.entries > limits.entries:
                    budget.reasons.append("too many entries")
                    return
                if plain is None or plain in seen:
                    budget.reasons.append("an entry's name is unsafe or repeats")
                    continue
                seen.add(plain)
                if info.file_size > limits.ratio * max(1, info.compress_size):
                    budget.reasons.append("an entry is compressed too far")
                    continue
                if (got := read(z.open(info))) is not None:
                    yield plain, got
    elif low.endswith(TARS):
        zst = low.endswith((".tar.zst", ".tzst"))
        with tarfile.open(fileobj=_zstd(data) if zst else io.BytesIO(data), mode="r|" if zst else "r:*") as t:
            for info in t:
                if not info.isfile():
                    continue
                budget.entries += 1
                plain = entry_name(info.name)
                if plain is None or budget.entries > limits.entries:
                    budget.reasons.append("an entry's name is unsafe" if plain is None else "too many entries")
                    return
                if (got := read(t.extractfile(info))) is None:
                    return
                yield plain, got
    elif low.endswith(STREAMS):
        opener = gzip.open if low.endswith((".gz", ".gzip")) else bz2.open if low.endswith((".bz2", ".bzip2")) else _zstd if low.endswith((".zst", ".zstd")) else lzma.open
        if (got := read(opener(data if opener is _zstd else io.BytesIO(data)))) is not None:
            yield name.rsplit("/", 1)[-1].rsplit(".", 1)[0], got
    else:
        budget.reasons.append("no reader for this format")


def expand(path: str, name: str, data: bytes, limits: Limits | None = None) -> list[dict]:
    """The entries of an archive, then a row for the archive itself with its completeness."""
    budget, out = _Budget(limits or Limits()), []

    def walk(outer: str, inner: str, content: bytes, depth: int) -> None:
        try:
            for member, got in _members(inner, content, budget):
                full = f"{outer}!/{member}"
                if is_archive(member):
                    if depth < budget.limits.depth:
                        walk(full, member, got, depth + 1)
                    else:
                        budget.reasons.append("nested too deep")
                else:
                    out.append({"path": full, "outer": path, "name": member.rsplit("/", 1)[-1], "size": len(got), "content": got, "is_complete": True, "reason": None})
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError) as e:
            budget.reasons.append(f"unreadable: {e}")

    walk(path, name, data, 1)
    return [*out, {"path": path, "outer": path, "name": name, "size": len(data), "content": None, "is_complete": not budget.reasons, "reason": budget.reasons[0] if budget.reasons else None}]


def entries(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The entries of files (path, name, content). One archive, with all that is nested in it, stays within a task, which
    holds its budgets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content")), strict=True):
                yield pa.RecordBatch.from_pylist(expand(path, name, data or b"", limits), _ARROW)

    return files.select("path", "name", "content").mapInArrow(run, ENTRY)
