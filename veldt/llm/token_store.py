"""Token ids in wavelet matrices: one file for each shard of documents in ascending doc_id order.

A file is one shard: a header (magic, shard, counts), the documents' ids and lengths, and for each of the 16 bits of a token
id, highest first, a plane: the bits of all tokens in that level's order, with the number of ones before every 512th bit.
Planes are blocks of zstandard frames of their own. A level's zeros go before its ones in the next level, so `Wavelet` answers
access(i), rank(id, i), count(id) and select(id, k) with one rank or select a level, from the one file, and unpacks only the
blocks that it touches.

Files are written by Spark's own writer on whatever file system it has, and read back with `binaryFile`.

Defined cases: a null or empty text has the end id alone; rows that repeat a doc_id are kept, side by side; null doc_ids come
first; doc_ids that aren't whole numbers and tokenizers of more than 65,536 ids are errors before anything is written; an
empty table writes no files and gives no rows; other columns aren't read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from typing import ClassVar
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from veldt.llm.common import Stage, new_path, parts_for, table, utf8

END_ID, BITS, SUPER = 1, 16, 512
#: Bytes of a plane's block.
PLANE_BLOCK = 8192
PROBE = "The 12,5 quick-brown Fox's, jumped. Over ÉÈ ß 東京 <|x a@b.c  end.\n\tA,b. www.X.org/y?z=1 don't U.S."
#: Bytes of text in a shard, about; tokens from which a shard's rows are cut into another file; bytes of text encoded at a time.
SHARD_BYTES, FILE_TOKENS, SLICE_BYTES = 12 << 20, 4_000_000, 4 << 20
MAGIC = b"VWM2"


#: A piece that ends in ASCII marks after an ASCII letter. An apostrophe may belong to the letters after it, < to a special token.
_ENDED = re.compile(rb"([^<]*[a-z])([!-&(-/:;=-@\[-`{-~]+)").fullmatch
#: By byte: ASCII letters in lower case, ASCII marks, first bytes of the letters from À to ſ.
_LETTER, _MARK, _LATIN = (np.isin(np.arange(256), list(x)) for x in (range(97, 123), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], range(0xC3, 0xC6)))
#: × and ÷ aren't letters, and İ becomes a letter and a mark.
_NOT_LATIN = [0xC397, 0xC3B7, 0xC4B0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of words without special tokens begin: at each word, at an ASCII mark after an ASCII or Latin letter and
    at an ASCII letter after an ASCII mark other than an apostrophe. Pre-tokens and normal forms never reach across these."""
    if not len(data):
        return np.empty(0, np.int64)
    mark, begin = _MARK[data], np.zeros(len(data), bool)
    begin[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.flatnonzero(mark[1:] > mark[:-1]) + 1
    last, first = data[at - 1], data[at - 2]
    begin[at[_LETTER[last] | (_LATIN[first] & (last >= 0x80) & ~np.isin(first.astype(np.int32) << 8 | last, _NOT_LATIN))]] = True
    at = np.flatnonzero(mark[1:] < mark[:-1]) + 1
    begin[at[_LETTER[data[at]] & (data[at - 1] != ord("'"))]] = True
    return np.flatnonzero(begin)


def _laid(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts of `sizes` ids one behind the other, the ids of the parts in `order`, and where each of these ends."""
    lengths = sizes[order]
    upto = np.cumsum(lengths, dtype=np.int32)
    place = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[order] - (upto - lengths), lengths)
    place += np.arange(len(place), dtype=np.int32)
    return ids[place], upto


class Encoder:
    """Ids of texts. Where the tokenizer drops white space and never looks across it, pieces between ASCII white space are
    encoded once each and kept: two generations of up to `limit` pieces, so that frequent ones stay. Other tokenizers encode
    whole texts."""

    opened: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known, self.old, self.whole = Tokenizer.from_file(path), limit, {}, {}, False
        special = self.tokenizer.get_added_tokens_decoder()
        suffix, self.last = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            self.last = np.zeros(1 << BITS, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix) and i < 1 << BITS]] = True
        self.part_id, self.part = next(((i, t.content) for i, t in sorted(special.items()) if t.content.startswith("<|")), (None, None))
        if self.tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError(f"{path}: ids have more than {BITS} bits")
        # Words are encoded once each only where a probe has the same ids that way.
        self.whole = self.part is None or self.batch([PROBE.encode()])[0] != array("H", [*self._ids(PROBE), END_ID]).tobytes()
        self.known.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """A worker's encoder, which its later tasks use again."""
        if path not in cls.opened:
            cls.opened[path] = cls(path)
        return cls.opened[path]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text with the end id, two bytes each."""
        if self.whole:
            return [array("H", [*x.ids, END_ID]).tobytes() for x in self.tokenizer.encode_batch([t.decode(errors="replace") for t in texts], add_special_tokens=False)]
        pieces = [self._pieces(t) for t in texts]
        self._learn(list(set().union(*pieces)))
        end = struct.pack("<H", END_ID)
        return [b"".join(map(self.known.__getitem__, ps)) + end for ps in pieces]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, each text's with the end id behind them, and how many each text has. Arrow splits the
        texts and numbers their pieces, so Python sees each distinct piece once."""
        texts = pc.fill_null(texts, "")
        if self.whole or pc.any(pc.match_substring(texts, "<|")).as_py():
            found = self.batch(utf8(texts))
            return np.frombuffer(b"".join(found), "<u2"), np.array([len(x) // 2 for x in found], np.int64)
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        ids, sizes = self._dictionary(coded.dictionary.cast(pa.large_binary()))
        ids, sizes = np.append(ids, np.uint16(END_ID)), np.append(sizes, np.int32(1))
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(sizes) - 1)
        ids, upto = _laid(ids, sizes, order)
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0).astype(np.int64)

    def _dictionary(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one behind the other, and how many each has. Words are cut at marks and their parts
        numbered in turn, so that a word is encoded once whatever marks it stands with."""
        _, places, data = words.buffers()
        offsets = np.frombuffer(places, "<i8")[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begin = _cuts(data, offsets)
        parts = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
        pieces = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(pieces)
        found = [self.known[p] for p in pieces]
        ids, upto = _laid(np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int32, len(found)) // 2, parts.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(np.append(np.int32(0), upto)[np.searchsorted(begin, offsets)])

    def _learn(self, pieces: list[bytes]) -> None:
        """Afterwards `known` has all of the pieces, which are distinct."""
        fresh = [p for p in pieces if p not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.old, self.known = self.known, {}
            fresh = pieces
        if self.old:
            self.known.update((p, self.old[p]) for p in fresh if p in self.old)
            fresh = [p for p in fresh if p not in self.known]
        self._add(fresh)

    @staticmethod
    def _pieces(text: bytes) -> list[bytes]:
        """The pieces of a text in lower case, as the tokenizer has them; their case stays where a special token may occur."""
        return text.split() if b"<|" in text else text.lower().split()

    def _add(self, pieces: list[bytes]) -> None:
        """Ids of pieces that aren't known. Marks at the end, after a letter, are a pre-token of their own, so such pieces are
        made of two known ones."""
        known = self.known
        if ended := [m for m in (_ENDED(p) for p in pieces if not p.isalpha()) if m]:
            stems = {m[1] for m in ended} | {m[2] for m in ended}
            pieces = [p for p in {*pieces, *stems}.difference([m[0] for m in ended]) if p not in known]
        self._encode(pieces)
        for m in ended:
            known[m[0]] = known[m[1]] + known[m[2]]

    def _encode(self, pieces: list[bytes]) -> None:
        """Encodes many pieces in one text. Words of letters alone, in their normal form, are a pre-token each, so blanks can
        part them; what else has no special token is parted by one; the rest is encoded piece by piece."""
        simple, plain, rest = [], [], []
        for p in pieces:
            if p.isalpha() and p.islower():
                simple.append(p)
                continue
            text = p.decode(errors="replace")
            if text.isalpha() and text == text.lower() and is_normalized("NFC", text):
                simple.append(p)
            else:
                (rest if "<|" in text else plain).append((p, text))
        for i in range(0, len(simple), 4000):
            part = simple[i : i + 4000]
            ids, ends = self._words(b" ".join(part).decode())
            if len(ends) != len(part):
                raise ValueError("a word was split before encoding")
            start = 0
            for p, end in zip(part, ends, strict=True):
                self.known[p] = ids[start:end]
                start = end
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.array(self._ids(self.part.join(t for _, t in part)), "<u2")
            ends = np.flatnonzero(ids == self.part_id)
            ends, ids, start = (2 * (ends - np.arange(len(ends)))).tolist(), ids[ids != self.part_id].tobytes(), 0
            for (p, _), end in zip(part, [*ends, len(ids)], strict=True):
                self.known[p] = ids[start:end]
                start = end
        for p, text in rest:
            self.known[p] = array("H", self._ids(text)).tobytes()

    def _words(self, text: str) -> tuple[bytes, list[int]]:
        """The ids of a text of words, two bytes each, and where each word ends: at a token that only ends words, if there are
        such tokens."""
        if self.last is None:
            found = self.tokenizer.encode(text, add_special_tokens=False)
            word = np.array(found.word_ids)
            return array("H", found.ids).tobytes(), (2 * np.searchsorted(word, np.arange(word[-1] + 1), "right")).tolist()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
        return ids.tobytes(), (2 * np.flatnonzero(self.last[ids]) + 2).tolist()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def _pack(bits: np.ndarray) -> tuple[bytes, bytes]:
    """A plane's bits and the number of ones before every SUPER-th bit."""
    packed = np.zeros(-(-len(bits) // SUPER) * SUPER // 8, np.uint8)
    packed[: -(-len(bits) // 8)] = np.packbits(bits)
    ones = np.bitwise_count(packed.view("<u8")).reshape(-1, SUPER // 64).sum(1, dtype=np.uint32)
    return packed.tobytes(), np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4").tobytes()


def build(ids: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """For each bit, highest first: the number of zeros, the bits, the ones before every SUPER-th bit."""
    planes, now = [], ids.astype(np.uint16)
    for bit in range(BITS - 1, -1, -1):
        ones = (now & np.uint16(1 << bit)) != 0
        planes.append((int(len(ones) - np.count_nonzero(ones)), *_pack(ones.view(np.uint8))))
        now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
    return planes


def write_shard(shard: int, part: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    head = MAGIC + struct.pack("<qiqq", shard, part, len(doc_ids), len(ids))
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    body = [known + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes()]
    out = [head, struct.pack("<q", len(first := squeeze(body[0]))), first]
    for zeros, bits, ones in build(ids):
        blocks = [squeeze(bits[k : k + PLANE_BLOCK]) for k in range(0, len(bits), PLANE_BLOCK)]
        before = squeeze(ones)
        out += [struct.pack("<qqq", zeros, len(before), len(blocks)), before, np.array([len(x) for x in blocks], "<i4").tobytes(), *blocks]
    return b"".join(out)


def read_head(data: bytes) -> tuple[int, int, int, int]:
    """(shard, part, documents, tokens) of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    return struct.unpack_from("<qiqq", data, 4)


class Wavelet:
    """A file's documents and tokens."""

    def __init__(self, data: bytes):
        self.shard, self.part, self.docs, self.n = read_head(data)
        self.data, self.held = data, OrderedDict()
        self.plain = zstandard.ZstdDecompressor().decompress
        at = 4 + struct.calcsize("<qiqq")
        (size,) = struct.unpack_from("<q", data, at)
        head, d = self.plain(data[at + 8 : at + 8 + size]), self.docs
        at += 8 + size
        known = np.frombuffer(head, np.uint8, d)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(head, "<i8", d, d), known, strict=True)]
        self.sizes = np.frombuffer(head, "<i8", d, d + 8 * d)
        self.zeros, self.before, self.places = [], [], []
        for _ in range(BITS):
            zeros, size, blocks = struct.unpack_from("<qqq", data, at)
            at += 24
            self.zeros.append(zeros)
            self.before.append(np.frombuffer(self.plain(data[at : at + size]), "<u4"))
            sizes = np.frombuffer(data, "<i4", blocks, at + size)
            at += size + 4 * blocks
            self.places.append(at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            at = int(self.places[-1][-1])

    def block(self, level: int, k: int) -> np.ndarray:
        """The bytes of a plane's block; the last 256 blocks that were read are kept."""
        if (level, k) not in self.held:
            start, end = self.places[level][k : k + 2]
            self.held[level, k] = np.frombuffer(self.plain(self.data[start:end]), np.uint8)
            if len(self.held) > 256:
                self.held.popitem(last=False)
        return self.held[level, k]

    def plane(self, level: int) -> np.ndarray:
        start = self.places[level]
        return np.frombuffer(b"".join(self.plain(self.data[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)), np.uint8)

    def bits(self, level: int, super_: int) -> np.ndarray:
        """The bits of a plane from a SUPER-th on, SUPER of them."""
        k, at = divmod(super_ * SUPER // 8, PLANE_BLOCK)
        return np.unpackbits(self.block(level, k)[at : at + SUPER // 8])

    def bit(self, level: int, i: int) -> int:
        k, at = divmod(i >> 3, PLANE_BLOCK)
        return int(self.block(level, k)[at] >> (7 - (i & 7))) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, rest = divmod(i, SUPER)
        return int(self.before[level][block]) + (int(self.bits(level, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(BITS):
            b = self.bit(level, i)
            value = value << 1 | b
            one = self.ones(level, i)
            i = self.zeros[level] + one if b else i - one
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for level in range(BITS):
            a, b = self.ones(level, low), self.ones(level, high)
            if token >> (BITS - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0)."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - level) & 1
            i = self._find(level, one, i - self.zeros[level] if one else i)
        return i

    def _find(self, level: int, one: int, k: int) -> int:
        """The position of the k-th one or zero of a plane."""
        before = self.before[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * SUPER - before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * SUPER + int(np.flatnonzero(self.bits(level, block) == one)[k - int(before[block])])

    def tokens(self) -> np.ndarray:
        """All tokens in order, level by level from the last."""
        now = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            one = np.unpackbits(self.plane(level))[: self.n].view(bool)
            out, zeros = np.empty(self.n, np.uint16), self.zeros[level]
            out[np.flatnonzero(~one)] = now[:zeros]
            out[np.flatnonzero(one)] = now[zeros:] | np.uint16(1 << (BITS - 1 - level))
            now = out
        return now


def _files(path: str):
    """A function over a sorted partition's batches: the files of its documents, cut where one has FILE_TOKENS."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, part = Encoder.of(path), TaskContext.get().partitionId(), 0
        docs, held, sizes, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            data = write_shard(shard, part, docs, np.concatenate(sizes), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
            for start in range(0, batch.num_rows, rows):
                some = batch.slice(start, rows)
                ids, counts = encoder.column(some.column("text"))
                docs += some.column("doc_id").to_pylist()
                held.append(ids), sizes.append(counts)
                size += len(ids)
                if size >= FILE_TOKENS:
                    yield file()
                    docs, held, sizes, size, part = [], [], [], 0, part + 1
        if docs:
            yield file()

    return files


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each file: its place, its length and the checksum of its ids."""
    for batch in batches:
        for data in batch.column("content").to_pylist():
            file = Wavelet(data)
            ids, ends = file.tokens().astype("<u4"), np.cumsum(file.sizes)
            sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), file.sizes.tolist(), strict=True)]
            n = file.docs
            yield pa.RecordBatch.from_arrays(
                [pa.array([file.shard] * n, pa.int64()), pa.array([file.part] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(ends - file.sizes, pa.int64()), pa.array(file.sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array([file.n] * n, pa.int64())],
                ["shard", "part", "doc_id", "within", "n_tokens", "ids_crc32", "file_tokens"],
            )


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes the texts of docs and writes their token files under `path`, in ascending order of doc_id and text hash. The
    boundaries of shards come from Spark's range sampling, so a shard is bounded whatever the ids."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id must be a whole number")
    Encoder.of(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = texts.repartitionByRange(parts_for(docs.sparkSession, total, SHARD_BYTES), "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    files = placed.mapInArrow(_files(tokenizer), "data binary")
    files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, doc_id, within, n_tokens, ids_crc32, file_tokens) for each document of the files under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_rows, "shard long, part int, doc_id long, within long, n_tokens long, ids_crc32 long, file_tokens long")


def store(docs: DataFrame, tokenizer: str, label: str = "tokens") -> DataFrame:
    """Writes docs and reads the files back: doc_id, start (tokens of all documents before), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    write(docs, path := new_path(spark, f"{label}-files"), tokenizer)
    rows = Stage(spark, label).put("rows", read(spark, path))
    # A row for each file: 80,000 of them for 1 TB of text, so one ordered window over all is small.
    files = rows.groupBy("shard", "part").agg(F.max("file_tokens").alias("n"))
    base = files.select("shard", "part", (F.sum("n").over(Window.orderBy("shard", "part")) - F.col("n")).alias("base"))
    return rows.join(base, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "op9")
