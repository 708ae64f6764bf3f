"""Benchmark decontamination with suffix arrays over the training documents.

Each shard of documents gets a suffix array: the positions of its words, sorted by the words that follow (to the length of a
window). Every suffix of every benchmark item is searched in every shard by bisection; the range found gives all places of
its longest verbatim match, which is then extended word by word to its full length. Suffixes that start with words no item
has can't be found and are left out of the array. Documents are whole within a shard, so one pass over them decides each,
without a shuffle. The benchmark is read in blocks of a proven size, each of which meets all shards.

Defined cases: null and empty texts and items have no words and match nothing; an item of fewer words than a window is one
window; items without an id count in spans, n_hit and contaminated and are removed, but aren't in the list of items and their
number, and several of them don't differ; repeated rows are judged alike; an empty benchmark leaves every document clean; further columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import table, utf8

WINDOW = 10
#: Words of a shard's suffix array, and bytes of benchmark text that are broadcast at a time.
SHARD_WORDS, BLOCK_BYTES = 2_000_000, 16 << 20
#: Windows of the benchmark that are searched at a time.
SEARCHED = 65_536
#: A-Z to lower case; ASCII other than letters and digits to spaces; what isn't ASCII stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Suffixes:
    """The suffixes of a block of benchmark items, as numbers of words; 0 is a word that no item has."""

    names: list[str | None]
    number: dict[bytes, int]
    texts: list[np.ndarray]
    size: int
    pairs: np.ndarray = field(init=False)
    single: np.ndarray = field(init=False)

    def __post_init__(self):
        long = [t for t in self.texts if min(len(t), self.size) > 1]
        self.pairs = np.unique(np.concatenate([t[:-1] * (len(self.number) + 1) + t[1:] for t in long])) if long else np.zeros(0, np.int64)
        self.single = np.unique(np.array([t[0] for t in self.texts if len(t) == 1 or self.size == 1], np.int64))

    def searched(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """All windows, some at a time: items, places, and the least and the greatest key of a suffix that starts with them."""
        counts = np.array([len(t) - min(self.size, len(t)) + 1 for t in self.texts], np.int64)
        laid = np.concatenate([x for t in self.texts for x in (t, np.zeros(self.size, np.int64))]) if self.texts else np.zeros(0, np.int64)
        begins = np.cumsum([0, *[len(t) + self.size for t in self.texts]])[:-1]
        upto = np.cumsum(counts)
        for start in range(0, int(upto[-1]) if len(upto) else 0, SEARCHED):
            flat = np.arange(start, min(start + SEARCHED, int(upto[-1])))
            k = np.searchsorted(upto, flat, "right")
            place = flat - (upto[k] - counts[k])
            wide = np.arange(self.size)
            low = laid[(begins[k] + place)[:, None] + wide].astype(">u4")
            short = wide >= np.minimum(self.size, np.array([len(t) for t in self.texts]))[k][:, None]
            high = np.where(short, 2**32 - 1, low).astype(">u4")
            yield k, place, low.view(f"S{4 * self.size}").ravel(), high.view(f"S{4 * self.size}").ravel()

    @staticmethod
    def of(items: list[tuple[str | None, bytes]], size: int) -> Suffixes:
        split = [(name, words_of(text)) for name, text in items]
        number: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                number.setdefault(w, len(number) + 1)
        kept = [(name, np.array([number[w] for w in words], np.int64)) for name, words in split if words]
        return Suffixes([n for n, _ in kept], number, [t for _, t in kept], size)


def _keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The words from each position on as comparable bytes; 0 beyond the end."""
    padded = np.concatenate([words, np.zeros(size, np.int64)]).astype(">u4")
    return np.ascontiguousarray(padded[at[:, None] + np.arange(size)]).view(f"S{4 * size}").ravel()


def _starts(words: np.ndarray, tests: Suffixes) -> np.ndarray:
    """Positions whose first words some item has in this order."""
    base = len(tests.number) + 1
    known = np.flatnonzero(words)
    after = np.append(words, 0)[known + 1]
    hit = np.zeros(len(known), bool)
    for wanted, got in ((tests.pairs, words[known] * base + after), (tests.single, words[known])):
        if len(wanted):
            k = np.searchsorted(wanted, got)
            hit |= wanted[np.minimum(k, len(wanted) - 1)] == got
    return known[hit]


def search(words: np.ndarray, tests: Suffixes) -> list[tuple[int, int, np.ndarray]]:
    """(item, position in the item, positions in the shard) for each window of an item that the shard has. A 0 ends a document."""
    at = _starts(words, tests)
    keys = _keys(words, at, tests.size)
    order = np.argsort(keys, kind="stable")
    array, keys = at[order], keys[order]
    found = []
    for items, places, least, most in tests.searched():
        low, high = np.searchsorted(keys, least, "left"), np.searchsorted(keys, most, "right")
        found += [(int(items[i]), int(places[i]), array[low[i] : high[i]]) for i in np.flatnonzero(high > low)]
    return found


def longest(words: np.ndarray, text: np.ndarray, place: int, at: np.ndarray, size: int) -> np.ndarray:
    """How many words from `place` of the item on each position of the shard has."""
    length = np.full(len(at), min(size, len(text)))
    alive = np.arange(len(at))
    n = int(length[0]) if len(at) else 0
    while len(alive) and place + n < len(text):
        spot = at[alive] + n
        same = (spot < len(words)) & (words[np.minimum(spot, len(words) - 1)] == text[place + n])
        alive, n = alive[same], n + 1
        length[alive] = n
    return length


class _Shard:
    """Texts laid end to end with a 0 after each."""

    def __init__(self, tests: Suffixes):
        self.tests, self.parts, self.sizes, self.words = tests, [], [], 0

    def add(self, text: bytes) -> None:
        words = words_of(text)
        self.parts.append(np.fromiter((self.tests.number.get(w, 0) for w in words), np.int64, len(words)))
        self.sizes.append(len(words))
        self.words += len(words)

    def laid(self) -> tuple[np.ndarray, np.ndarray]:
        stop = np.zeros(1, np.int64)
        words = np.concatenate([x for part in self.parts for x in (part, stop)]) if self.parts else stop
        return words, np.cumsum([0, *[n + 1 for n in self.sizes]])


def _report(window: int, tests: Suffixes, only_hit: bool = False):
    """A function over Arrow batches: each row's n_words, the spans that windows cover, and, unless only they are asked for, the
    items and the longest match."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, first = _Shard(tests), 0
            texts = utf8(batch.column("text"))
            for i, text in enumerate(texts):
                shard.add(text)
                if shard.words >= SHARD_WORDS or i + 1 == len(texts):
                    yield answer(shard, batch.slice(first, i + 1 - first))
                    shard, first = _Shard(tests), i + 1

    def answer(shard: _Shard, rows: pa.RecordBatch) -> pa.RecordBatch:
        words, ends = shard.laid()
        cover = np.zeros(len(words) + 1, np.int64)
        items, best = defaultdict(set), np.zeros(len(shard.sizes), np.int64)
        for k, place, at in search(words, tests):
            size = min(window, len(tests.texts[k]))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            if only_hit:
                continue
            docs = np.searchsorted(ends, at, "right") - 1
            np.maximum.at(best, docs, longest(words, tests.texts[k], place, at, window))
            if tests.names[k] is not None:
                for d in np.unique(docs).tolist():
                    items[d].add(tests.names[k])
        edges = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]]))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        spans = [[] for _ in shard.sizes]
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            d = int(np.searchsorted(ends, a, "right")) - 1
            spans[d].append({"start": a - int(ends[d]), "end": b - int(ends[d])})
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = {n: rows.column(n) for n in rows.schema.names if n != "text"}
        columns |= {"n_words": pa.array(shard.sizes, pa.int64()), "spans": pa.array(spans, span), "items": pa.array([sorted(items[d]) for d in range(len(spans))], pa.list_(pa.string())), "longest": pa.array(best)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return decide


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's items by blocks whose size is counted before any is sent to the driver."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-total // (block_bytes // 2)))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text.encode()) for r in part.toLocalIterator()]


def matches(docs: DataFrame, bench: DataFrame, keys: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keys, n_words, spans (word ranges inside windows that occur), items, longest (words of the longest verbatim match) for
    each row of docs. With several benchmark blocks, rows of equal keys and text share what is found in any."""
    spark = docs.sparkSession
    inner = docs.select(*keys, F.xxhash64("text").alias("text_key"), "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.drop("text").schema)
    schema = f"{fields}, n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest long"
    found = [inner.mapInArrow(_report(window, Suffixes.of(items, window)), schema) for items in _blocks(bench, block_bytes)]
    if len(found) == 1:
        return found[0].drop("text_key")
    merged = found[0]
    for more in found[1:]:
        # Row by row: equal keys and text have equal answers, so one of each is enough to join.
        one = more.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "text_key"]], F.col("spans").alias("_spans"), F.col("items").alias("_items"), F.col("longest").alias("_longest")).dropDuplicates([f"_{c}" for c in [*keys, "text_key"]])
        on = None
        for c in [*keys, "text_key"]:
            same = F.col(c).eqNullSafe(F.col(f"_{c}"))
            on = same if on is None else on & same
        merged = merged.join(one, on, "left").select(*keys, "text_key", "n_words", F.concat("spans", "_spans").alias("spans"), F.array_union("items", "_items").alias("items"), F.greatest("longest", "_longest").alias("longest"))
    ordered = F.sort_array("spans")
    # Spans of several blocks may overlap: each counts from where the ones before it end.
    united = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")), lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.when(s["end"] > a["end"], F.concat(a["out"], F.array(F.struct(F.greatest(a["end"], s["start"]).alias("start"), s["end"].alias("end"))))).otherwise(a["out"]).alias("out")), lambda a: a["out"])
    return merged.withColumn("spans", united).drop("text_key")


def remove(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, as they were, without those in which a window of an item occurs."""
    rest = docs
    for items in _blocks(bench, BLOCK_BYTES):
        tests = Suffixes.of(items, window)

        def clean(batches: Iterator[pa.RecordBatch], tests: Suffixes = tests) -> Iterator[pa.RecordBatch]:
            report = _report(window, tests, True)
            for batch in batches:
                narrow = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
                hit = [bool(s) for part in report(iter([narrow])) for s in part.column("spans").to_pylist()]
                yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

        rest = rest.mapInArrow(clean, docs.schema)
    return rest


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), "longest", places.alias("places"))


#: Windows that follow each other at one distance between document and item are one match; hit words that touch are one place.
OP7_SQL = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select row_number() over () as b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select b, item_id, k, j, array_to_string(w[j:j + k - 1], ' ') as g from (select *, least(10, len(w)) as k from items) t, unnest(range(1, len(w) - k + 2)) u(j) where k > 0),
sizes as (select distinct k from windows),
places as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as g from docs, sizes, unnest(range(1, len(w) - k + 2)) u(i)),
found as (select r, i, p.k, b, item_id, j from places p join windows using (k, g)),
lengths as (select r, k - 1 + count(*) as n from (select *, i - row_number() over (partition by r, b, i - j order by i) as island from found) t group by r, b, i - j, island, k),
long as (select r, max(n) as longest from lengths group by r),
hit as (select distinct r, h from found, unnest(range(i, i + k)) u(h)),
spans as (select r, min(h) - 1 as s, max(h) as e, count(*) as n from (select *, h - row_number() over (partition by r order by h) as island from hit) t group by r, island),
placed as (select r, sum(n) as n_hit, string_agg(s || ':' || e, ',' order by s) as places from spans group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(longest, 0)::bigint as longest, coalesce(places, '') as places
from docs left join placed using (r) left join long using (r) left join named using (r)
"""
