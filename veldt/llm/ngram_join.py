"""Similarity join on word shingles: MinHash candidates, Bayesian pruning of pairs, exact verification.

A document's set is its hashed shingles of five words (one shingle of all words where there are fewer). Documents with equal
sets form one class, which takes part once. Classes that agree in a band of MinHash values share a bucket; identical buckets
of several bands count once. Buckets of any size are split into blocks of bounded size, and each pair of blocks is compared
in one place: MinHash values are read a few at a time, a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold falls below the tolerance, and the rest are verified on the full sets. A pair counts in the
first bucket that it shares. Blocks return each class's links and a forest of them, never the pairs, so a group of thousands
of near copies moves rows in proportion to its size times its number of blocks.

Defined cases: a null or empty text has no shingles, links to nothing and is a class of its own; rows that repeat a doc_id
are rows of their own; a null doc_id takes part, and the class is named by its least doc_id (null if it has none); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, runs, table, utf8
from veldt.llm.components import components
from veldt.llm.shingles import WordHashes, windows

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: At a similarity of 0.8, all 32 bands of 5 values miss with a chance of 3e-6.
BANDS, BAND_ROWS, STEP = 32, 5, 16
VALUES = BANDS * BAND_ROWS
#: Sets in a block, and how many of them are compared with another block at a time.
BLOCK, SLICE = 1024, 64
_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 2**64, VALUES, np.uint64)
_ODD = _rng.integers(0, 2**64, VALUES, np.uint64) | np.uint64(1)
_FOLD = _rng.integers(0, 2**64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima as 32-bit numbers, over blocks of shingles."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            np.minimum(least, ((shingles[i : i + 2048, None] ^ _XOR) * _ODD).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (values.astype(np.uint64).reshape(BANDS, BAND_ROWS) * _FOLD).sum(1) + np.arange(BANDS, dtype=np.uint64)
        return ((keys ^ (keys >> np.uint64(29))) * _ODD[0]).view(np.int64)


def needed(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the least matches with P(similarity >= threshold | matches) >= tolerance, under
    a uniform prior: 1 - I_t(m + 1, n - m + 1) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _shingle_sets(texts: pa.Array, words: WordHashes) -> Iterator[np.ndarray]:
    for text in utf8(texts):
        yield np.unique(windows(words.of(text.split()), SHINGLE))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, odd = WordHashes(), np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        high, low, bands = [], [], []
        for s in _shingle_sets(batch.column("text"), words):
            if not len(s):
                high.append(None), low.append(None), bands.append(None)
                continue
            with np.errstate(over="ignore"):
                high.append(int(s.sum().view(np.int64)))
                low.append(int(((s ^ (s >> np.uint64(31))) * odd).sum().view(np.int64)))
            bands.append(band_keys(minhash(s)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "high", "low", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        sets = list(_shingle_sets(batch.column("text"), words))
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([minhash(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "values", "shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[a] and right[b], sorted sets."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    universe = np.unique(np.concatenate([*left, *right]))
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(universe), 8192):
        part = universe[start : start + 8192]
        sides = []
        for side in (left, right):
            hit = np.zeros((len(side), len(part)), np.float32)
            for k, s in enumerate(side):
                hit[k, np.searchsorted(part, s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")])] = 1
            sides.append(hit)
        total += sides[0] @ sides[1].T
    return total[a, b].astype(np.int64)


def _alike(values: np.ndarray, sets: list[bytes], a: np.ndarray, b: np.ndarray, need: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those whose similarity reaches the threshold: pruned step by step, then verified."""
    same = np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + (values[a, part] == values[b, part]).sum(1, dtype=np.int32)
        alive = same >= least
        a, b, same = a[alive], b[alive], same[alive]
    if not len(a):
        return a, b
    used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    some = [np.frombuffer(sets[i], np.uint64) for i in used]
    sizes = np.array([len(s) for s in some])
    x, y = back[: len(a)], back[len(a) :]
    common = _overlaps(some, some, x, y)
    alike = common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9
    return a[alike], b[alike]


def _met(lists: list[list[int]], bucket: int, at: list[np.ndarray]) -> Iterator[tuple[list[int], list[int]]]:
    """For each earlier bucket that both sides have, who is in it on either side."""
    sides: list[dict[int, list[int]]] = [{}, {}]
    for held, places in zip(sides, at, strict=True):
        for k, place in enumerate(places.tolist()):
            for b in lists[place]:
                if b < bucket:
                    held.setdefault(b, []).append(k)
    for b in sides[0].keys() & sides[1].keys():
        yield sides[0][b], sides[1][b]


def _linked(rows: pa.Table, need: list[int], threshold: float) -> tuple[np.ndarray, ...] | None:
    """Of one pair of blocks: classes, the copies that each links to, and the least class of its tree."""
    first, second = rows["i"][0].as_py(), rows["j"][0].as_py()
    side = rows["side"].to_numpy()
    bucket, ids = rows["bucket"][0].as_py(), rows["class"].to_numpy()
    at = [np.flatnonzero(side == first), np.flatnonzero(side == second)]
    fresh = np.ones((len(at[0]), len(at[1])), bool)
    for a, b in _met(rows["buckets"].to_pylist(), bucket, at):
        fresh[np.ix_(a, b)] = False
    if first == second:
        fresh = np.triu(fresh, 1)
    values = np.frombuffer(b"".join(rows["values"].to_pylist()), np.uint32).reshape(len(ids), VALUES)
    sets = rows["shingles"].to_pylist()
    pairs = []
    for k in range(0, len(fresh), SLICE):
        a, b = np.nonzero(fresh[k : k + SLICE])
        a, b = _alike(values, sets, at[0][a + k], at[1][b], need, threshold)
        pairs.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
    if not len(a):
        return None
    copies = rows["copies"].to_numpy()
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    least, order = ids.copy(), None
    while order is None or (order != least).any():
        order = least.copy()
        np.minimum.at(least, a, order[b])
        np.minimum.at(least, b, order[a])
    on = np.unique(np.concatenate([a, b]))
    return ids[on], links[on].astype(np.int64), least[on]


def _compare(threshold: float, tolerance: float):
    need = needed(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "block"):
            if found := _linked(rows, need, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["class", "links", "least"])

    return compare


def link(docs: DataFrame, stage: Stage, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """A staged row of (doc_id, text_key, high, low) for each document, and of each set (high, low): class, class_id, links,
    component. Sets of one component are tied by links."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage.put("sketch", texts.mapInArrow(_sketch, f"doc_id {kind}, text_key long, high long, low long, bands array<long>"))
    # Classes get ids that stay: the table is written once.
    classes = stage.put("classes", rows.filter("high is not null").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()))
    known = rows.join(classes, ["high", "low"])
    spread = stage.put("bands", known.filter("doc_id <=> first").select("class", F.explode("bands").alias("band")).distinct())
    member = F.xxhash64("class")
    buckets = spread.groupBy("band").agg(F.count("*").alias("size"), F.sum(member.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("x")).filter("size > 1")
    buckets = stage.put("buckets", buckets.groupBy("size", "s", "x").agg(F.min("band").alias("bucket")).select("bucket", "size"))
    members = stage.put("members", spread.join(buckets, spread.band == buckets.bucket).select("class", "bucket", "size"))
    stage.drop("bands", "buckets")
    lists = members.groupBy("class").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    chosen = known.filter("doc_id <=> first").join(lists, "class", "left_semi").groupBy("class", "doc_id").agg(F.min("text_key").alias("text_key"))
    found = texts.join(chosen, texts.text_key.eqNullSafe(chosen.text_key) & texts.doc_id.eqNullSafe(chosen.doc_id)).select("class", "text")
    sets = stage.put("sets", found.mapInArrow(_sets, "class long, values binary, shingles binary").dropDuplicates(["class"]))
    blocks = F.ceil(F.col("size") / block).cast("int")
    side = F.pmod(F.xxhash64("class", "bucket"), blocks).cast("int")
    placed = members.select("class", "bucket", side.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("class", "bucket", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    full = placed.join(lists, "class").join(classes.select("class", "copies"), "class").join(sets, "class")
    full = full.withColumn("block", F.concat_ws(":", "bucket", "i", "j")).repartition("block").sortWithinPartitions("block")
    links = stage.put("links", full.mapInArrow(_compare(threshold, tolerance), "class long, links long, least long"))
    stage.drop("members", "sets")
    tied = components(stage, links.select(F.col("class").alias("a"), F.col("least").alias("b")))
    counted = links.groupBy("class").agg(F.sum("links").alias("links"))
    every = classes.join(tied, F.col("class") == F.col("node"), "left").join(counted, "class", "left")
    every = every.select("high", "low", "class", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    named = every.groupBy("component").agg(F.min("first").alias("class_id"))
    return rows.select("doc_id", "text_key", "high", "low"), every.join(named, "component").select("high", "low", "class_id", "n_links", "component")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, label: str = "join") -> DataFrame:
    """doc_id, class_id (the least doc_id of all that links tie together) and n_links (other rows of a similarity of at
    least the threshold), one row for each row of docs."""
    rows, classes = link(docs, Stage(docs.sparkSession, label), threshold, tolerance)
    found = rows.join(classes, ["high", "low"], "left")
    return found.select("doc_id", F.when(F.col("high").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, label: str = "keep") -> DataFrame:
    """The rows of docs without those that another row of their group stands for: of each group the row of the least doc_id
    (rows with one go before rows without) stays, and rows without words stay."""
    stage = Stage(docs.sparkSession, label)
    rows, classes = link(docs, stage, threshold, tolerance)
    grouped = rows.join(classes, ["high", "low"])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    per_row = grouped.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    best = per_row.groupBy("component").agg(F.min(F.struct(order.alias("o"), "n")).alias("best")).select("best.o.doc_id", "best.o.text_key", "best.n")
    best = stage.put("best", best.groupBy("doc_id", "text_key").agg(F.max("n").alias("n")))
    empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    key = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), empty.alias("_empty"))
    named = best.select(F.col("doc_id").alias("_best"), F.col("text_key").alias("_best_key"))
    stays = key.filter("not _empty").join(named, key._id.eqNullSafe(F.col("_best")) & (key._key == F.col("_best_key")))
    if best.filter("n > 1").first():  # rows repeat in full: one of each stays
        stays = stays.groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    return stays.select("_row.*").unionByName(key.filter("_empty").select("_row.*"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), label="op2")


OP2_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
grams as (select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') as g from (select *, least(5, len(w)) as k from words) t, unnest(range(1, len(w) - k + 2)) r(i) where k > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join sizes s on s.doc_id = x join sizes t on t.doc_id = y where c >= 0.8 * (s.n + t.n - c) - 1e-9),
reached(doc_id, root) as (select doc_id, doc_id from documents union select y, root from reached join links on x = doc_id)
select doc_id, min(root) as class_id, (select count(*) from links where x = r.doc_id)::bigint as n_links from reached r group by doc_id
"""
