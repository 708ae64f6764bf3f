"""Toxicity by compression distance: one zstandard dictionary trained on windows of toxic text and one on windows of ordinary
text; each window of a document is compressed with either, and where the toxic one needs fewer bytes it reads like toxic text.

A window is a word (one of more than WINDOW_BYTES bytes is several). Compressors don't look for matches in a block's last
bytes and don't keep gains below a fixed cost, so both dictionaries end with the same anchor, which no text has, and each
window is compressed with the anchor behind it: what differs between the two lengths is the window alone.

Labels are by document, but few windows of a toxic document are toxic. So the toxic dictionary is trained on those windows
of toxic documents that hold a run of GRAM bytes which stands out in them (a two-proportion z of document frequencies, near
copies counted once), the ordinary one on all windows of ordinary documents. How many windows save at least 1, 2, ... bytes,
all and those that the toxic dictionary holds whole, as counts and as shares, is calibrated to a probability by a logistic
fit on labelled documents that trained neither dictionary.

Learning uses at most `sample` labelled documents of each class, by hash order of doc_id; of a document at most LEARNED
distinct windows, those of the least hashes over the whole text, travel to where dictionaries are trained. Features of the
calibrating documents are worked out where their texts are. Every document is scored, on all its windows. Only text is an
input of a score.

Defined cases: a null or empty text has one empty window and gets that window's score; a null doc_id isn't held out; several
labels of one doc_id count as toxic if one does; with no toxic or no ordinary label every score is the share of toxic labels
(0 without labels); repeated rows score alike; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, table, utf8

#: Labelled documents of a class, and distinct windows of one, that are learned from.
SAMPLE, LEARNED = 3000, 4000
WINDOW_BYTES, GRAM, STAND_OUT = 64, 6, 5.0
#: Bytes of the dictionaries; windows whose lengths a worker keeps.
TOXIC_BYTES, ORDINARY_BYTES, KEPT = 4096, 16384, 400_000
LEVEL, STEPS, WHOLE = 12, 8, 3
#: ASCII letters to lower case, other ASCII to spaces; what isn't ASCII stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ANCHOR = bytes(range(1, 25))


def windows(text: bytes) -> list[bytes]:
    """A text's windows in order, each between blanks; one empty window for a text without words."""
    words = text.translate(_FOLD).split()
    return [b" " + w[i : i + WINDOW_BYTES] + b" " for w in words for i in range(0, len(w), WINDOW_BYTES)] or [b" "]


@dataclass(frozen=True)
class Labelled:
    """What a labelled document trains dictionaries with: its distinct windows, and a key that near copies share."""

    toxic: int
    part: int
    copy: int
    windows: frozenset[bytes]

    @staticmethod
    def of(text: bytes, toxic: int, part: int) -> Labelled:
        w = windows(text)
        copy = min(zlib.crc32(b"".join(w[i : i + 3])) for i in range(max(1, len(w) - 2)))
        some = set(w)
        if len(some) > LEARNED:
            some = set(sorted(some, key=lambda x: (zlib.crc32(x), x))[:LEARNED])
        return Labelled(toxic, part, copy, frozenset(some))


def _grams(window: bytes) -> set[bytes]:
    return {window[i : i + GRAM] for i in range(max(1, len(window) - GRAM + 1))}


def standing_out(toxic: list[frozenset[bytes]], ordinary: list[frozenset[bytes]], least: float) -> set[bytes]:
    """Runs of GRAM bytes in more toxic than ordinary documents, by a z of at least `least`."""
    known: dict[bytes, set[bytes]] = {}

    def counted(docs: list[frozenset[bytes]]) -> Counter:
        out: Counter = Counter()
        for doc in docs:
            out.update(set().union(*(known.setdefault(w, _grams(w)) for w in doc)))
        return out

    with_, without, p, n = counted(toxic), counted(ordinary), len(toxic), len(ordinary)
    spread = lambda g: math.sqrt((with_[g] + without[g] + 1) / (p + n) * (1 / p + 1 / n))
    return {g for g in with_ if with_[g] / p - without[g] / n >= least * spread(g)}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    random.Random(7).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionaries(docs: list[Labelled]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary."""
    one = lambda k: list({d.copy: d.windows for d in docs if d.toxic == k}.values())
    toxic, ordinary = one(1), one(0)
    least, grams = STAND_OUT, set()
    while not grams and least > 0:  # a handful of documents can't reach the usual z
        grams, least = standing_out(toxic, ordinary, least), least - 0.5
    loud = [w for d in toxic for w in sorted(d) if not grams.isdisjoint(_grams(w))]
    return _dictionary(loud, TOXIC_BYTES), _dictionary([w for d in ordinary for w in sorted(d)], ORDINARY_BYTES)


@dataclass
class Model:
    """The two dictionaries, and the weights over the features of a document."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float | None = None

    def open(self) -> Model:
        self.sides, self.known = [self._compressor(self.ordinary), self._compressor(self.toxic)], {}
        self.base = self._lengths(b" ")[1]
        return self

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content + _ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def _lengths(self, window: bytes) -> tuple[int, int]:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            found = self.known[window] = tuple(len(side.compress(window + _ANCHOR)) for side in self.sides)
        return found

    def features(self, text: bytes) -> np.ndarray:
        found = np.array([self._lengths(w) for w in windows(text)])
        saved, whole = found[:, 0] - found[:, 1], found[:, 1] <= self.base + WHOLE
        steps = saved[:, None] >= np.arange(1, STEPS + 1)
        counts = np.concatenate([steps.sum(0), (steps & whole[:, None]).sum(0)])
        return np.concatenate([np.log1p(counts), counts / len(found), [math.log1p(len(found))]])

    def calibrate(self, rows: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.spread = rows.mean(0), rows.std(0) + 1e-9
        x = np.column_stack([np.ones(len(rows)), (rows - self.mean) / self.spread])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        self.weights = w

    def score(self, text: bytes) -> float:
        if self.constant is not None:
            return self.constant
        z = self.weights[0] + ((self.features(text) - self.mean) / self.spread) @ self.weights[1:]
        return float(1 / (1 + math.exp(-min(30, max(-30, z)))))

    def bare(self) -> Model:
        """Without what doesn't travel."""
        return Model(**{k: getattr(self, k) for k in self.__dataclass_fields__})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """One label for each doc_id that isn't held out."""
    return labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def toxic_share(labels: DataFrame) -> float:
    return float(known_labels(labels).agg(F.avg("toxic")).first()[0] or 0.0)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxicity") -> DataFrame:
    """The staged texts, labels and parts (0-2 train dictionaries, 3 and 4 calibrate) of at most `sample` documents of each
    class that aren't held out, by hash order of doc_id; of rows that share a doc_id, the least text."""
    known = known_labels(labels)
    picks = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    few = picks[0].unionByName(picks[1])  # at most 2 * sample rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    part = F.pmod(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("part")).cast("binary")), F.lit(5)).cast("int")
    return Stage(docs.sparkSession, label).put("sample", rows.select(F.col("toxic").cast("int").alias("toxic"), part.alias("part"), "text"), files=8)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        docs = [Labelled.of(*row) for row in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("part").to_pylist(), strict=True)]
        columns = [pa.array([d.toxic for d in docs], pa.int32()), pa.array([d.part for d in docs], pa.int32()), pa.array([d.copy for d in docs], pa.int64()), pa.array([squeeze(b"\0".join(sorted(d.windows))) for d in docs], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["toxic", "part", "copy", "windows"])


def _measured(model: Model):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = model.bare().open()
        for batch in batches:
            rows = [opened.features(t).astype("<f8").tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.binary())], ["toxic", "features"])

    return measured


def learn(rows: DataFrame | list[tuple[bytes, int]], share: float | None = None) -> Model:
    """rows: `labelled`, or texts and whether they are toxic. share: of toxic documents among all labelled ones, where the
    sample has another share; scores are probabilities at that share."""
    if isinstance(rows, DataFrame):
        found = rows.mapInArrow(_gathered, "toxic int, part int, copy long, windows binary").collect()  # bounded by SAMPLE and LEARNED
        plain = zstandard.ZstdDecompressor().decompress
        docs = sorted((Labelled(r.toxic, r.part, r["copy"], frozenset(plain(r.windows).split(b"\0"))) for r in found), key=lambda d: (d.toxic, d.part, d.copy, sorted(d.windows)))
    else:
        docs = [Labelled.of(t, y, k % 5) for k, (t, y) in enumerate(rows)]
    n = [sum(d.toxic == k for d in docs) for k in (0, 1)]
    if not all(n):
        return Model(b"", b"", constant=n[1] / max(1, len(docs)))
    training, resting = [d for d in docs if d.part < 3], [d for d in docs if d.part >= 3]
    both = lambda part: {d.toxic for d in part} == {0, 1}
    split = both(training) and both(resting)  # too few documents are learned from and calibrate
    model = Model(*dictionaries(training if split else docs)).open()
    if isinstance(rows, DataFrame):
        measured = (rows.filter("part >= 3") if split else rows).mapInArrow(_measured(model.bare()), "toxic int, features binary").collect()
        x, y = np.array([np.frombuffer(r.features) for r in measured]), np.array([r.toxic for r in measured], float)
    else:
        some = [(t, y) for k, (t, y) in enumerate(rows) if not split or k % 5 >= 3]
        x, y = np.array([model.features(t) for t, _ in some]), np.array([y for _, y in some], float)
    order = np.lexsort([*x.T, y])  # sums don't depend on the order of tasks
    model.calibrate(x[order], y[order])
    if share is not None and 0 < share < 1:
        model.weights[0] += math.log(share / (1 - share)) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row of docs."""
    bare = model.bare()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = bare.bare().open()
        for batch in batches:
            scores = np.array([opened.score(t) for t in utf8(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    found = classify(docs, learn(labelled(docs, labels, label="op6"), toxic_share(labels)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
