"""Language-model scores by deleted interpolation.

P(w | h) = l_b * c(h, w) / c(h) + (1 - l_b) * P(w), where b is the bucket (power of two) of the context's count c(h) and P(w)
is the smoothed unigram estimate (c(w) + 0.5) / (N + 0.5 (V + 1)). The weights l_b are learned by expectation-maximisation on
a fold of the learning documents, against counts from which that fold is deleted. All counts cover all learning documents.

Counts never meet on one machine. Documents are dealt to blocks by a hash of their key, those of EM's fold to blocks of their
own, which alone are read to learn the weights. A block asks for the counts of its distinct n-grams once each, packed by shard
of the n-gram hash; a shard sums what its blocks sent and answers each in the order asked; blocks and answers meet again to
score. What a block or a shard holds is bounded, their numbers grow with the input, each is a partition of its own, and a
frequent n-gram is one entry a block, so no key is hot.

N-grams are 64-bit hashes for words, and for pairs as many bits as keep the chance that a pair collides under one in a
million at the corpus's size. For EM, likelihood ratios are rounded to a thousandth of a natural logarithm; their counts by
bucket and ratio are all that reaches the driver (at most 40 x 40,002 numbers).

Defined cases: a null or empty text is the end token alone; a null doc_id is a learning document; repeated rows count each
time; with no learning documents N = V = 0 and every token has the unigram probability 1; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, runs, shuffle_parts, table, utf8
from veldt.llm.shingles import WordHashes, mix

#: Bytes of text in a block and in all blocks' share of a shard, about.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 12 << 20
BUCKETS, ROUND, CLIP = 40, 1000, 20_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END, _START = np.uint64(0x51ED270B9F652295), np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Layout:
    """How n-grams are hashed and dealt: shards by order, and the bits of a pair's hash."""

    shards: int
    pair_bits: int

    def keys(self, order: int, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - (64 if order == 1 else self.pair_bits))

    def split(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each shard, where its keys are among sorted distinct keys."""
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return np.split(order, np.cumsum(np.bincount(shard, minlength=self.shards))[:-1])


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    docs: int

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)) if self.tokens else np.ones(len(counts))


class Block:
    """The tokens of a block's documents: for each token its word and pair among the block's distinct ones."""

    def __init__(self, texts: list[bytes], words: WordHashes, layout: Layout):
        parts, sizes = [], []
        for text in texts:
            found = text.translate(_FOLD).split()
            parts += [words.of(found), np.array([_END])]
            sizes.append(len(found) + 1)
        tokens = np.concatenate(parts)
        self.sizes = np.array(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[_START], tokens[:-1]])
        before[self.starts] = _START
        self.first = np.zeros(len(tokens), bool)
        self.first[self.starts] = True
        with np.errstate(over="ignore"):
            pairs = mix(before * _STEP + tokens)
        self.words, self.word = np.unique(layout.keys(1, tokens), return_inverse=True)
        self.pairs, self.pair = np.unique(layout.keys(2, pairs), return_inverse=True)

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: the high bytes are runs of zeros, which the shuffle's codec removes."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _ask(layout: Layout):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for rows in runs(batches, "block"):
            block = Block(utf8(rows["text"].combine_chunks()), words, layout)
            fold = np.repeat(rows["fold"].to_numpy(), block.sizes)
            name = rows["block"][0].as_py()
            for order, keys, place in ((1, block.words, block.word), (2, block.pairs, block.pair)):
                learn = np.bincount(place, fold != 1, len(keys)).astype("<u4")
                held = np.bincount(place, fold == 0, len(keys)).astype("<u4")
                out = [[], [], [], []]
                for shard, at in enumerate(layout.split(keys)):
                    if len(at):
                        for column, value in zip(out, (f"{order}:{shard}", pack(keys[at]), learn[at].tobytes(), held[at].tobytes()), strict=True):
                            column.append(value)
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array([name] * n, pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["shard", "block", "keys", "learn", "held"])

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in runs(batches, "shard"):
        name = rows["shard"][0].as_py()
        order, shard = map(int, name.split(":"))
        keys = [unpack(x) for x in rows["keys"].to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(place, np.frombuffer(b"".join(rows[c].to_pylist()), "<u4"), len(known)).astype("<u4") for c in ("learn", "held")]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        sent = [[x.tobytes() for x in np.split(s[place], ends)] for s in sums]
        n = len(keys)
        learn, rest = sums[0].astype(np.int64), sums[0].astype(np.int64) - sums[1]
        facts = {"tokens": learn.sum(), "distinct": (learn > 0).sum(), "tokens_rest": rest.sum(), "distinct_rest": (rest > 0).sum()}
        columns = {"block": pa.array(rows["block"].to_pylist(), pa.int64()), "order": pa.array([order] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "learn": pa.array(sent[0], pa.binary()), "held": pa.array(sent[1], pa.binary())}
        columns |= {k: pa.array([int(v)] + [None] * (n - 1), pa.int64()) for k, v in facts.items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


ANSWER = "block long, order int, shard int, learn binary, held binary, tokens long, distinct long, tokens_rest long, distinct_rest long"


class Counted:
    """A block with the answers to what it asked: counts of its words, pairs and contexts in the learning documents, without
    the held-out fold if `deleted`."""

    def __init__(self, rows: pa.Table, block: Block, layout: Layout, totals: Totals, deleted: bool):
        got = {(o, s): (a, b) for o, s, a, b in zip(*(rows[c].to_pylist() for c in ("order", "shard", "learn", "held")), strict=True)}
        counts = []
        for order, keys in ((1, block.words), (2, block.pairs)):
            out = np.zeros(len(keys), np.int64)
            for shard, at in enumerate(layout.split(keys)):
                if len(at):
                    learn, held = (np.frombuffer(x, "<u4").astype(np.int64) for x in got[order, shard])
                    out[at] = learn - held if deleted else learn
            counts.append(out)
        self.word, self.pair = counts[0][block.word], counts[1][block.pair]
        self.context = np.where(block.first, totals.docs, np.concatenate([[0], self.word[:-1]]))
        self.base = totals.unigram(self.word)
        self.bucket = np.frexp(self.context)[1].clip(0, BUCKETS - 1)
        self.likely = self.pair / np.maximum(self.context, 1)


def _split(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    docs = pc.is_null(rows["order"])
    return rows.filter(docs), rows.filter(pc.invert(docs))


def _ratios(layout: Layout, totals: Totals):
    """Counts of (bucket, rounded log ratio of pair to unigram likelihood) over the held-out fold."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for rows in runs(batches, "block"):
            docs, answers = _split(rows)
            if not len(docs):
                continue
            block = Block(utf8(docs["text"].combine_chunks()), words, layout)
            c = Counted(answers, block, layout, totals, True)
            on = (np.repeat(docs["fold"].to_numpy(), block.sizes) == 0) & (c.context > 0)
            with np.errstate(divide="ignore"):
                ratio = np.log(c.likely[on] / c.base[on])
            rounded = np.where(np.isfinite(ratio), np.rint(ratio * ROUND).clip(-CLIP, CLIP), -CLIP - 1).astype(np.int64)
            kinds, n = np.unique(c.bucket[on].astype(np.int64) << 32 | rounded + CLIP + 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((kinds >> 32).astype(np.int32)), pa.array((kinds & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "ratio", "n"])

    return ratios


def learn_weights(counts: list[tuple[int, int, int]], rounds: int = 200) -> np.ndarray:
    """By bucket, the weight that EM finds for the pair estimate, from (bucket, rounded ratio + CLIP + 1, n). A bucket in which
    no held-out context fell has the weight of the nearest below that has one, 0 if there is none."""
    weights = np.zeros(BUCKETS)
    table_ = np.array(counts, np.int64).reshape(-1, 3)
    for b in np.unique(table_[:, 0]):
        rows = table_[table_[:, 0] == b]
        r, n = np.where(rows[:, 1] == 0, 0.0, np.exp((rows[:, 1] - CLIP - 1) / ROUND)), rows[:, 2]
        w = 0.5
        for _ in range(rounds):
            w = float((n * (w * r / (w * r + 1 - w))).sum() / n.sum())
        weights[b] = min(w, 1 - 1e-6)
    for b in set(range(1, BUCKETS)) - set(table_[:, 0].tolist()):
        weights[b] = next((weights[c] for c in range(b - 1, -1, -1) if c in table_[:, 0]), 0.0)
    return weights


def _score(layout: Layout, totals: Totals, weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for rows in runs(batches, "block"):
            docs, answers = _split(rows)
            block = Block(utf8(docs["text"].combine_chunks()), words, layout)
            c = Counted(answers, block, layout, totals, False)
            w = weights[c.bucket] * (c.context > 0)
            ids = docs["doc_id"].combine_chunks()
            columns = [ids, pa.array(docs["fold"].to_numpy() == 1), pa.array(block.sizes.astype(np.int64)), pa.array(block.by_doc((c.word > 0).astype(np.int64))), pa.array(np.full(len(ids), totals.tokens, np.int64)), pa.array(block.by_doc(np.log10(c.base))), pa.array(block.by_doc(np.log10(w * c.likely + (1 - w) * c.base)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def fold_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5: 1 isn't learned from, 0 is the fold that EM holds out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(2)).cast("int")


def score(docs: DataFrame, label: str = "lm") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession, label)
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = docs.groupBy(fold_of(F.col("doc_id")).alias("fold")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    total, tuning = sum(r.bytes or 0 for r in facts), sum(r.bytes or 0 for r in facts if r.fold == 0)
    held, blocks = max(1, -(-tuning // BLOCK_BYTES)), max(1, -(-(total - tuning) // BLOCK_BYTES))
    shards = max(shuffle_parts(spark), -(-total // SHARD_BYTES))
    layout = Layout(shards, min(64, max(1, total).bit_length() + 20))
    fold, key = fold_of(F.col("doc_id")), F.xxhash64("doc_id", "text")
    place = F.when(fold == 0, F.pmod(key, F.lit(held))).otherwise(held + F.pmod(key, F.lit(blocks)))
    texts = docs.select("doc_id", "text", fold.alias("fold"), place.alias("block"))

    def dealt(rows: DataFrame, number: Column, parts: int) -> DataFrame:
        """rows with a partition for each number from 0 on."""
        return rows.repartitionById(parts, number.cast("int"))

    asked = dealt(texts.select("block", "fold", "text"), F.col("block"), held + blocks).sortWithinPartitions("block").mapInArrow(_ask(layout), "shard string, block long, keys binary, learn binary, held binary")
    number = F.split_part("shard", F.lit(":"), F.lit(2)).cast("int") * 2 + F.split_part("shard", F.lit(":"), F.lit(1)).cast("int") - 1
    answers = stage.put("answers", dealt(asked, number, 2 * shards).sortWithinPartitions("shard").mapInArrow(_answer, ANSWER))
    sums = answers.filter("order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "tokens_rest", "distinct_rest")]).first()
    learning = {r.fold: r.docs for r in facts if r.fold != 1}
    every = Totals(sums.tokens, sums.distinct, sum(learning.values()))
    rest = Totals(sums.tokens_rest, sums.distinct_rest, sum(n for f, n in learning.items() if f))

    def met(rows: DataFrame, asked_by: DataFrame, parts: int) -> DataFrame:
        both = rows.select("block", "doc_id", "fold", "text", *[F.lit(None).cast(t).alias(c) for c, t in (("order", "int"), ("shard", "int"), ("learn", "binary"), ("held", "binary"))])
        both = both.unionByName(asked_by.select("block", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("text"), "order", "shard", "learn", "held"))
        return dealt(both, F.col("block"), parts).sortWithinPartitions("block")

    tuned = F.col("block") < held
    ratios = met(texts.filter(fold == 0), answers.filter(tuned), held).mapInArrow(_ratios(layout, rest), "bucket int, ratio int, n long")
    counts = ratios.groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([tuple(r) for r in counts])
    return met(texts, answers, held + blocks).mapInArrow(_score(layout, every, weights), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), "op3")
