"""Mixing sources to target weights: each source repeats at the rate target / size, as floor(rate) copies of every document
and one more for those whose seeded hash falls below the rate's fraction.

Targets fill like water: a source gets its weight's share of the budget, at most `cap` times its size; what is above goes to
the others by weight. Sorted by cap over weight, that has a closed form in two running sums over the sources, so nothing
iterates. For each source the seed whose copies come closest to the target is taken from a fixed number of seeds, each tried
on all its documents in one aggregation; the result depends on the rows alone, so reruns agree. Documents are aggregated by
source before any shuffle, so a source with a third of all rows is no heavier than another.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source, last in order; sources of size
0 get target 0 and their documents stay once when copies are emitted only if their rate says so (it is 0: they go); repeated
rows count as rows and share their draw; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import WORD, Stage, table

WEIGHTS, SHARE, CAP, SEEDS = (5, 2, 1), 1.5, 2, 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size). `sizes` has a row for each source, so the windows
    over all its rows are over sources, not documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    # A source is below its limit from the first whose limit its share of the rest doesn't reach.
    levels = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("limit"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"]
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * water, F.col("limit")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levels.withColumn("target", target).select("source", "source_size", "target").withColumn("rate", F.least(rate, F.lit(float(cap))))


def draw(seed: Column | int, *key: str) -> Column:
    """A number in [0, 1) from a row's key and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, *key), F.lit(1 << 30)) / float(1 << 30)


def seeded(sizes: DataFrame, aims: DataFrame, key: tuple[str, ...] = ("doc_id", "text_key")) -> DataFrame:
    """aims with `seed`: of SEEDS seeds, the one whose extra copies come closest to the fraction of the source's words."""
    hits = [F.sum(F.when(draw(k, *key) < F.col("fraction"), F.col("size"))).alias(f"s{k}") for k in range(SEEDS)]
    whole = aims.withColumn("fraction", F.col("rate") - F.floor("rate"))
    named = whole.select(F.col("source").alias("of"), "fraction")
    sums = sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(*hits)
    joined = whole.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
    gap = [F.struct(F.abs(F.coalesce(f"s{k}", F.lit(0)) - F.col("fraction") * F.col("source_size")).alias("gap"), F.lit(k).alias("seed")) for k in range(SEEDS)]
    return joined.withColumn("seed", F.array_min(F.array(*gap))["seed"]).select("source", "source_size", "target", "rate", "fraction", "seed")


def plan(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The staged narrow rows (doc_id, text_key, source, size) and the staged aims of each source."""
    sizes = stage.put("sizes", docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", size_of(F.col("text")).alias("size")))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stage.put("aims", seeded(sizes, targets(totals)), files=1)
    return sizes, aims


def copies() -> Column:
    return (F.floor("rate") + F.when(draw(F.col("seed"), "doc_id", "text_key") < F.col("fraction"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, label: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    _, aims = plan(docs, Stage(docs.sparkSession, label))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.xxhash64("text").alias("text_key"), F.col("source").alias("_source"))
    placed = rows.join(aims, F.col("_source").eqNullSafe(F.col("source")))
    return placed.withColumn("_copies", copies()).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, aims = plan(table(spark, sf_dir, "documents"), Stage(spark, "op10"))
    placed = sizes.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return placed.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).cast("long").alias("taken"), copies().alias("copies"), "source")
