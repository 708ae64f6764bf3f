"""Deduplication of line runs by winnowing.

A gram is the lines from one on that hold GRAM words; of the grams that start within WINNOW words, the one of the least hash
is a fingerprint. Any run of whole lines that two places share and that holds GRAM + WINNOW words or more then has a common
fingerprint in both, so only texts with a fingerprint that occurs twice can repeat anything. Of these, the key of a match is
the least run itself: from each line on, and back from each line, the fewest lines that hold MIN_RUN words. Each key's places
are joined to its first place (by doc_id, then row, then line), never to each other; all but the first are deleted.

Every run of MIN_RUN words or more is made of such least runs and of lines without words beside them (which have keys of their
own, chained to that of the least run), and each of them occurs first where the whole run does or earlier. So exactly the
lines go that are in a run of that many words of which an earlier place has an equal one, whichever places have its parts.

The work grows with the number of lines, but for lines without words in a row: each of them has a key made of those before it,
so it grows with the square of how many are in one row of them.

All is DataFrame expressions; texts are read once and reduced to hashes and word counts of lines. Places of a frequent
key meet one row, so a passage in a third of all documents is a skewed join that Spark splits, not a group.

Defined cases: a null or empty text is one line without words and stays; lines without words are matched as lines but never
start a gram; null doc_ids come after all others; rows that repeat are documents of their own, so the later lose what the
first has; an empty table gives no rows; other columns pass through `dedup` and aren't read by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import WORD, Stage, bind, table

GRAM, WINNOW, MIN_RUN = 20, 20, 50


def lined(docs: DataFrame, *keys: Column) -> DataFrame:
    """keys, and of each text's lines the hashes and the numbers of words."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    both = bind(lines, lambda x: F.struct(F.transform(x, lambda l: F.xxhash64(l)).alias("hashes"), F.transform(x, lambda l: F.regexp_count(l, F.lit(WORD))).alias("words")))
    return docs.select(*keys, both.alias("_l")).select("*", "_l.*").drop("_l")


def fingerprints(rows: DataFrame, gram: int = GRAM, winnow: int = WINNOW) -> DataFrame:
    """(row, doc_id, pos, print) of the selected grams, from (row, doc_id, hashes, words)."""
    flat = rows.select("row", "doc_id", F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "line")).select("row", "doc_id", "pos", "line.*").filter("words > 0")
    by_place = Window.partitionBy("row").orderBy("pos")
    start = flat.withColumn("start", (F.sum("words").over(by_place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).cast("long"))
    ahead = lambda n: Window.partitionBy("row").orderBy("start").rangeBetween(0, n - 1)
    # Lines have words here, so starts differ: the lines that start within `gram` words are those that hold that many.
    grams = start.withColumn("print", F.when(F.sum("words").over(ahead(gram)) >= gram, F.xxhash64(F.collect_list("hashes").over(ahead(gram)))))
    least = F.min(F.when(F.col("print").isNotNull(), F.struct("print", (-F.col("pos")).alias("back")))).over(ahead(winnow))
    return grams.select("row", "doc_id", least.alias("least")).filter("least is not null").select("row", "doc_id", (-F.col("least.back")).alias("pos"), F.col("least.print").alias("print")).distinct()


def _chain(key: Column, lines: Column, side: int) -> Column:
    """key, and the keys of the run with one more of these lines at a side each."""
    more = lambda a, line: F.xxhash64(a["last"], line, F.lit(side))
    start = F.struct(key.alias("last"), F.array(key).alias("all"))
    grown = F.aggregate(lines, start, lambda a, line: bind(more(a, line), lambda k: F.struct(k.alias("last"), F.concat(a["all"], F.array(k)).alias("all"))), lambda a: a["all"])
    return F.when(F.size(lines) > 0, grown).otherwise(F.array(key))


def least_runs(rows: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(row, doc_id, key, from, to) of the least runs [from, to) of lines with min_run words, from (row, doc_id, hashes, words)."""
    flat = rows.select("row", "doc_id", F.posexplode(F.arrays_zip("hashes", "words")).alias("pos", "line")).select("row", "doc_id", "pos", "line.*")
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    has = F.col("words") > 0
    nth = flat.withColumn("stop", F.sum("words").over(upto).cast("long")).withColumn("nth", F.sum(has.cast("int")).over(upto) - has.cast("int"))
    own = lambda c: F.max(F.when(has, F.col(c))).alias(c)
    # One row for each line with words, and what stands between it and the one before.
    bare = F.transform(F.sort_array(F.collect_list(F.when(~has, F.struct("pos", "hashes")))), lambda x: x["hashes"])
    lines = nth.groupBy("row", "nth").agg(F.first("doc_id").alias("doc_id"), own("pos"), own("hashes"), own("words"), F.max("stop").alias("stop"), bare.alias("before"))
    after = F.coalesce(F.lead("before").over(Window.partitionBy("row").orderBy("nth")), F.array().cast("array<bigint>"))
    lines = lines.withColumn("after", after).filter("pos is not null").withColumn("start", F.col("stop") - F.col("words")).withColumn("gap", F.xxhash64("before"))
    ahead = Window.partitionBy("row").orderBy("start").rangeBetween(0, min_run - 1)
    back = Window.partitionBy("row").orderBy("stop").rangeBetween(1 - min_run, 0)
    held = lambda w: F.xxhash64(F.collect_list("hashes").over(w), F.slice(F.collect_list("gap").over(w), F.lit(2), F.count("*").over(w).cast("int")))
    lines = lines.select("row", "doc_id", "pos", "words", "before", "after", F.sum("words").over(ahead).alias("n_ahead"), held(ahead).alias("ahead"), (F.max("pos").over(ahead) + 1).alias("to"), F.sum("words").over(back).alias("n_back"), held(back).alias("back"), F.min("pos").over(back).alias("from"))
    forth = F.transform(_chain(F.col("ahead"), F.reverse("before"), 1), lambda k, m: F.struct(k.alias("key"), (F.col("pos") - m).alias("from"), F.col("to")))
    # A least run back that is one ahead, too, has its row there.
    both = F.col("n_back") - F.col("words") < min_run
    behind = F.filter(F.transform(_chain(F.col("back"), F.col("after"), 2), lambda k, m: F.struct(k.alias("key"), F.col("from"), (F.col("pos") + 1 + m).alias("to"))), lambda _, m: (m > 0) | ~both)
    none = F.array().cast("array<struct<key:bigint,from:int,to:int>>")
    every = F.concat(F.when(F.col("n_ahead") >= min_run, forth).otherwise(none), F.when(F.col("n_back") >= min_run, behind).otherwise(none))
    return lines.select("row", "doc_id", F.explode(every).alias("run")).select("row", "doc_id", "run.*")


def _joined(runs: DataFrame) -> DataFrame:
    """(row, runs): of each row the union of its runs (row, from, to), in order, as runs that don't touch."""
    order = Window.partitionBy("row").orderBy("from", "to")
    upto = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(upto.isNull() | (F.col("from") > upto), 1).otherwise(0)
    marked = runs.withColumn("_apart", apart)
    island = F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.withColumn("_island", island).groupBy("row", "_island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def repeats(rows: DataFrame, stage: Stage, gram: int = GRAM, winnow: int = WINNOW, min_run: int = MIN_RUN) -> DataFrame:
    """(row, runs) for the staged rows (row, doc_id, hashes, words) that repeat lines of an earlier place."""
    if min_run < gram + winnow - 1:
        raise ValueError("a run of min_run words needs a fingerprint: at least gram + winnow - 1")
    prints = stage.put("prints", fingerprints(rows, gram, winnow))
    twice = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    some = prints.join(twice, "print").select("row").distinct()
    least = stage.put("least", least_runs(rows.join(some, "row"), min_run))
    stage.drop("prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "from")
    first = least.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("first.row").alias("first_row"), F.col("first.from").alias("first_from"))
    later = least.join(first, "key").filter((F.col("row") != F.col("first_row")) | (F.col("from") != F.col("first_from")))
    return _joined(later.select("row", "from", "to"))


def deleted(runs: Column) -> Column:
    """The distinct lines of runs, in order; none for null."""
    lines = F.flatten(F.transform(runs, lambda r: F.sequence(r["from"], r["to"] - 1)))
    return F.coalesce(F.array_sort(F.array_distinct(lines)), F.array().cast("array<int>"))


def dedup(docs: DataFrame, label: str = "lines") -> DataFrame:
    """The rows of docs, their texts without the lines of later repeats."""
    stage = Stage(docs.sparkSession, label)
    whole = stage.put("docs", docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.monotonically_increasing_id().alias("row")))
    rows = stage.put("lines", lined(whole, F.col("row"), F.col("doc_id")))
    found = repeats(rows, stage)
    gone = lambda i: F.exists("runs", lambda r: (i >= r["from"]) & (i < r["to"]))
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~gone(i)), "\n")
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(clean)
    return whole.join(found, "row", "left").select(*[text.alias("text") if c == "text" else F.col(f"_row.{c}") for c in docs.columns])


def report(docs: DataFrame, label: str = "lines") -> DataFrame:
    """doc_id, n_lines, n_deleted, n_words, n_deleted_words, deleted (line numbers from 0, comma-joined) for each row."""
    stage = Stage(docs.sparkSession, label)
    rows = stage.put("lines", lined(docs, F.monotonically_increasing_id().alias("row"), F.col("doc_id")))
    full = rows.join(repeats(rows, stage), "row", "left").withColumn("gone", deleted(F.col("runs")))
    total = lambda which: F.aggregate(which, F.lit(0).cast("long"), lambda n, w: n + w)
    lost = F.transform("gone", lambda i: F.get("words", i).cast("long"))
    return full.select("doc_id", F.size("hashes").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), total(F.transform("words", lambda w: w.cast("long"))).alias("n_words"), total(lost).alias("n_deleted_words"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("deleted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), "op4")
