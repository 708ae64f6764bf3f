"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers; these are seeds. Secrets are a kind of their own,
whose seeds are keys of well-known forms; they are no base spans. The words beside seeds become lexical patterns: the last one,
two and three to the left, the first one and two to the right, and the nearest on both sides; other tokens with digits or an
at-sign are candidates. Rounds go over the graph of patterns and values: a pattern is trusted with a kind if it has enough
distinct values known to be of the kind and their score outweighs what speaks against it, values known to be of other kinds
or of an unfitting shape; values not yet known that fit say nothing. Candidates of a fitting shape in trusted patterns become
known, with their best pattern's confidence as score, and are seeds from the next round on. Rounds end when no value is
added. Trusted patterns mark their candidates of a fitting shape as further spans.

A context is read within CONTEXT characters of a value, so words of more characters than that are compared by what lies in
them; a value of the same pattern that stands before or after is a word # of the context, so lists are contexts, too.

All is DataFrame expressions. Java's regular expressions give no offsets, so a text is split at the matches, and offsets are
running sums of lengths, in windows over one text's matches. Base patterns start only where a run of their characters starts
and never give back what they took, so that long runs cost linear time; both leave the matches as they are. A frequent
pattern is aggregated before shuffles and reduced to its distinct values.

Defined cases: a null or empty text has no spans; a null doc_id stays; rows that repeat are rows of their own and their values
count once; a seed of a secret that overlaps a base span isn't one; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldt.llm.common import Stage, bind, table

KINDS, BASE = ("email", "ip", "card", "phone", "secret"), 4
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Keys of well-known forms: 160 bits in hexadecimal, and two vendors' prefixed ones.
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![0-9A-Za-z])"
#: A token with a digit or an at-sign, and groups of digits that follow it after single blanks.
_PART_OF = r"[^\x20\x09-\x0D,;\"'=<>|]"
CANDIDATE = rf"(?<![^\x20\x09-\x0D,;\"'=<>|:])(?=[0-9A-Za-z+(]){_PART_OF}*[0-9@](?:{_PART_OF}*[A-Za-z0-9])?(?:\)?\x20[0-9(][0-9().-]*[0-9])*+"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: What a discovered value of each kind must look like.
SHAPES = (
    r"^[^@]+@[^@]+$|^[A-Za-z0-9._%+-]+$", r"^[0-9A-Fa-f:.]*[:.][0-9A-Fa-f:.]+$", r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", r"^[+(0-9][0-9(). -]{5,}[0-9]$",
    r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}$",
)
MIN_SEEDS, MIN_CONFIDENCE, CONTEXT = 5, 0.8, 64
_SPACE = r"[\x20\x09-\x0D]+"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Of each match: its kind and place in order, the value, the length of the text since the match before, and its contexts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.split(text, pattern, -1)
    left = lambda between, i: F.concat(F.when((i > 0) & (F.length(F.get(between, i)) < CONTEXT), "# ").otherwise(""), F.right(F.get(between, i), F.lit(CONTEXT)))
    right = lambda between, i: F.concat(F.left(F.get(between, i + 1), F.lit(CONTEXT)), F.when((i + 2 < F.size(between)) & (F.length(F.get(between, i + 1)) < CONTEXT), " #").otherwise(""))
    row = lambda between: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("value"), F.length(F.get(between, i)).alias("gap"), left(between, i).alias("left"), right(between, i).alias("right")))
    return bind(cut, row)


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    ip, card = value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), F.when(n.between(16, 19), F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))")).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).when(kind == 3, n.between(8, 15)).otherwise(kind == 4)


def _contexts(left: Column, right: Column) -> Column:
    """The lexical patterns of a place, with digits as 0 and letters in lower case."""
    words = lambda c: F.array_remove(F.split(F.lower(F.regexp_replace(c, "[0-9]", "0")), _SPACE), "")

    def made(w: Column) -> Column:
        a, b = w["a"], w["b"]
        last = lambda n: F.when(F.size(a) >= n, F.concat(F.array_join(F.slice(a, -n, n), " "), F.lit(" _")))
        first = lambda n: F.when(F.size(b) >= n, F.concat(F.lit("_ "), F.array_join(F.slice(b, 1, n), " ")))
        around = F.when((F.size(a) > 0) & (F.size(b) > 0), F.concat(F.element_at(a, -1), F.lit(" _ "), F.element_at(b, 1)))
        return F.array_compact(F.array(last(1), last(2), last(3), first(1), first(2), around))

    return bind(F.struct(words(left).alias("a"), words(right).alias("b")), made)


def located(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The staged rows (row, doc_id), and their matches: row, kind (5: candidate), start, end, value, left, right."""
    text = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
    hits = F.concat(*[_matches(F.col("some"), k, p) for k, p in enumerate((*PATTERNS, SECRET, CANDIDATE))])
    held = docs.select("doc_id", text.alias("some")).select("doc_id", hits.alias("hits"), F.monotonically_increasing_id().alias("row"))
    rows = stage.put("hits", held)
    flat = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    return rows.select("row", "doc_id"), flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("i", "gap")


def bootstrap(seeds: DataFrame, candidates: DataFrame, stage: Stage, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, kind, confidence) of the contexts that are trusted, from seeds (kind, value, left, right) and candidates
    (value, left, right)."""
    context = lambda rows, kind: rows.select(kind.alias("seed"), "value", F.explode(_contexts(F.col("left"), F.col("right"))).alias("pattern"))
    both = context(seeds, F.col("kind")).unionByName(context(candidates, F.lit(None).cast("int")))
    fits = [F.col("value").rlike(s).alias(f"fit{k}") for k, s in enumerate(SHAPES)]
    edges = stage.put("edges", both.groupBy("pattern", "value").agg(F.min("seed").alias("seed")).select("pattern", "value", "seed", *fits))
    known = stage.put("known0", edges.filter("seed is not null").groupBy("value").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("score")))
    # Only patterns with enough values can ever be trusted: the others' edges say nothing.
    often = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_seeds).select("pattern")
    edges = stage.put("often", edges.join(often, "pattern"))
    stage.drop("edges")
    r = 0
    while True:
        seen = edges.drop("seed").join(known, "value", "left")
        of = lambda k: F.col("kind") == k
        sums = []
        for k in range(len(KINDS)):
            against = F.when(F.col("kind").isNull(), ~F.col(f"fit{k}")).otherwise(~of(k))
            sums += [F.count(F.when(of(k), 1)).alias(f"n{k}"), F.sum(F.when(of(k), F.col("score")).otherwise(0.0)).alias(f"sum{k}"), F.count(F.when(against, 1)).alias(f"against{k}")]
        judged = seen.groupBy("pattern").agg(*sums)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n"), (F.col(f"sum{k}") / F.nullif(F.col(f"n{k}") + F.col(f"against{k}"), F.lit(0))).alias("confidence")) for k in range(len(KINDS))]))
        trusted = stage.put(f"trusted{r}", judged.select("pattern", each.alias("t")).select("pattern", "t.*").filter((F.col("n") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "kind", "confidence"))
        fitting = F.lit(False)
        for k in range(len(KINDS)):
            fitting = fitting | (of(k) & F.col(f"fit{k}"))
        found = seen.filter("kind is null").drop("kind", "score").join(trusted, "pattern").filter(fitting)
        more = stage.put(f"more{r}", found.groupBy("value").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("score")))
        if more.isEmpty():
            return trusted
        r += 1
        known = stage.put(f"known{r}", known.unionByName(more))
        stage.drop(f"known{r - 1}", f"more{r - 1}", f"trusted{r - 1}")


def _apart(hits: DataFrame, own: Column, others: Column) -> DataFrame:
    """The hits for which `own` holds and that overlap none for which `others` holds."""
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(others, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(others, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = hits.withColumn("_before", before).withColumn("_after", after).filter(own)
    return marked.filter(~F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("_after") < F.col("end"), F.lit(False))).drop("_before", "_after")


def spans(docs: DataFrame, stage: Stage, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, hidden: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged rows (row, doc_id), and the spans: row, kind, start, end, value, base. Values for which `hidden` holds are
    no seeds and no base spans: what is found of them measures recall."""
    rows, hits = located(docs, stage)
    good = _valid(F.col("kind"), F.col("value"))
    hits = stage.put("located", hits.filter((good if hidden is None else good & ~hidden) | (F.col("kind") == len(KINDS))))
    is_base, is_seed, kind = F.col("kind") < BASE, F.col("kind") < len(KINDS), F.col("kind")
    base = hits.filter(is_base)
    secrets = _apart(hits, kind == BASE, is_base)
    free = _apart(hits, kind == len(KINDS), is_seed)
    trusted = bootstrap(base.unionByName(secrets), free, stage, min_seeds, min_confidence)
    placed = free.withColumn("pattern", F.explode(_contexts(F.col("left"), F.col("right")))).drop("kind").join(trusted, "pattern")
    shape = F.lit(False)
    for k, s in enumerate(SHAPES):
        shape = shape | ((F.col("kind") == k) & F.col("value").rlike(s))
    found = placed.filter(shape).groupBy("row", "start", "end", "value").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    columns = ["row", "kind", "start", "end", "value"]
    return rows, base.select(*columns, F.lit(True).alias("base")).unionByName(secrets.select(*columns, F.lit(False).alias("base"))).unionByName(found.select(*columns, F.lit(False).alias("base")))


def _listed(which: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, label: str = "pii") -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans, n_found (spans that aren't base ones), n_spans for each
    row of docs."""
    rows, found = spans(docs, Stage(docs.sparkSession, label))
    every = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("all"))
    full = rows.join(every, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(every.schema["all"].dataType)))
    base = F.filter("all", lambda s: s["base"])
    of_kind = F.transform(base, lambda s: s["kind"])
    count = [(F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS[:BASE])]
    return full.select("doc_id", *count, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: ~s["base"])).cast("long").alias("n_found"), F.size("all").cast("long").alias("n_spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), "op5")
