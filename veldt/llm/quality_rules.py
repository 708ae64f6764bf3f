"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how right each is, and the
posterior probability of good quality decides.

Everything that touches rows is DataFrame expressions. The rows are reduced to the counts of vote patterns, of which there
are at most 3 to the number of rules (19,683) whatever the input; the EM runs over those counts.

Defined cases: a null or empty text has no words and fails the base rule; an empty table returns no rows; repeated rows are
each judged, alike; other columns pass through untouched (`annotate` adds only the columns it names).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, bind, table, words_of

#: Frequent function words of the languages that the corpus is expected in.
FUNCTION_WORDS = (
    "the and of to in is that for it with as was be at by this are from "
    "der die und das ist nicht ein eine zu den von mit auf des sich "
    "le la les de et un une des est que qui pour dans en du "
    "el los las y por con del una su para al es se lo"
).split()
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Before EM: a rule's accuracy on good and on bad documents.
START = (0.98, 0.3)


@dataclass(frozen=True)
class Rule:
    """Votes reject (-1) or accept (+1) by a measure's value; otherwise abstains (0)."""

    name: str
    reject: Column
    accept: Column

    def vote(self) -> Column:
        return F.coalesce(F.when(self.reject, -1).when(self.accept, 1), F.lit(0)).cast("int").alias(f"v_{self.name}")


@dataclass(frozen=True)
class Accuracies:
    """prior: share of good documents; hit: by rule, the chance that it accepts a good one and that it rejects a bad one."""

    prior: float
    hit: dict[str, tuple[float, float]]


def _repeated(words: Column, size: int) -> Column:
    """Words inside any window of `size` words that occurs twice or more, counting the first occurrence too."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), (F.get(s, k - 1)["h"] == x["h"]), (F.get(s, k + 1)["h"] == x["h"]), F.lit(False))), lambda x: x["i"]))

        return F.aggregate(
            bind(ordered, starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + size).alias("end"), (a["n"] + p + size - F.greatest(a["end"], p)).alias("n")),
            lambda a: a["n"],
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    some = bind(hashes, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(F.size(words) > size, some).otherwise(0)


def measures(text: Column) -> list[Column]:
    """What rules read, one struct for each text, made in a single pass over its words and lines."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words, REPEAT_WINDOW).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda x, i: x == F.get(words, i - 1))).cast("long").alias("n_doubled"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"),
        )

    def by_line(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(found, lambda x: x.rlike(r"[.!?\"»”][\x20\x09-\x0D]*$"))).cast("long").alias("n_closed_lines"),
        )

    return [
        bind(words_of(text), of).alias("_w"),
        bind(lines, by_line).alias("_l"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    ]


def default_rules() -> list[Rule]:
    c, share = F.col, lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    mean, symbols, dup = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines")
    repeat, capitals, closed = share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_closed_lines", "n_lines")
    doubled = share("n_doubled", "n_words")
    return [
        Rule("length", c("n_words") < MIN_WORDS, c("n_words") >= 50),
        Rule("doubled", doubled >= 0.2, doubled <= 0.05),
        Rule("word_length", ~mean.between(2, 14), mean.between(3, 10)),
        Rule("symbols", symbols >= 0.15, symbols <= 0.05),
        Rule("dup_lines", dup >= 0.3, dup <= 0.1),
        Rule("repeats", repeat >= 0.2, repeat <= 0.1),
        Rule("capitals", capitals >= 0.3, capitals <= 0.15),
        Rule("function_words", (c("n_words") >= 20) & (c("n_function_words") == 0), c("n_function_words") >= 3),
        Rule("closed_lines", closed <= 0.2, closed >= 0.7),
    ]


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 50) -> Accuracies:
    """EM over counts of vote patterns. It starts from rules that seldom reject a good document and each see some of the
    bad ones. On good documents accuracies stay within [0.6, 0.999]; on bad ones at 0.02 at least and, as a rule is better
    than a guess, above its error on good ones. The prior stays within [0.05, 0.98]. With no documents the starting values
    are returned."""
    prior, hit = 0.8, {n: START for n in names}
    clamp = lambda x, lo, hi: min(hi, max(lo, x))
    for _ in range(rounds if patterns else 0):
        model, total, good = Accuracies(prior, hit), 0.0, 0.0
        seen = {n: [2 * START[0], 2.0, 2 * START[1], 2.0] for n in names}  # right and all votes on good, then on bad
        for votes, count in patterns:
            p = 1 / (1 + math.exp(-clamp(logit(model, dict(zip(names, votes, strict=True))), -50, 50)))
            total, good = total + count, good + count * p
            for n, v in zip(names, votes, strict=True):
                if v:
                    s = seen[n]
                    s[0] += count * p * (v > 0)
                    s[1] += count * p
                    s[2] += count * (1 - p) * (v < 0)
                    s[3] += count * (1 - p)
        prior = clamp(good / total, 0.05, 0.98)
        right = {n: clamp(s[0] / s[1], 0.6, 0.999) for n, s in seen.items()}
        hit = {n: (right[n], clamp(s[2] / s[3], max(0.02, 1.05 * (1 - right[n])), 0.999)) for n, s in seen.items()}
    return Accuracies(prior, hit)


def weights(model: Accuracies, name: str) -> tuple[float, float]:
    """What an accepting and a rejecting vote of the rule add to the log odds of good quality."""
    good, bad = model.hit[name]
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def logit(model: Accuracies, votes: dict[str, int]) -> float:
    return math.log(model.prior / (1 - model.prior)) + sum(weights(model, n)[0 if v > 0 else 1] for n, v in votes.items() if v)


def posterior(model: Accuracies) -> Column:
    """The probability of good quality, from the columns v_<rule>."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for n in model.hit:
        up, down = weights(model, n)
        odds = odds + F.when(F.col(f"v_{n}") > 0, up).when(F.col(f"v_{n}") < 0, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def measured(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """keys, the measures of each text, and the rules' votes."""
    flat = docs.select(*keys, F.struct(*measures(F.col("text"))).alias("_m"))
    flat = flat.select(*[F.col(c) for c in flat.columns[:-1]], "_m.*").select("*", "_w.*", "_l.*").drop("_w", "_l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return flat.select("*", failed.alias("base_failed"), *[r.vote() for r in default_rules()])


def vote_patterns(votes: DataFrame, names: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """Counts by vote pattern: at most 3 ** len(names) rows."""
    rows = votes.groupBy(*[f"v_{n}" for n in names]).count().collect()
    return sorted((tuple(r[:-1]), r[-1]) for r in rows)


def judge(docs: DataFrame, keys: list[str], threshold: float = 0.5, label: str = "quality") -> DataFrame:
    """keys, measures, votes, p_good and kept for each row. Texts are read once: the narrow measures are staged."""
    votes = Stage(docs.sparkSession, label).put("votes", measured(docs, [F.col(k) for k in keys]))
    names = [r.name for r in default_rules()]
    model = fit(vote_patterns(votes, names), names)
    scored = votes.withColumn("p_good", posterior(model))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def filter_good(docs: DataFrame, threshold: float = 0.5, label: str = "quality-keep") -> DataFrame:
    """The rows of good quality, all columns as they were. The model needs the vote counts of all rows before any row can be
    judged, so rows are staged with their votes: texts are measured once, and no shuffle joins them to their verdicts."""
    names = [r.name for r in default_rules()]
    voted = measured(docs, [F.struct(*docs.columns).alias("_row"), F.col("text")]).select("_row", "base_failed", *[f"v_{n}" for n in names])
    rows = Stage(docs.sparkSession, label).put("voted", voted)
    model = fit(vote_patterns(rows, names), names)
    return rows.filter(~F.col("base_failed") & (posterior(model) >= threshold)).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, then p_good, for every row of documents."""
    out = judge(table(spark, sf_dir, "documents"), ["doc_id"], label="op1")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
