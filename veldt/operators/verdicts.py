"""Verdicts of a language model on findings: distinct questions are asked once, answers join back, and filters follow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE_CHARS, SNIPPET_CHARS, CONTEXT_CHARS = 512, 1200, 1800
#: What makes two questions one, beside the model, its level and the wording of the question, which are a run's.
KEY = ("classifier_name", "value_hash", "snippet_hash")
PROMPT_VERSION, LEVELS = "1", ("strict", "balanced", "lenient")


def prompt(classifier: str, value: str, snippet: str, level: str = "balanced") -> str:
    """What a model is asked about a candidate; the level says how sure it has to be."""
    return json.dumps({"level": level, "task": "Is this candidate a live secret or personal data? Answer with a JSON object: is_sensitive (boolean), reason (string).", "rule": classifier, "candidate": value[:CANDIDATE_CHARS], "snippet": snippet[:SNIPPET_CHARS]})


def answer(reply: str) -> tuple[str, bool | None, str]:
    """(status, is_sensitive, reason) from a reply: the JSON between its first { and last }."""
    try:
        found = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
        sensitive = found["is_sensitive"]
        if not isinstance(sensitive, bool):
            raise TypeError("is_sensitive")
        return ("Confirmed" if sensitive else "Rejected"), sensitive, str(found.get("reason", ""))
    except (ValueError, KeyError, TypeError) as e:
        return "Error", None, f"unreadable reply: {e}"


def cache_key(model: str, level: str) -> str:
    """What verdicts of other models, levels or wordings don't share."""
    return f"{model}|{level}|{PROMPT_VERSION}"


def judged(findings: DataFrame, ask: Callable[[str], str] | None, model: str = "", level: str = "balanced", known: DataFrame | None = None) -> DataFrame:
    """findings with llm_status, llm_is_sensitive, llm_reason, llm_model; `ask` takes a prompt and gives a reply. None skips them
    all. `known` are verdicts of earlier runs (KEY, run_key, llm_status, llm_is_sensitive, llm_reason): questions that they
    answer, by the same model at the same level, aren't asked again."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    keyed = findings.withColumn("snippet_hash", F.sha2(F.coalesce("snippet", F.lit("")), 256))
    if ask is None:
        return keyed.drop("snippet_hash").withColumns({"llm_model": F.lit(None).cast("string"), "llm_status": F.lit("Skipped"), "llm_is_sensitive": F.lit(None).cast("boolean"), "llm_reason": F.lit(None).cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                try:
                    verdict = answer(ask(prompt(r["classifier_name"], r["value"] or "", r["snippet"] or "", level)))
                except Exception as e:  # noqa: BLE001  a model that fails leaves the finding as it was
                    verdict = ("Error", None, str(e))
                out.append({k: r[k] for k in KEY} | dict(zip(("llm_status", "llm_is_sensitive", "llm_reason"), verdict, strict=True)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, pa.string()) for k in (*KEY, "llm_status")] + [("llm_is_sensitive", pa.bool_()), ("llm_reason", pa.string())]))

    questions = keyed.filter("not is_metadata").groupBy(*KEY).agg(F.min("value").alias("value"), F.min("snippet").alias("snippet"))
    old = None
    if known is not None:
        old = known.filter((F.col("run_key") == cache_key(model, level)) & F.col("llm_status").isin("Confirmed", "Rejected")).select(*KEY, "llm_status", "llm_is_sensitive", "llm_reason").dropDuplicates(list(KEY))
        questions = questions.join(old.select(*KEY), list(KEY), "left_anti")
    answers = questions.mapInArrow(run, "classifier_name string, value_hash string, snippet_hash string, llm_status string, llm_is_sensitive boolean, llm_reason string")
    every = answers if old is None else answers.unionByName(old)
    return keyed.join(every, list(KEY), "left").drop("snippet_hash").withColumn("llm_model", F.when(F.col("llm_status").isNotNull(), F.lit(model))).withColumn("llm_status", F.coalesce("llm_status", F.lit("Skipped")))


def remembered(found: DataFrame, level: str = "balanced") -> DataFrame:
    """The verdicts of a run (judged findings) as later runs take them."""
    rows = found.filter(F.col("llm_status").isin("Confirmed", "Rejected")).withColumn("snippet_hash", F.sha2(F.coalesce("snippet", F.lit("")), 256))
    return rows.select(*KEY, F.concat_ws("|", F.coalesce("llm_model", F.lit("")), F.lit(level), F.lit(PROMPT_VERSION)).alias("run_key"), "llm_status", "llm_is_sensitive", "llm_reason").dropDuplicates(list(KEY))


def kept(findings: DataFrame, sensitive_only: bool = False) -> DataFrame:
    """Rejected findings go; those with errors or skipped stay unless only sensitive ones are asked for."""
    if sensitive_only:
        return findings.filter(F.coalesce("llm_is_sensitive", F.lit(False)))
    return findings.filter(~(F.coalesce("llm_status", F.lit("")) == "Rejected"))
