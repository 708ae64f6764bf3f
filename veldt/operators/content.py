"""Rules on text: one Arrow-batched step finds which rules may match, and where they do.

The JVM only decides whether an item's text is read at all, by its extension and by the metadata matches that open child
rules; columns that matching doesn't need don't travel. In Python all keywords of all rules are one automaton, which passes
over a window once, and only rules with a keyword there (or without keywords) run their pattern. Texts are read in windows
that overlap, so that no pattern meets an unbounded text. Nothing is shuffled, but for tables of a few files, whose rows are
dealt over the cores.

`to_try` is the same prefilter as an expression, for reports of which rules an item passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.validators import Candidate, validate
from veldt.plans.catalogue import Rule, compiled

CANDIDATE = "item string, path string, ord int, idx int, len int, value string, snippet string, snippet_start int, confidence double, reason string"
WINDOW_CHARS, OVERLAP, CONTEXT, SNIPPET = 65_536, 4_096, 512, 50
_ARROW = pa.schema([("item", pa.string()), ("path", pa.string()), ("ord", pa.int32()), ("idx", pa.int32()), ("len", pa.int32()), ("value", pa.string()), ("snippet", pa.string()), ("snippet_start", pa.int32()), ("confidence", pa.float64()), ("reason", pa.string())])
#: A table below this many bytes a core has its rows dealt over the cores, about SPREAD_BYTES each.
FEW_BYTES, SPREAD_BYTES = 128 << 20, 1 << 20


@dataclass(frozen=True)
class Reading:
    """How texts are read: in windows of `window` characters, each from `overlap` before the end of the last (0: whole), and
    of texts beyond `sample_over` characters, if given, only the first and the last `part`."""

    window: int = WINDOW_CHARS
    overlap: int = OVERLAP
    sample_over: int | None = None
    part: int = 1 << 20

    def spans(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Of a text of n characters: start, end, the place up to which matches are known, the end of what is read on from there."""
        parts = [(0, n)] if self.sample_over is None or n <= self.sample_over else [(0, min(n, self.part)), (max(n - self.part, min(n, self.part)), n)]
        for low, high in parts:
            start, known = low, low
            while start < high or start == low:
                end = min(high, start + self.window) if self.window else high
                yield start, end, known, high
                if end == high:
                    break
                known, start = end, end - self.overlap


def one_of(ext: Column, scope: frozenset[str]) -> Column:
    """Whether an extension is in a set: one literal that holds the set, so that a plan of many rules stays small."""
    mark = "\x1f"
    return F.lit(mark + mark.join(sorted(scope)) + mark).contains(F.concat(F.lit(mark), ext, F.lit(mark)))


def in_scope(rule: Rule, ext: Column) -> Column:
    scope = rule.scope()
    return one_of(ext, scope) if scope else F.lit(True)


def has_keyword(rule: Rule, text: Column, lowered: Column) -> Column:
    tests = [text.contains(k) if cs else lowered.contains(k.lower()) for k, cs in rule.keywords()]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def item_gate(rules: list[Rule], ext: Column, metadata: Column) -> Column:
    """Whether an item's text is read at all: its extension is in some content rule's scope, or a metadata rule matched."""
    scopes = [r.scope() for r in rules if r.content()]
    if any(not s for s in scopes):
        return F.lit(True)
    return (one_of(ext, frozenset().union(*scopes)) if scopes else F.lit(False)) | (F.size(metadata) > 0)


def to_try(rules: list[Rule], ext: Column, text: Column, metadata: Column, lowered: Column | None = None) -> Column:
    """The places of the content rules whose prefilter passes. `lowered` is the text in lower case, if it is at hand."""
    lowered = F.lower(text) if lowered is None else lowered
    opened = F.transform(metadata, lambda m: m["rule"]) if any(r.parent for r in rules) else None
    found = []
    for k, r in enumerate(rules):
        if r.content():
            gate = in_scope(r, ext) & has_keyword(r, text, lowered)
            found.append(F.when(gate & F.array_contains(opened, r.parent) if r.parent else gate, F.lit(k)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")


def entropy_of(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


class Matcher:
    """The content rules of a catalogue, ready to run."""

    def __init__(self, rules: list[Rule], reading: Reading):
        self.rules, self.reading = rules, reading
        self.regexes = {k: compiled("|".join(m.regex() for m in r.content())) for k, r in enumerate(rules) if r.content()}
        self.scopes = {k: rules[k].scope() for k in self.regexes}
        self.groups = {k: int(g) if g.isdigit() else g for k in self.regexes if (g := rules[k].value_group)}
        self.by_ext: dict[str, tuple[list[int], list[int]]] = {}
        #: By keyword in lower case, the rules that it opens, each with the keyword as it is where case counts.
        self.opens: dict[str, list[tuple[int, str | None]]] = {}
        for k in self.regexes:
            for word, cased in rules[k].keywords():
                self.opens.setdefault(word.lower(), []).append((k, word if cased else None))
        self.bare = {k for k in self.regexes if not rules[k].keywords()}
        self.hits = self._hits()

    def _hits(self):
        """A function from a text in lower case to the keywords that it has."""
        words = [w for w in self.opens if w]
        try:
            import ahocorasick
        except ImportError:
            return lambda lowered: {w for w in words if w in lowered}
        if not words:
            return lambda lowered: set()
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        return lambda lowered: {w for _, w in automaton.iter(lowered)}

    def scoped(self, ext: str, opened: list[str]) -> set[int]:
        """The rules that may run on an item of this extension for which the named rules matched by metadata."""
        if ext not in self.by_ext:
            inside = [k for k, s in self.scopes.items() if not s or ext in s]
            self.by_ext[ext] = [k for k in inside if not self.rules[k].parent], [k for k in inside if self.rules[k].parent]
        free, children = self.by_ext[ext]
        return {*free, *(k for k in children if self.rules[k].parent in opened)}

    def tries(self, text: str, scoped: set[int]) -> list[int]:
        out = self.bare & scoped
        for w in self.hits(text.lower()):
            out |= {k for k, exact in self.opens[w] if k in scoped and k not in out and (exact is None or exact in text)}
        return sorted(out)

    def find(self, text: str, path: str, ext: str, opened: list[str]) -> Iterator[tuple]:
        """The matches in a text: rule, place, length, trimmed value, confidence, reason."""
        scoped = self.scoped(ext, opened)
        if not scoped:
            return
        passed: dict[int, int] = {}
        for start, end, known, high in self.reading.spans(len(text)):
            for k in self.tries(text[start:end] if start or end < len(text) else text, scoped):
                for found in self._matches(k, text, path, start, end, known, high, passed):
                    yield k, *found

    def _matches(self, k: int, text: str, path: str, start: int, end: int, known: int, high: int, passed: dict[int, int]) -> Iterator[tuple]:
        """The matches of a rule in a window. `passed` has, by rule, the place up to which matches have been told."""
        rule, group = self.rules[k], self.groups.get(k, 0)
        for m in self.regexes[k].finditer(text, max(start, passed.get(k, 0)), end):
            # A match that reaches the end of a window counts in the next, if that has it whole; all before counted here.
            met = start < known and (m.end() < known or (m.end() == known and m.start() == start))
            if met or (m.end() == end < high and m.start() > end - self.reading.overlap):
                continue
            if m.end() == end < high:  # longer than the overlap, so the next hasn't it whole: read on from there in a window twice as long
                passed[k] = m.start()
                yield from self._matches(k, text, path, start, min(high, start + 2 * (end - start)), known, high, passed)
                return
            passed[k] = m.end()
            g = group if m[group] is not None else 0
            at, raw = m.start(g), m[g]
            value = raw.strip()
            if not value or (rule.entropy > 0 and entropy_of(value) < rule.entropy):
                continue
            left = max(0, at - CONTEXT)
            good, confidence, reason = validate(rule.validator, Candidate(value, path, text[left : at + len(raw) + CONTEXT], at - left))
            if good:
                yield at, len(raw), value, confidence, reason


def _matcher(rules: list[Rule], reading: Reading):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, reading)
        for batch in batches:
            out: list[dict] = []
            for item, path, ext, text, opened in zip(*(batch.column(c).to_pylist() for c in ("item", "path", "ext", "text", "opened")), strict=True):
                for k, at, n, value, confidence, reason in matcher.find(text or "", path or "", ext or "", opened or []):
                    left = max(0, at - SNIPPET)
                    out.append({"item": item, "path": path, "ord": k, "idx": at, "len": n, "value": value, "snippet": text[left : at + n + SNIPPET], "snippet_start": at - left, "confidence": confidence, "reason": reason})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over more tasks where the table is too small to give every core one; a shuffle of bounded size, else none."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(2 * cores, size // SPREAD_BYTES)
    return rows.repartition(wanted, key) if wanted > 1 and size < cores * FEW_BYTES else rows


def candidates(items: DataFrame, rules: list[Rule], reading: Reading = Reading()) -> DataFrame:
    """The places of content rules in items (item, path, ext, text, and opened: names of the rules that metadata matched)."""
    if not any(r.content() for r in rules):
        return items.sparkSession.createDataFrame([], CANDIDATE)
    gated = items.filter(item_gate(rules, F.col("ext"), F.col("opened"))).select("item", "path", "ext", "text", "opened")
    return spread(gated, "item").mapInArrow(_matcher(rules, reading), CANDIDATE)


def classifiers(items: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, matched): the rules whose prefilter an item passes, matched or not."""
    names = F.array(*[F.lit(r.name) for r in rules])
    return items.select("path", F.array_sort(F.array_distinct(F.transform(to_try(rules, F.col("ext"), F.col("text"), F.col("metadata")), lambda k: F.get(names, k)))).alias("matched"))


def windows(text: Column, size: int = WINDOW_CHARS, overlap: int = OVERLAP) -> Column:
    """A text's windows as (start, part): each starts `overlap` characters before the one before ends."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("part")))


def head_tail(text: Column, limit: int = 10 << 20, part: int = 1 << 20) -> Column:
    """Of a text beyond `limit` characters, its first and last parts; else the whole."""
    return F.when(F.length(text) > limit, F.array(F.left(text, F.lit(part)), F.right(text, F.lit(part)))).otherwise(F.array(text))
