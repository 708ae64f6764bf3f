"""Rules on names, extensions, directories, paths and shares.

All rules are one array expression over an item, made when the plan is; matches come out by `explode`, without a shuffle. A
match reports only where its resource is the item itself, but every match opens its rule's children for the item.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions import paths
from veldt.plans.catalogue import Match, Rule


def _norm(p: Column) -> Column:
    return F.regexp_replace(F.translate(p, "\\", "/"), "/+$", "")


def _java(m: Match) -> str:
    return "(?d)" + m.regex()


def resource(m: Match, path: Column, name: Column) -> Column:
    """The path that a block matches: the item's, or that of a directory above it; null where it doesn't match."""
    fold = (lambda c: c) if m.case_sensitive else F.lower
    wanted = [p if m.case_sensitive else p.lower() for p in m.patterns]
    if m.target == "FileName":
        return F.when(fold(name).isin(*wanted) if m.literal else name.rlike(_java(m)), path)
    if m.target == "FileExtension":
        plain = [w.lstrip("*") for w in wanted]
        ext = F.regexp_extract(name, r"(\.[^.\\/]*)$", 1)
        return F.when(fold(ext).isin(*[w for p in plain for w in {p, "." + p.lstrip(".")}]) if m.literal else ext.rlike(_java(m)), path)
    if m.target == "ShareName":
        share = paths.share(path)
        root = F.regexp_extract(paths.normal(path), r"^(\\\\[^\\]+\\[^\\]+)", 1)
        return F.when(fold(share).isin(*wanted) if m.literal else (share != "") & share.rlike(_java(m)), root)
    if m.target == "DirectoryName":
        hit = (lambda d: fold(paths.leaf(d)).isin(*wanted)) if m.literal else (lambda d: paths.leaf(d).rlike(_java(m)))
        return F.get(F.filter(paths.ancestors(F.concat(path, F.lit("/x"))), hit), F.lit(0))
    if m.literal:  # the part of the path up to the end of the match
        whole, at = _norm(path), F.lit(None).cast("string")
        for w in reversed(wanted):
            plain = w.replace("\\", "/")
            place = F.instr(fold(whole), plain)
            at = F.when(place > 0, F.regexp_replace(F.substring(whole, F.lit(1), place + len(plain) - 1), "/+$", "")).otherwise(at)
        return at
    return F.when(path.rlike(_java(m)), path)


def _looked_up(rules: list[Rule], target: str, key: Column) -> Column | None:
    """The places of the rules whose literal, case-blind names have the key: one map for all rules."""
    held: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for m in r.matches:
            if m.target == target and m.literal and not m.case_sensitive:
                for p in m.patterns:
                    name = p.lower() if target == "FileName" else "." + p.lower().lstrip("*").lstrip(".")
                    held.setdefault(name, []).append(k)
    if not held:
        return None
    return F.coalesce(F.from_json(F.lit(json.dumps(held)), "map<string,array<int>>")[key], F.array().cast("array<int>"))


def metadata_matches(rules: list[Rule], path: Column, name: Column) -> Column:
    """Of an item, the matched rules: array of (ord, rule, resource), in the rules' order, a rule once. Literal names and
    extensions of all rules are a map lookup each; the other blocks are tests of their own."""
    kind = "array<struct<ord:int,rule:string,resource:string>>"
    lists = [x for x in (_looked_up(rules, "FileName", F.lower(name)), _looked_up(rules, "FileExtension", paths.extension(name))) if x is not None]
    names = F.from_json(F.lit(json.dumps([r.name for r in rules])), "array<string>")
    parts = [F.transform(x, lambda k: F.struct(k.alias("ord"), F.get(names, k).alias("rule"), path.alias("resource"))) for x in lists]
    tests = []
    for k, r in enumerate(rules):
        blocks = [resource(m, path, name) for m in r.matches if m.target != "Content" and not (m.literal and not m.case_sensitive and m.target in ("FileName", "FileExtension"))]
        if blocks:
            hit = F.coalesce(*blocks)
            tests.append(F.when(hit.isNotNull(), F.struct(F.lit(k).alias("ord"), F.lit(r.name).alias("rule"), hit.alias("resource"))))
    if tests:
        parts.append(F.array_compact(F.array(*tests)))
    if not parts:
        return F.array().cast(kind)
    every = F.concat(*[p.cast(kind) for p in parts])
    # Of a rule's matches the item itself goes before a directory above it.
    first = lambda all_: F.filter(all_, lambda m, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda e: e["ord"] == m["ord"]))
    return F.when(F.size(every) > 1, F.array_sort(F.transform(F.array(every), first)[0])).otherwise(every)


def opened(rules: list[Rule], path: Column, name: Column) -> Column:
    """Of an item, the names of the matched rules that have children on content."""
    parents = {r.parent for r in rules if r.parent and r.content()}
    some = [r for r in rules if r.name in parents]
    return F.transform(metadata_matches(some, path, name), lambda m: m["rule"]) if some else F.array().cast("array<string>")


def is_direct(res: Column, path: Column) -> Column:
    return F.lower(_norm(res)) == F.lower(_norm(path))


def explode_matches(items: DataFrame) -> DataFrame:
    """(path, ord, rule, resource, direct), and item if there is one, from items with a column `metadata`."""
    keys = [c for c in ("item", "path") if c in items.columns]
    return items.select(*keys, F.explode("metadata").alias("m")).select(*keys, "m.*", is_direct(F.col("m.resource"), F.col("path")).alias("direct"))
