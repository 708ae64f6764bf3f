"""Ignore rules as one predicate, made when the plan is: no join, and it can be pushed to where paths are listed."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions import paths
from veldt.plans.catalogue import IgnoreRule


def _wild(p: str) -> bool:
    return "*" in p or "?" in p


def matches(rule: IgnoreRule, path: Column, name: Column) -> Column:
    """Whether an item falls under a rule. Extension patterns match the end of the name, directory names a whole segment
    above the item, directory paths a prefix, or the whole path if they have wildcards. Case doesn't count."""
    p = rule.pattern
    whole = F.lower(paths.normal(path))
    if rule.target == "FileName":
        return paths.likes(name, p, False) if _wild(p) else F.lower(name) == p.lower()
    if rule.target == "FileExtension":
        return paths.likes(name, "*" + p.lstrip("*"), False)
    if rule.target == "DirectoryName":
        return paths.likes(whole, "*\\" + p.lower() + "\\*", False) | paths.likes(whole, p.lower() + "\\*", False)
    if rule.target == "ShareName":
        return paths.likes(paths.share(path), p, False)
    clean = p.replace("/", "\\").lower()
    return paths.likes(whole, clean, False) if _wild(p) else whole.startswith(clean.rstrip("\\"))


def ignored(rules: Iterable[IgnoreRule], path: Column, name: Column) -> Column:
    """Whether any enabled rule matches. Plain names and endings are one `in` or one pattern each, not one test a rule."""
    live = [r for r in rules if r.enabled]
    endings = [r.pattern.lstrip("*").lower() for r in live if r.target == "FileExtension" and not _wild(r.pattern.lstrip("*"))]
    names = [r.pattern.lower() for r in live if r.target == "FileName" and not _wild(r.pattern)]
    wild_paths = [paths.wildcard_regex(r.pattern.replace("/", "\\").lower(), False) for r in live if r.target == "DirectoryPath" and _wild(r.pattern)]
    easy = {id(r) for r in live if (r.target == "FileExtension" and not _wild(r.pattern.lstrip("*"))) or (r.target == "FileName" and not _wild(r.pattern)) or (r.target == "DirectoryPath" and _wild(r.pattern))}
    tests = [matches(r, path, name) for r in live if id(r) not in easy]
    if names:
        tests.append(F.lower(name).isin(*names))
    if endings:
        tests.append(F.lower(name).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"))
    if wild_paths:
        tests.append(F.lower(paths.normal(path)).rlike("|".join(wild_paths)))
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False))


def keep(items: DataFrame, rules: Iterable[IgnoreRule]) -> DataFrame:
    return items.filter(~ignored(rules, F.col("path"), F.col("name")))


def all_matching(items: DataFrame, rules: Iterable[IgnoreRule]) -> DataFrame:
    """(path, pattern, target) of every rule that each item falls under."""
    found = [F.when(matches(r, F.col("path"), F.col("name")), F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.target).alias("target"))) for r in rules if r.enabled]
    if not found:
        return items.select("path", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("target")).limit(0)
    return items.select("path", F.explode(F.array_compact(F.array(*found))).alias("r")).select("path", "r.*")


def prune(items: DataFrame, rules: Iterable[IgnoreRule]) -> DataFrame:
    """Without items below an ignored directory: rules on directories and shares, against every directory above an item."""
    live = [r for r in rules if r.enabled and r.target in ("DirectoryName", "DirectoryPath", "ShareName")]
    if not live:
        return items
    one = lambda d: reduce(lambda a, b: a | b, (matches(r, F.concat(d, F.lit("/")), paths.leaf(d)) for r in live))
    return items.filter(~F.exists(paths.ancestors(F.col("path")), one))
