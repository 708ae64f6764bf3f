"""Text of JSON and HTML. HTML is expressions; JSON of any depth needs Arrow-batched Python."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIMIT = 64 << 20
#: The entities that HTML text uses most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(page: Column) -> Column:
    """Tags removed and the usual entities decoded."""
    out = F.regexp_replace(page, "<[^>]*>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def html_resources(page: Column) -> Column:
    """The addresses of images and objects, without repeats, in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)<(?:img|object|embed)\b[^>]*?\b(?:src|data)\s*=\s*[\"']([^\"']+)"), F.lit(1)))


def flat_lines(value: Any) -> Iterator[str]:
    """Depth first: names and values, a line each; strings with markup once more as text."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield k
            yield from flat_lines(v)
    elif isinstance(value, list):
        for v in value:
            yield from flat_lines(v)
    elif isinstance(value, str):
        yield value
        if "<" in value or "&" in value:
            yield html.unescape(re.sub("<[^>]*>", "", value))
    elif value is not None:
        yield json.dumps(value)


def texts(value: Any) -> Iterator[str]:
    """The strings named "text" anywhere, as rich-text documents hold them."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "text" and isinstance(v, str):
                yield v
            else:
                yield from texts(v)
    elif isinstance(value, list):
        for v in value:
            yield from texts(v)


def scalars(value: Any, skip: frozenset[str] = frozenset()) -> Iterator[str]:
    """All scalars but those under the names in `skip`."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in skip:
                yield from scalars(v, skip)
    elif isinstance(value, list):
        for v in value:
            yield from scalars(v, skip)
    elif value is not None:
        yield value if isinstance(value, str) else json.dumps(value)


def _each(walk) -> Any:
    @F.pandas_udf(StringType())
    def run(docs: pd.Series) -> pd.Series:
        def one(doc: str | None) -> str | None:
            if doc is None:
                return None
            try:
                return "\n".join(walk(json.loads(doc)))[:LIMIT]
            except ValueError:
                return doc

        return docs.map(one)

    return run


json_flatten = _each(flat_lines)
json_text = _each(lambda v: dict.fromkeys(texts(v)))
json_scalars = _each(lambda v: dict.fromkeys(scalars(v)))


def merge_json(existing: Column, more: Column) -> Column:
    """Two flat JSON objects of strings as one; the second wins, and what isn't JSON counts as empty."""
    of = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keys = F.array_union(F.map_keys(of(existing)), F.map_keys(of(more)))
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.element_at(of(more), k), F.element_at(of(existing), k)).alias("value")))
    return F.to_json(F.map_from_entries(pairs))
