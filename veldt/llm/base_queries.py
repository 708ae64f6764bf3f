"""Registered queries over the columns of the corpus operators that are counted, not learned, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import Stage, table
from veldt.llm.lm_score import op3_lm_score
from veldt.llm.mixing import plan
from veldt.llm.pii import op5_pii
from veldt.llm.quality_rules import op1_quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '{_WORD}') as w from d),
g as (select r, i, array_to_string(w[i:i + 4], ' ') as g from w, unnest(range(1, len(w) - 3)) u(i)),
c as (select distinct r, h from (select r, i from g qualify count(*) over (partition by r, g) > 1) t, unnest(range(i, i + 5)) u(h)),
n as (select r, count(*) as n from c group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
f as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from d join w using (r) join l using (r) left join n using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f
"""


def base_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_lm_score(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: A checksum as SQL has it: eight steps for each character, all in lists.
_CRC = "xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)), lambda s, b: list_reduce(list_concat([xor(s, b)], list_transform(range(8), lambda k: k::ubigint)), lambda x, k: xor(x // 2, 3988292384::ubigint * (x % 2)))), 4294967295::ubigint)"
LM_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce({_CRC} % 5 = 1, false) as held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), [chr(10)]) as w from documents),
t as (select r, held_out, unnest(w) as t from d),
c as (select t, count(*) as c from t where not held_out group by t),
n as (select sum(c)::bigint as n, count(*) as v from c),
s as (select r, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) as base_score from t left join c using (t), n group by r)
select doc_id, held_out, n_tokens::bigint as n_tokens, n_known::bigint as n_known, n as train_tokens, round(base_score, 4) as base_score from d join s using (r), n
"""


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(length(d)), lambda i: case when i % 2 = 0 then substr(d, length(d) - i, 1)::int else (substr(d, length(d) - i, 1)::int * 2) // 10 + (substr(d, length(d) - i, 1)::int * 2) % 10 end)) % 10 = 0"
PII_SQL = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
card as (select r, {_DIGITS} as d from (select r, unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) as v from t) x),
cards as (select r, count(*) as n from card where length(d) between 16 and 19 and {_LUHN} group by r)
select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::bigint as n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 and coalesce(try_cast(p as int) <= 255, false)))))::bigint as n_ip,
  coalesce(n, 0)::bigint as n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda v: length({_DIGITS}) between 8 and 15))::bigint as n_phone
from t left join cards using (r)
"""


def base_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, aims = plan(table(spark, sf_dir, "documents"), Stage(spark, "base-mixing"))
    return aims.select("source", "source_size", F.round("target", 4).alias("target"))


#: The level at which the targets fill up is the one for which they come to the budget; it lies between two sources' limits.
MIXING_SQL = rf"""
with s as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::bigint as size from documents group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight from s),
b as (select 1.5 * sum(size) as budget from w),
levels as (select a.source, (b.budget - coalesce(sum(2 * o.size) filter (where 2.0 * o.size / o.weight < 2.0 * a.size / a.weight), 0)) / sum(o.weight) filter (where 2.0 * o.size / o.weight >= 2.0 * a.size / a.weight) as level, 2.0 * a.size / a.weight as own from w a, w o, b group by a.source, a.size, a.weight, b.budget),
water as (select min(own) as upto, arg_min(level, own) as level from levels where level < own)
select source, size as source_size, round(least(2.0 * size, coalesce(weight * level, 2.0 * size)), 4) as target from w, water
"""

BASE_QUERIES = {f.__name__: f for f in (base_quality, base_lm, base_pii, base_mixing)}
BASE_ORACLES = {"base_quality": QUALITY_SQL, "base_lm": LM_SQL, "base_pii": PII_SQL, "base_mixing": MIXING_SQL}
