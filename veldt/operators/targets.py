"""Target lists: hosts, addresses and networks to one expanded list. Ranges merge before they expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a line, targets of a list before they expand, addresses that it may expand to.
MAX_LINE, MAX_TARGETS, MAX_ADDRESSES = 4096, 65_536, 1 << 24
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def strip_comment(line: Column) -> Column:
    """Without what follows #, ; or // at the start or after white space, outside double quotes; quotes removed, trimmed."""
    cut = F.regexp_extract(line, r'^((?:"[^"]*"|(?!(?:(?<=\s)|(?<![\s\S]))(?:#|;|//))[^"])*)', 1)
    return F.trim(F.regexp_replace(cut, '"', ""))


def ip_number(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))


def ip_text(number: Column) -> Column:
    part = lambda k: (F.floor(number / (256**k)) % 256).cast("long").cast("string")
    return F.concat_ws(".", part(3), part(2), part(1), part(0))


def _v6_hosts(target: Column) -> Column:
    """Of an IPv6 network whose last group alone varies, its addresses; of anything else, itself."""
    pattern = r"^([0-9A-Fa-f:]*:)([0-9A-Fa-f]{0,4})/(12[0-8])$"
    bits = F.regexp_extract(target, pattern, 3).cast("int")
    size = F.call_function("shiftleft", F.lit(1), 128 - bits)
    last = F.conv(F.coalesce(F.nullif(F.regexp_extract(target, pattern, 2), F.lit("")), F.lit("0")), 16, 10).cast("int")
    low = last - last % size
    each = F.transform(F.sequence(low, low + size - 1), lambda k: F.concat(F.regexp_extract(target, pattern, 1), F.lower(F.hex(k))))
    return F.when(target.rlike(pattern), each).otherwise(F.array(target))


def parse(lines: DataFrame) -> DataFrame:
    """(line_no, target, kind, start, end) of lines (line_no, line): kind is range, host or error. Networks wider than /31 lose
    their network and broadcast addresses. IPv6 addresses stay as hosts, and so do the addresses of IPv6 networks of at most 256
    of them (/120 and narrower); wider ones are errors."""
    target = F.explode(F.split(strip_comment(F.col("line")), r"[\s,]+"))
    rows = lines.select("line_no", F.length("line").alias("n"), target.alias("target")).filter("target <> ''")
    bits = F.regexp_extract("target", r"/([0-9]{1,2})$", 1).cast("int")
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - bits)
    base = ip_number(F.regexp_extract("target", rf"^({IPV4})", 1))
    low = base - base % size
    wide = bits < 31
    is_ip, is_net = F.col("target").rlike(f"^{IPV4}$"), F.col("target").rlike(f"^{IPV4}/(?:[0-9]|[12][0-9]|3[0-2])$")
    host = F.col("target").rlike(r"^(?=.{1,253}$)(?!-)[A-Za-z0-9_\p{L}](?:[A-Za-z0-9_\p{L}-]{0,62})(?:\.[A-Za-z0-9_\p{L}-]{1,63})*\.?$") & ~F.col("target").rlike(r"^[0-9.]+$")
    v6 = F.col("target").rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$")
    rows = rows.withColumn("target", F.explode(_v6_hosts(F.col("target"))))
    kind = F.when(F.col("n") > MAX_LINE, "error").when(is_ip | is_net, "range").when(host | v6, "host").otherwise("error")
    start = F.when(is_net, low + F.when(wide, 1).otherwise(0)).when(is_ip, ip_number(F.col("target")))
    end = F.when(is_net, low + size - 1 - F.when(wide, 1).otherwise(0)).when(is_ip, ip_number(F.col("target")))
    return rows.select("line_no", "target", kind.alias("kind"), start.alias("start"), end.alias("end"))


def merge(ranges: DataFrame) -> DataFrame:
    """Ranges (start, end) as the fewest that cover the same numbers: those that overlap or touch join. One ordered window over
    all is enough for at most MAX_TARGETS of them; more are an error."""
    if ranges.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    order = Window.orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce(upto, F.lit(-2)) + 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("island", island).groupBy("island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end")


def expand(parsed: DataFrame) -> DataFrame:
    """The targets: addresses of the merged ranges, then hosts once each whatever their case. More than MAX_ADDRESSES are an
    error."""
    numbers = merge(parsed.filter("kind = 'range'").select("start", "end"))
    if (numbers.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0] or 0) > MAX_ADDRESSES:
        raise ValueError(f"more than {MAX_ADDRESSES} addresses")
    numbers = numbers.select(F.explode(F.sequence("start", "end")).alias("n"))
    hosts = parsed.filter("kind = 'host'").groupBy(F.lower("target").alias("key")).agg(F.min_by("target", "line_no").alias("target"))
    return numbers.select(ip_text(F.col("n")).alias("target")).unionByName(hosts.select("target"))
