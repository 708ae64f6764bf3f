"""What an access list lets an identity do, and how widely it opens an item."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rights that read, write and modify; groups by how wide they are.
READ, WRITE, MODIFY = ("read", "readdata", "listdirectory", "readandexecute", "fullcontrol", "modify", "genericread"), ("write", "writedata", "createfiles", "appenddata", "fullcontrol", "modify", "genericwrite"), ("modify", "delete", "changepermissions", "takeownership", "fullcontrol", "genericall")
EVERYONE, DOMAIN_USERS, AUTHENTICATED = ("everyone",), ("domain users",), ("authenticated users", "users")
CLOUD = ("Public", "External", "Unknown", "Organization", "Restricted")


def access(acl: DataFrame, identities: Iterable[str]) -> DataFrame:
    """(path, access) from (path, identity, permissions, type): R, W and M, each if it is allowed and not denied to one of
    the identities."""
    names = [i.lower() for i in identities]
    mine = acl.filter(F.lower("identity").isin(*names))
    rights = F.transform(F.split(F.lower("permissions"), ","), lambda p: F.trim(p))
    given = lambda some, kind: F.bool_or((F.lower("type") == kind) & F.arrays_overlap(rights, F.array(*map(F.lit, some))))
    letter = lambda some, c: F.when(given(some, "allow") & ~given(some, "deny"), c).otherwise("")
    return mine.groupBy("path").agg(F.concat(letter(READ, "R"), letter(WRITE, "W"), letter(MODIFY, "M")).alias("access"))


def exposure(acl: DataFrame) -> DataFrame:
    """(path, exposure): the widest group that an item is open to."""
    group = F.lower(F.element_at(F.split("identity", r"\\"), -1))
    open_to = lambda some: F.bool_or((F.lower("type") == "allow") & group.isin(*some))
    found = F.when(open_to(EVERYONE), "Everyone").when(open_to(DOMAIN_USERS), "Domain Users").when(open_to(AUTHENTICATED), "Authenticated Users").otherwise("Restricted")
    return acl.groupBy("path").agg(found.alias("exposure"))


def cloud_exposure(links: DataFrame) -> DataFrame:
    """(path, exposure) from sharing scopes (path, scope): the widest of them."""
    worst = F.when(F.lit(False), "")
    for scope in CLOUD[:-1]:
        worst = worst.when(F.bool_or(F.lower("scope") == scope.lower()), scope)
    return links.groupBy("path").agg(worst.otherwise("Restricted").alias("exposure"))
