"""Hosts and their registered domains by a list of public suffixes."""

from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes known without a list; a full one is given as a file of lines.
SUFFIXES = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "de", "at", "ch", "fr", "es", "it", "nl", "be", "eu", "uk", "co.uk", "ac.uk", "org.uk", "gov.uk", "us", "ca", "au", "com.au", "jp", "co.jp", "ac.jp", "br", "com.br", "cn", "com.cn", "in", "co.in", "ru", "pl", "se", "no", "fi", "dk", "cz", "example", "test")


def read_suffixes(path: str | None) -> list[str]:
    if path is None:
        return list(SUFFIXES)
    lines = (x.strip() for x in Path(path.removeprefix("file://")).read_text(encoding="utf-8").splitlines())
    return [x for x in lines if x and not x.startswith(("//", "#"))]


def host(value: Column) -> Column:
    """Host of a URL with or without scheme, lower case, without user, port and path."""
    rest = F.regexp_replace(F.trim(value), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    rest = F.regexp_replace(rest, r"^[^@]*@", "")
    return F.lower(F.regexp_replace(rest, r":\d*$", ""))


def labels(name: Column, suffixes: list[str]) -> Column:
    """struct(registered_domain, top_level_domain, subdomain), null where no suffix is known. The longest one counts; the
    first label never belongs to it."""
    parts = F.split(name, "[.]")
    known = {}
    for s in suffixes:
        known.setdefault(s.count(".") + 1, []).append(s)
    chosen = None
    for n in sorted(known, reverse=True):
        tail = F.array_join(F.slice(parts, -n, n), ".")
        test = (F.size(parts) > n) & tail.isin(known[n])
        size = F.lit(n)
        chosen = F.when(test, size) if chosen is None else chosen.when(test, size)
    take = lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")
    found = F.struct(take(chosen + 1).alias("registered_domain"), take(chosen).alias("top_level_domain"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - chosen - 1), ".").alias("subdomain"))
    return F.when(chosen.isNotNull() & name.rlike(r"^[^.]+(\.[^.]+)+$"), found)
