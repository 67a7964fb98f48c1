"""IP addresses: numbers and networks of version 4 in columns, all else by the standard library in Arrow batches."""

import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$"
FLAGS = ["is_global", "is_link_local", "is_loopback", "is_multicast", "is_private", "is_reserved", "is_unspecified", "is_site_local"]
TEXTS = ["compressed", "exploded", "reverse_pointer", "ipv4_mapped", "sixtofour", "teredo", "scope_id"]
NUMBERS = ["version", "max_prefixlen"]


def number(value: Column) -> Column:
    """A dotted address as a number, null for other texts."""
    parts = F.split(value, "[.]")
    total = F.lit(0).cast("long")
    for i in range(4):
        total = total * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(value.rlike(_V4), total)


def steps(value: Column, name: str) -> list[dict[str, Column]]:
    """Columns to be made one after the other: ``<name>4``, an address of version 4 as a number, and ``<name>6``, one of
    version 6 as 32 digits, which sort as the addresses do. Each is null for other texts."""
    col = lambda part: F.col(f"`{name}{part}`")
    dotted = F.regexp_extract(value, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    pair = F.concat(F.lower(F.hex(F.floor(col("t") / 65536).cast("long"))), F.lit(":"), F.lower(F.hex(F.pmod(col("t"), F.lit(65536)))))
    plain = F.when(col("t").isNull(), col("p")).otherwise(F.concat(F.regexp_replace(col("p"), r"\d+\.\d+\.\d+\.\d+$", ""), pair))
    groups = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
    missing = F.lit(8) - F.size(col("l")) - F.size(col("r"))
    fits = (F.size(col("e")) == 2) & (missing >= 1) | (F.size(col("e")) == 1) & (missing == 0)
    digits = F.array_join(F.transform(F.concat(col("l"), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), col("r")), lambda g: F.lpad(g, 4, "0")), "")
    return [
        {f"{name}4": number(value), f"{name}p": F.regexp_replace(F.lower(value), "%.*$", ""), f"{name}t": number(dotted)},
        {f"{name}e": F.when(F.contains(col("p"), F.lit(":")), F.split(plain, "::", -1))},
        {f"{name}l": groups(F.get(col("e"), F.lit(0))), f"{name}r": groups(F.get(col("e"), F.lit(1)))},
        {f"{name}6": F.when(F.coalesce(fits & F.forall(F.concat(col("l"), col("r")), lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.lit(False)), digits)},
    ]


#: Ranges up to which a test is an expression; more are searched by halving, in Arrow batches.
RANGES = 200


def key(four: Column, six: Column) -> Column:
    """An address as text that sorts as addresses do, those of version 4 first."""
    return F.when(four.isNotNull(), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(four)), 8, "0"))).when(six.isNotNull(), F.concat(F.lit("6"), six))


def key_of(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    return f"4{int(address):08x}" if address.version == 4 else f"6{int(address):032x}"


def located(keys: Column, ranges: list[tuple[str, str]]) -> Column:
    """The number of the range, of sorted ones that don't overlap, that a key lies in; null if in none."""
    first, last = (np.array([r[i] for r in ranges], "S33") for i in (0, 1))
    shared = SparkSession.active().sparkContext.broadcast((first, last))  # rules' tables are read on the driver, and no larger than what it holds

    @F.pandas_udf("long")
    def look(batch: pd.Series) -> pd.Series:
        first, last = shared.value
        asked = batch.fillna("").to_numpy().astype("S33")
        at = np.searchsorted(first, asked, "right") - 1
        good = (at >= 0) & (asked <= last[np.maximum(at, 0)]) if len(first) else np.zeros(len(asked), bool)
        return pd.Series(np.where(good, at, 0)).astype("Int64").where(good)

    return look(keys)


def merged(networks: list[str]) -> list[tuple[str, str]]:
    """Networks as sorted ranges of keys that don't overlap."""
    nets = [ipaddress.ip_network(n.strip(), strict=False) for n in networks]
    flat = [n for v in (4, 6) for n in ipaddress.collapse_addresses([x for x in nets if x.version == v])]
    return sorted((key_of(n.network_address), key_of(n.broadcast_address)) for n in flat)


def inside(four: Column, six: Column, networks: list[str]) -> Column:
    """Whether an address lies in any of the networks."""
    nets = [ipaddress.ip_network(n.strip(), strict=False) for n in networks]
    if len(nets) > RANGES:
        return located(key(four, six), merged(networks)).isNotNull()
    test = F.lit(False)
    for n in ipaddress.collapse_addresses([x for x in nets if x.version == 4]):
        test = test | F.coalesce(four.between(int(n.network_address), int(n.broadcast_address)), F.lit(False))
    for n in ipaddress.collapse_addresses([x for x in nets if x.version == 6]):
        test = test | F.coalesce(six.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}"), F.lit(False))
    return test


def any_inside(values: Column, lists: dict[str, list[str]]) -> Column:
    """Of a list of addresses: whether all are valid, and for each list of networks, by position, whether any is in it."""
    bounds = [tuple(np.array([r[i] for r in merged(nets)], "S33") for i in (0, 1)) for nets in lists.values()]

    @F.pandas_udf("struct<valid:boolean,inside:array<boolean>>")
    def look(batch: pd.Series) -> pd.DataFrame:
        size = np.array([0 if v is None else len(v) for v in batch])
        row, texts = np.repeat(np.arange(len(batch)), size), [x for v in batch if v is not None for x in v]
        codes, different = pd.factorize(np.array(texts, object)) if texts else (np.zeros(0, np.int64), [])
        keys = []
        for x in different:
            try:
                keys.append(key_of(ipaddress.ip_address(x)))
            except ValueError:
                keys.append("")
        keys = np.array([*keys, ""], "S33")[codes]
        bad = np.zeros(len(batch), bool)
        bad[row[keys == b""]] = True
        found = np.zeros((len(batch), len(bounds)), bool)
        for i, (first, last) in enumerate(bounds):
            if len(first):
                at = np.searchsorted(first, keys, "right") - 1
                found[row[(at >= 0) & (keys <= last[np.maximum(at, 0)])], i] = True
        return pd.DataFrame({"valid": ~bad, "inside": list(found)})

    return look(values)


def properties(values: Column, wanted: list[str]) -> Column:
    """A map from each valid address of a list to a struct of its properties; flags that it doesn't have are false."""
    fields = [(n, "boolean" if n in FLAGS else "long" if n in NUMBERS else "string") for n in wanted]
    kind = f"map<string,struct<{','.join(f'`{n}`:{k}' for n, k in fields)}>>"

    @F.pandas_udf(kind)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, dict | None] = {}

        def one(v: str) -> dict | None:
            if v not in known:
                if len(known) > 1 << 16:
                    known.clear()
                try:
                    a = ipaddress.ip_address(v)
                    known[v] = {n: (bool(x) if k == "boolean" else x if k == "long" else None if x is None else str(x)) for n, k in fields for x in [getattr(a, n, False if k == "boolean" else None)]}
                except ValueError:
                    known[v] = None
            return known[v]

        for batch in batches:
            yield pd.Series([None if vs is None else {v: p for v in dict.fromkeys(vs) if v is not None and (p := one(v)) is not None} for vs in batch], dtype=object)

    return look(values)
