"""Operators on addresses and domains."""

from __future__ import annotations

import io
import ipaddress

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import addresses, domains
from ..plans.frame import Effect, Frame, Write, yes
from ..plans.rules import Rule, RuleError
from ..sources.getters import get_raw
from .base import effect, operator, reject, source
from .fields import _listed
from .lookups import joined, members, report


def _address(column: Column, kind: T.DataType) -> Column:
    """Integers are read as numbers of version 4."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = column.cast("long")
        return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *(F.pmod(F.floor(n / 256**k), F.lit(256)).cast("string") for k in (3, 2, 1, 0))))
    return column.cast("string")


@operator("network_comparison")
def network_comparison(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Which of several lists of networks hold an address, or any of a list of addresses; invalid ones give a warning."""
    reject(rule, "source_fields", "target_field")
    path, lists = rule.sources[0], members(rule, options)
    value, kind = source(frame, path), frame.kind(path)
    result = effect(rule, frame, [], conflict_tags=rule.failure_tags)
    if isinstance(kind, T.ArrayType):
        result.prepare = [{"__inside": addresses.any_inside(value.cast("array<string>"), lists)}]
        tests = {name: F.get(F.col("__inside")["inside"], F.lit(i)) for i, name in enumerate(lists)}
        valid = F.col("__inside")["valid"]
    else:
        result.prepare = addresses.steps(_address(value, kind) if kind is not None else value, "__ip")
        four, six = F.col("__ip4"), F.col("__ip6")
        tests = {name: addresses.inside(four, six, nets) for name, nets in lists.items()}
        valid = four.isNotNull() | six.isNotNull()
    result.writes = report(rule, frame, tests)
    for w in result.writes:
        w.when = w.when & yes(valid)
    result.warn.append((value.isNotNull() & ~yes(valid), rule.failure_tags))
    return result


@operator("ip_informer")
def ip_informer(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Properties of addresses, as a map from address to a struct; invalid ones give a warning and are left out."""
    reject(rule, "source_fields", "target_field")
    every = [*addresses.TEXTS, *addresses.FLAGS, *addresses.NUMBERS]
    wanted = rule.option("properties", every)
    if unknown := set(wanted) - set(every):
        raise RuleError(f"addresses have no properties {sorted(unknown)}")
    values = F.concat(*(_listed(frame, s, "string") for s in rule.sources))
    found = addresses.properties(values, list(wanted))
    result = effect(rule, frame, [(rule.target, F.when(F.size(found) > 0, found))])
    result.warn.append((F.size(F.array_distinct(values)) > F.size(found), rule.failure_tags))
    return result


@operator("domain_label_extractor")
def domain_label_extractor(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Registered domain, suffix and subdomain of a host or URL; addresses and unknown suffixes give a tag."""
    reject(rule, "source_fields", "target_field")
    path = rule.sources[0]
    value = source(frame, path).cast("string")
    name, parts = F.col("__host"), F.col("__labels")
    address = addresses.number(name).isNotNull() | name.rlike(r"^\[?[0-9a-f:]*:[0-9a-f:.]*\]?$")
    result = effect(rule, frame, [], sources=[path], prepare=[{"__host": domains.host(value)}, {"__labels": domains.labels(name, domains.read_suffixes(options.get("suffix_list")))}])
    for key in ("registered_domain", "top_level_domain", "subdomain"):
        result.writes.append(Write(f"{rule.target}.{key}", F.when(~yes(address), parts[key]), rule.mode))
    leaf = path.replace(".", "_")
    result.warn += [(yes(address), [f"ip_in_{leaf}"]), (value.isNotNull() & ~yes(address) & parts.isNull(), [f"invalid_domain_in_{leaf}"])]
    return result


GEO = {"type": "geoip.type", "geometry.type": "geoip.geometry.type", "geometry.coordinates": "geoip.geometry.coordinates", "properties.accuracy_radius": "geoip.properties.accuracy_radius", "properties.continent": "geoip.properties.continent", "properties.continent_code": "geoip.properties.continent_code", "properties.country": "geoip.properties.country", "properties.country_iso_code": "geoip.properties.country_iso_code", "properties.time_zone": "geoip.properties.time_zone", "properties.city": "geoip.properties.city", "properties.postal_code": "geoip.properties.postal_code", "properties.subdivision": "geoip.properties.subdivision"}


@operator("geoip_enricher")
def geoip_enricher(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Place of an address from a table of ranges, given as rows with ``start``, ``end`` (addresses of version 4 or 6) and
    any of the subfields. Ranges must not overlap. Unknown addresses are left alone.

    The range is found by halving, its number is joined with the table of places."""
    reject(rule, "source_fields")
    table = options.get("ranges") or options.get("db_path") or []
    if isinstance(table, str):
        table = pd.read_csv(io.StringIO(get_raw(table)), dtype=str).where(lambda d: d.notna(), None).to_dict("records")
    rows = sorted(((addresses.key_of(ipaddress.ip_address(r["start"])), addresses.key_of(ipaddress.ip_address(r["end"])), r) for r in table), key=lambda r: r[:2])
    if any(a[1] >= b[0] for a, b in zip(rows, rows[1:])):
        raise RuleError("the ranges of geoip_enricher overlap")
    names = [k.split(".", 1)[1] for k in GEO if k.startswith("properties.")]
    spot = lambda r: [float(r["longitude"]), float(r["latitude"])] if r.get("longitude") and r.get("latitude") and float(r["longitude"]) and float(r["latitude"]) else None
    places = [{n: None if r.get(n) is None else str(r[n]) for n in names} | {"spot": spot(r)} for _, _, r in rows]
    kind = pa.struct([*((n, pa.string()) for n in names), ("spot", pa.list_(pa.float64()))])
    value = source(frame, rule.sources[0])
    steps = addresses.steps(_address(value, frame.kind(rule.sources[0])) if frame.kind(rule.sources[0]) is not None else value, "__ip")
    at = addresses.located(addresses.key(F.col("__ip4"), F.col("__ip6")), [r[:2] for r in rows])
    base, rename = rule.target or "geoip", rule.option("customize_target_subfields", {})
    result = effect(rule, frame, [], prepare=[*steps, {"__range": at}])
    place = joined(list(range(len(places))), pa.array(places, kind), F.col("__range"), result.lookups)
    values = {"type": F.when(place.isNotNull(), F.lit("Feature")), "geometry.type": F.when(place["spot"].isNotNull(), F.lit("Point")), "geometry.coordinates": place["spot"]}
    values |= {f"properties.{n}": place[n] for n in names}
    values["properties.accuracy_radius"] = place["accuracy_radius"].try_cast("long")
    result.writes += [Write(rename.get(k, f"{base}.{k}"), v, rule.mode) for k, v in values.items()]
    return result
