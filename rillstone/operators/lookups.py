"""Operators that look values up in lists, maps and tables that come with the rules."""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.filters import as_text, java_pattern
from ..plans.frame import Effect, Frame, Write, yes
from ..plans.rules import Rule, RuleError, load_yaml
from ..sources.getters import expanded, get_lines, get_structured
from .base import effect, literal, operator, reject, source
from .fields import _listed

#: Entries up to which a map is a literal of the plan, and bytes up to which a larger one is broadcast to be joined.
LITERAL, BROADCAST = 200, 64 << 20
Lookups = list[tuple[str, Column, DataFrame]]


def text_of(frame: Frame, path: str) -> Column:
    kind = frame.kind(path)
    return source(frame, path) if kind is None else as_text(source(frame, path), kind)


def looked_up(entries: dict[str, Any], key: Column, lookups: Lookups) -> Column:
    """The entry of a key, null where there is none. Values of several kinds become text. A small map is part of the plan; a
    larger one becomes a table in ``lookups``, which events are joined with."""
    if not entries:
        return F.lit(None).cast("string")
    kinds = {type(v) for v in entries.values()}
    if kinds <= {str} or kinds <= {int} or kinds <= {float} or kinds <= {bool}:
        flat = entries
    elif kinds <= {list}:
        flat = {k: [x if isinstance(x, str) else json.dumps(x) for x in v] for k, v in entries.items()}
    else:
        flat = {k: v if isinstance(v, str) else json.dumps(v) for k, v in entries.items()}
    if len(flat) <= LITERAL:
        names, values = F.array(*(F.lit(k) for k in flat)), F.array(*(literal(v) for v in flat.values()))
        return F.try_element_at(F.map_from_arrays(names, values), key)
    return joined(list(flat), list(flat.values()), key, lookups)


def joined(keys: list, values: list, key: Column, lookups: Lookups) -> Column:
    """The value beside a key, by a join: a broadcast if the table is small enough, else as Spark sees fit."""
    table = pa.table({"k": pa.array(keys, None if keys else pa.int64()), "v": values})
    rows = SparkSession.active().createDataFrame(table)
    name = f"__lookup{len(lookups)}"
    lookups.append((name, key, F.broadcast(rows) if table.nbytes <= BROADCAST else rows))
    return F.col(name)


@operator("generic_resolver")
def generic_resolver(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Resolves texts by a map from a file, keyed by what a pattern captures, or else by the first pattern of a list that
    is found in the text."""
    mapping = rule.option("field_mapping")
    if not mapping:
        raise RuleError("a rule of generic_resolver needs a field_mapping")
    ordered = rule.option("resolve_list", {})
    items = list(ordered.items()) if isinstance(ordered, dict) else [kv for x in ordered for kv in x.items()]
    from_file, ignore_case = rule.option("resolve_from_file"), rule.option("ignore_case", False)
    result = effect(rule, frame, [], sources=list(mapping))
    for path, target in mapping.items():
        value, found = text_of(frame, path), []
        if from_file:
            spec = {"path": from_file, "pattern": r"(?P<mapping>.+)"} if isinstance(from_file, str) else from_file
            if "(?P<mapping>" not in spec["pattern"]:
                raise RuleError("the pattern of resolve_from_file must have a group 'mapping'")
            table = get_structured(spec["path"])
            if isinstance(table, list):
                table = {k: v for x in table for k, v in x.items()}
            group = len(re.findall(r"(?<!\\)\((?!\?)|\(\?P<", spec["pattern"].split("(?P<mapping>")[0])) + 1
            pattern = ("(?i)" if ignore_case else "") + java_pattern(f"^(?:{spec['pattern']})$")
            key = F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group))
            if ignore_case:
                table, key = {str(k).lower(): v for k, v in table.items()}, F.lower(key)
            found.append(looked_up({str(k): v for k, v in table.items()}, key, result.lookups))
        if items:
            same = len({type(v) for _, v in items}) == 1
            chain = None
            for pattern, v in items:
                test = value.rlike(("(?i)" if ignore_case else "") + java_pattern(pattern))
                own = literal(v) if same else F.lit(v if isinstance(v, str) else json.dumps(v))
                chain = F.when(test, own) if chain is None else chain.when(test, own)
            found.append(chain)
        if not found:
            raise RuleError("a rule of generic_resolver needs resolve_list or resolve_from_file")
        resolved = F.coalesce(*found) if len(found) > 1 else found[0]
        if rule.option("merge_with_target", False):
            current = _listed(frame, target, "string")
            resolved = F.when(resolved.isNotNull(), F.array_union(current, F.array(resolved.cast("string"))))
            result.writes.append(Write(target, resolved, "overwrite"))
        else:
            result.writes.append(Write(target, resolved, rule.mode))
    return result


@operator("template_replacer")
def template_replacer(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Replaces a field by the entry of a table for the values of several fields, joined by a delimiter."""
    spec = options.get("pattern") or rule.option("pattern")
    table = options.get("template") or rule.option("template")
    if not spec or not table:
        raise RuleError("template_replacer needs 'pattern' and 'template'")
    entries = load_yaml(table) if isinstance(table, str) else table
    delimiter, fields, target = spec["delimiter"], list(spec["fields"]), spec["target_field"]
    free = spec.get("allowed_delimiter_field")
    for key in entries:
        n = str(key).count(delimiter) + 1
        if n < len(fields) or n > len(fields) and free is None:
            raise RuleError(f"the key {key!r} has not as many parts as there are fields")
    key = F.concat_ws(delimiter, *(text_of(frame, f) for f in fields))
    whole = reduce(lambda a, b: a & b, [source(frame, f).isNotNull() for f in fields])
    lookups: Lookups = []
    found = F.when(whole, looked_up({str(k): v for k, v in entries.items()}, key, lookups))
    above = [p for n in range(1, target.count(".") + 1) if (p := target.rsplit(".", n)[0]) and frame.leaf(p)]
    result = effect(rule, frame, [(target, found)], sources=fields, miss=False, lookups=lookups)
    result.writes[0].mode = "overwrite" if not above else "add"
    return result


def members(rule: Rule, options: dict) -> dict[str, list[str]]:
    """The lists of a rule by name: from files and addresses, or given in the rule itself."""
    base = options.get("list_search_base_path") or rule.option("list_search_base_path", "")
    found: dict[str, list[str]] = {}
    for name in rule.option("list_file_paths", []):
        place = place_of(name, base)
        if not event_fields(place):
            found[Path(name).name] = get_lines(place, rule.option("content_field"))
    for name, values in rule.option("lists", {}).items():
        found[name] = list(values)
    if not found and not templates(rule, options):
        raise RuleError(f"a rule of {rule.kind} needs list_file_paths or lists")
    return found


def place_of(name: str, base: str) -> str:
    return expanded(name if "://" in name or Path(name).is_absolute() or not base else f"{str(base).rstrip('/')}/{name}")


def event_fields(place: str) -> list[str]:
    """The event fields that the place of a list is made of: names in ``${..}`` that no environment variable has."""
    return list(dict.fromkeys(re.findall(r"\$\{([^}]+)\}", place)))


def templates(rule: Rule, options: dict) -> dict[str, str]:
    """The lists of a rule, by name, whose places have fields of the event in them."""
    base = options.get("list_search_base_path") or rule.option("list_search_base_path", "")
    places = {Path(n).name: place_of(n, base) for n in rule.option("list_file_paths", [])}
    return {n: p for n, p in places.items() if event_fields(p)}


def templated(place: str, content_field: str | None, frame: Frame, value: Column) -> tuple[Column, Column]:
    """Whether any of the values is in the list at a place that differs by event, and whether that can't be told. Each
    worker reads a list when it first needs it and keeps it as long as answers from the web are kept."""
    names = event_fields(place)

    @F.pandas_udf("struct<inside:boolean,failed:boolean>")
    def look(batch: pd.DataFrame) -> pd.DataFrame:
        known: dict[str, frozenset | None] = {}

        def content(at: str) -> frozenset | None:
            if at not in known:
                try:
                    known[at] = frozenset(get_lines(at, content_field))
                except (OSError, ValueError, KeyError, TypeError):
                    known[at] = None
            return known[at]

        def one(fields: tuple, values) -> tuple:
            at = place
            for n, f in zip(names, fields):
                if f is None:
                    return False, True
                at = at.replace("${" + n + "}", f)
            members = content(at)
            return (False, True) if members is None else (values is not None and any(v in members for v in values), False)

        rows = batch.itertuples(index=False)
        return pd.DataFrame([one(tuple(r)[:-1], r[-1]) for r in rows], columns=["inside", "failed"])

    scalar = lambda n: text_of(frame, n) if isinstance(frame.kind(n), (T.StringType, T.IntegralType, T.BooleanType)) else F.lit(None).cast("string")
    answer = look(F.struct(*(scalar(n).alias(f"f{i}") for i, n in enumerate(names)), value.alias("values")))
    return answer["inside"], answer["failed"]


def report(rule: Rule, frame: Frame, tests: dict[str, Column]) -> list[Write]:
    """The names of the lists that hold a value below ``in_list``, or of all lists below ``not_in_list``."""
    inside = F.array_compact(F.array(*(F.when(yes(t), F.lit(n)) for n, t in tests.items())))
    every = F.array(*(F.lit(n) for n in tests))
    writes = []
    for key, value, some in (("in_list", inside, F.size(inside) > 0), ("not_in_list", every, F.size(inside) == 0)):
        path = f"{rule.target}.{key}"
        merged = F.array_union(_listed(frame, path, "string"), value) if frame.leaf(path) else value
        writes.append(Write(path, merged, "overwrite" if frame.leaf(path) or rule.mode == "overwrite" else "add", when=some))
    return writes


@operator("list_comparison")
def list_comparison(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Which of several lists hold the value of a field, or any element of it if it is a list. The place of a list may have fields of the event
    in it, as ``${field}``; an event without such a field, or whose list can't be read, gets a warning."""
    reject(rule, "source_fields", "target_field")
    path, lists = rule.sources[0], members(rule, options)
    value, kind = source(frame, path), frame.kind(path)

    result = effect(rule, frame, [], conflict_tags=rule.failure_tags)
    many = isinstance(kind, T.ArrayType)
    texts = isinstance(kind.elementType if many else kind, T.StringType)  # a number is no text

    def inside(names: list[str]) -> Column:
        if not texts:
            return F.lit(False)
        if len(names) <= LITERAL:
            return F.arrays_overlap(value, F.array(*(F.lit(n) for n in names)).cast("array<string>")) if many else value.isin(names)
        if many:
            held = SparkSession.active().sparkContext.broadcast(frozenset(names))
            return F.pandas_udf(lambda s: s.map(lambda xs: None if xs is None else any(x in held.value for x in xs)).astype("boolean"), "boolean")(value)
        distinct = list(dict.fromkeys(names))
        return joined(distinct, [True] * len(distinct), value, result.lookups).isNotNull()

    tests, bad = {n: inside(v) for n, v in lists.items()}, F.lit(False)
    for i, (name, place) in enumerate(templates(rule, options).items()):
        values = (value if many else F.array(value)) if texts else F.lit(None).cast("array<string>")
        found, failed = templated(place, rule.option("content_field"), frame, values)
        result.prepare.append({f"__listed{i}": F.struct(found.alias("inside"), failed.alias("failed"))})
        tests[name] = F.col(f"__listed{i}")["inside"]
        bad = bad | F.col(f"__listed{i}")["failed"]
    result.writes = report(rule, frame, tests)
    if result.prepare:
        result.together = ~bad
        result.warn.append((bad, rule.failure_tags))
    return result


def keyed_list_comparison(df, lists, key: str, value: str, target: str = "in_list"):
    """Adds whether (key, value) of each event is among the rows (key, value) of a table of lists: for lists that differ
    by event. A semi-join on both columns; Spark broadcasts the table if it is small."""
    marks = lists.select(F.col(key).alias("__k"), F.col(value).alias("__v")).distinct().withColumn("__in", F.lit(True))
    joined = df.join(marks, (df[key] == marks["__k"]) & (df[value] == marks["__v"]), "left")
    return joined.withColumn(target, F.coalesce("__in", F.lit(False))).drop("__k", "__v", "__in")
