"""Operators on times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timeformats
from ..plans.filters import as_text
from ..plans.frame import Effect, Frame, Write
from ..plans.rules import Rule, RuleError
from .base import effect, operator, reject, source


def _text(frame: Frame, path: str) -> Column:
    kind = frame.kind(path)
    if isinstance(kind, T.TimestampType):
        return timeformats.shown(source(frame, path), "UTC")
    return source(frame, path) if kind is None else as_text(source(frame, path), kind)


@operator("timestamper")
def timestamper(rule: Rule, frame: Frame, options: dict) -> Effect:
    """The first of several formats that fits gives a time, written as ISO 8601 in the target time zone."""
    reject(rule, "source_fields")
    value = _text(frame, rule.sources[0])
    formats = rule.option("source_format", ["ISO8601"])
    zone, to = rule.option("source_timezone", "UTC"), rule.option("target_timezone", "UTC")
    found = F.coalesce(*(timeformats.parsed(value, f, zone) for f in ([formats] if isinstance(formats, str) else formats)))
    moment, target = F.col("__moment"), rule.target or "@timestamp"
    result = effect(rule, frame, [(target, timeformats.shown(moment, to))], warn=[(value.isNotNull() & moment.isNull(), rule.failure_tags)], prepare=[{"__moment": found}])
    if target == rule.sources[0] or target == "@timestamp" and "overwrite_target" not in rule.options:
        result.writes[0].mode = "overwrite"
    return result


@operator("timestamp_differ")
def timestamp_differ(rule: Rule, frame: Frame, options: dict) -> Effect:
    """``${a:format} - ${b:format}`` as text of a number of seconds, milli- or nanoseconds."""
    reject(rule, "diff", "target_field")
    found = re.findall(r"\$\{([^}:]+)(?::([^}]+))?\}", rule.options["diff"])
    if len(found) != 2 or not re.search(r"\}\s*-\s*\$\{", rule.options["diff"]):
        raise RuleError("the difference of a rule of timestamp_differ must have the form ${a:format} - ${b:format}")
    unit = rule.option("output_format", "seconds")
    per = {"seconds": 1e6, "milliseconds": 1e3, "nanoseconds": 1e-3}.get(unit)
    if per is None:
        raise RuleError(f"there is no unit {unit!r}")
    moments, bad = [], F.lit(False)
    result = effect(rule, frame, [], sources=[p for p, _ in found])
    for i, (path, form) in enumerate(found):
        kind = frame.kind(path)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            result.fail.append((source(frame, path).isNotNull(), f"{path} is no text"))
        whole = isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
        value = _text(frame, path)
        moment = F.col(f"__moment{i}")
        result.prepare = [{**(result.prepare[0] if result.prepare else {}), f"__moment{i}": timeformats.parsed(value, "UNIX" if whole else form or "ISO8601", "UTC")}]
        bad = bad | (value.isNotNull() & moment.isNull())
        moments.append(moment)
    span = (F.unix_micros(moments[0]) - F.unix_micros(moments[1])).cast("double") / per
    shown = as_text(span, T.DoubleType())
    if rule.option("show_unit", False):
        shown = F.concat(shown, F.lit({"seconds": " s", "milliseconds": " ms", "nanoseconds": " ns"}[unit]))
    result.writes.append(Write(rule.target, shown, rule.mode))
    result.warn.append((bad, rule.failure_tags))
    return result


@operator("datetime_extractor")
def datetime_extractor(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Parts of an ISO time: year to microsecond, weekday and time zone. A time that can't be read stops the event."""
    reject(rule, "source_fields", "target_field")
    path = rule.sources[0]
    value = _text(frame, path)
    offset = F.regexp_extract(value, r"([+-]\d\d):?(\d\d)?$", 0)
    first = {"__moment": timeformats.iso(value, "UTC"), "__digits": F.regexp_replace(offset, ":", ""), "__has": value.rlike(r"\d\d:\d\d.*[+-]\d\d(:?\d\d)?$")}
    moment, digits, has = (F.col(n) for n in first)
    zone = F.when(has & ~digits.isin("+0000", "+00", "-0000"), F.concat(F.lit("UTC"), F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0"))).otherwise(F.lit("UTC"))
    shift = F.when(has, (F.concat(F.substring(digits, 1, 1), F.lit("1")).try_cast("int")) * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).try_cast("int"), F.lit(0)))).otherwise(F.lit(0))
    second = {"__local": F.timestamp_micros(F.unix_micros(moment) + F.coalesce(shift, F.lit(0)).cast("long") * 60000000)}
    local = F.col("__local")
    parts = {"year": F.year(local), "month": F.month(local), "day": F.dayofmonth(local), "hour": F.hour(local), "minute": F.minute(local), "second": F.second(local)}
    found = {k: v.cast("long") for k, v in parts.items()} | {"microsecond": F.pmod(F.unix_micros(local), F.lit(1000000)), "weekday": F.date_format(local, "EEEE"), "timezone": zone}
    result = Effect(conflict_tags=rule.failure_tags, fail=[(moment.isNull(), f"{path} is no ISO time")], prepare=[first, second])
    result.writes = [Write(f"{rule.target}.{k}", F.when(moment.isNotNull(), v), rule.mode) for k, v in found.items()]
    if rule.option("delete_source_fields", False):
        result.remove = [path]
    return result
