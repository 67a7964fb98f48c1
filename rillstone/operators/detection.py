"""Operators that send records to side outputs: detections, extracts and pseudonyms."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from pathlib import Path
from urllib.parse import parse_qs, urlencode, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import addresses, sealing, timeformats
from ..plans.filters import java_pattern
from ..plans.frame import Effect, Frame, Write, yes
from ..plans.rules import Rule, RuleError, load_yaml
from ..sources.getters import get_raw
from .base import operator, source
from .lookups import text_of


def records(outputs: list[dict[str, str]], doc: Column) -> Column:
    """One side record for each ``{output: target}``."""
    return F.array(*(F.struct(F.lit(o).alias("output"), F.lit(t).alias("target"), doc.alias("doc")) for x in outputs for o, t in x.items()))


def part(frame: Frame, fields: list[str]) -> dict:
    """The given fields as a tree of columns."""
    tree: dict = {}
    for f in fields:
        column, at = source(frame, f), tree
        *above, last = f.split(".")
        for p in above:
            at = at.setdefault(p, {})
        at[last] = column
    return tree


def as_struct(tree: dict) -> Column:
    return F.struct(*((as_struct(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()))


@operator("selective_extractor")
def selective_extractor(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Sends a part of the event to side outputs; the event stays as it is. Nulls are left out of the record."""
    outputs = rule.option("outputs")
    fields = list(rule.sources)
    if listed := rule.option("extract_from_file"):
        fields += [x.strip() for x in Path(listed.removeprefix("file://")).read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]
    if not outputs or not fields:
        raise RuleError("a rule of selective_extractor needs outputs and source_fields or extract_from_file")
    fields = list(dict.fromkeys(fields))
    some, every = F.lit(False), F.lit(True)
    for f in fields:
        there = source(frame, f).isNotNull()
        some, every = some | there, every & there
    ignore = rule.options.get("ignore_missing_fields", True)
    taken = some if ignore else every
    doc = F.to_json(as_struct(part(frame, fields)))
    return Effect(extra=F.when(taken, records(outputs, doc)).otherwise(F.array().cast("array<struct<output:string,target:string,doc:string>>")), warn=[] if ignore else [(~every, rule.missing_tags)])


@operator("pre_detector")
def pre_detector(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Sends a detection to side outputs and marks the event with its ``pre_detection_id``. An event that has one keeps it.

    With ``deterministic_id`` the id is a hash of the event; otherwise it is random.
    """
    o = rule.options
    for name in ("id", "title"):
        if not o.get(name) and not (name == "id" and rule.id):
            raise RuleError(f"a rule of pre_detector needs {name!r}")
    known = source(frame, "pre_detection_id")
    if options.get("deterministic_id"):
        own = F.sha2(F.to_json(F.struct(*(source(frame, p).alias(p) for p in frame.kinds if p not in ("pre_detection_id", "tags")))), 256)
    else:
        own = F.uuid()
    result = Effect(writes=[Write("pre_detection_id", own, "add", when=known.isNull())], conflict_tags=rule.failure_tags)
    if frame.leaf("pre_detection_id") is None:
        # the id must stand before the record can name it: a projection of its own
        frame = frame.select({"pre_detection_id": own})
    event_id = F.coalesce(source(frame, "pre_detection_id").cast("string"), own)
    fields: dict = {"id": F.lit(rule.id), "title": F.lit(o.get("title")), "severity": F.lit(o.get("severity", "")), "mitre": F.array(*(F.lit(m) for m in o.get("mitre", []))).cast("array<string>"), "case_condition": F.lit(o.get("case_condition", "")), "description": F.lit(rule.description), "rule_filter": F.lit(rule.filter_text)}
    if o.get("link"):
        fields["link"] = F.lit(o["link"])
    fields |= {"pre_detection_id": event_id, "creation_timestamp": timeformats.shown(F.current_timestamp(), "UTC")}
    if options.get("deterministic_id"):
        del fields["creation_timestamp"]
    if frame.look("@timestamp") is not None:
        raw = text_of(frame, "@timestamp")
        formats = rule.option("source_format", ["ISO8601"])
        moment = F.coalesce(*(timeformats.parsed(raw, f, rule.option("source_timezone", "UTC")) for f in ([formats] if isinstance(formats, str) else formats)))
        fields["@timestamp"] = F.coalesce(timeformats.shown(moment, rule.option("target_timezone", "UTC")), raw)
        result.warn.append((raw.isNotNull() & moment.isNull(), ["_pre_detector_timeparsing_failure", *rule.failure_tags]))
    copied = [f for f in o.get("copy_fields_to_detection_event", ["host.name"]) if frame.look(f) is not None]
    gate = F.lit(True)
    if ips := rule.option("ip_fields"):
        gate, result.prepare = alerted(frame, ips, options.get("alert_ip_list_path") or {})
    fields |= part(frame, copied)
    outputs = options.get("outputs") or rule.option("outputs") or [{"detections": "pre_detector"}]
    empty = F.array().cast("array<struct<output:string,target:string,doc:string>>")
    result.extra = F.when(yes(gate), records(outputs, F.to_json(as_struct(fields)))).otherwise(empty)
    result.writes[0].when = known.isNull() & yes(gate)
    return result


def alerted(frame: Frame, fields: list[str], table: dict | str) -> tuple[Column, list[dict[str, Column]]]:
    """Whether any of the fields is an address of the list that hasn't expired, and the columns that this needs. The list
    maps addresses or networks to an expiry as ISO text, or null for none."""
    entries = load_yaml(table.removeprefix("file://")) if isinstance(table, str) else table
    found, steps = F.lit(False), [addresses.steps(text_of(frame, f), f"__ip{i}_") for i, f in enumerate(fields)]
    by_end: dict[str | None, list[str]] = {}
    for network, until in (entries or {}).items():
        by_end.setdefault(None if until is None else str(until), []).append(str(network))
    for until, networks in by_end.items():
        alive = F.lit(True) if until is None else F.current_timestamp() < timeformats.iso(F.lit(until), "UTC")
        for i in range(len(fields)):
            found = found | (addresses.inside(F.col(f"__ip{i}_4"), F.col(f"__ip{i}_6"), networks) & yes(alive))
    return found, [{k: v for d in level for k, v in d.items()} for level in zip(*steps)]


#: A value that is a pseudonym already.
DONE = r"^<pseudonym:[0-9a-f]{64}>"
#: Patterns that capture all of a text of one line.
WHOLE = ("(.*)", ".*", "(.+)", ".+", "^(.*)$", "([\\s\\S]*)")


def hashed(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value, F.lit(salt)), 256)


def captured(value: Column, pattern: str, salt: str) -> tuple[Column, Column]:
    """The text with all that the pattern's groups capture anywhere, or without groups its matches, replaced by pseudonyms; and
    (pseudonym, origin) of each different one. Pseudonyms stay."""
    count, java = re.compile(pattern).groups, java_pattern(pattern)
    found = F.concat(*(F.regexp_extract_all(value, F.lit(java), F.lit(i)) for i in (range(1, count + 1) if count else [0])))
    origins = F.filter(F.array_distinct(found), lambda o: (o != "") & ~o.rlike(DONE))
    wrapped = lambda o: F.concat(F.lit("<pseudonym:"), hashed(o, salt), F.lit(">"))
    named = lambda o: F.struct(hashed(o, salt).alias("pseudonym"), o.alias("origin"))
    text = F.aggregate(origins, value, lambda t, o: F.replace(t, o, wrapped(o)))
    parts = F.transform(origins, named)
    if pattern in WHOLE:  # most texts are one line, which is captured as a whole
        line, fresh = ~value.contains("\n"), (value != "") & ~value.rlike(DONE)
        text = F.when(line, F.when(fresh, wrapped(value)).otherwise(value)).otherwise(text)
        parts = F.when(line, F.filter(F.array(named(value)), lambda _: fresh)).otherwise(parts)
    return text, parts


_URL = re.compile(r"(?:https?://)?(?:[^\s/@:]+:[^\s/@]+@)?(?:[\w-]+\.)+[A-Za-z]{2,}(?::\d+)?(?:[/?#]\S*)?")


def masked_url(url: str, mask: Callable[[str], str]) -> str:
    """A URL with its subdomains, credentials, path, fragment and values of its query masked."""
    parts = urlparse(url if url.startswith(("http://", "https://")) else f"http://{url}")
    labels = (parts.hostname or "").split(".")
    if len(labels) > 2:
        below = ".".join(labels[:-2])
        url = url.replace(below, mask(below))
    if parts.fragment:
        url = url.replace(f"#{parts.fragment}", f"#{mask(parts.fragment)}")
    if parts.username:
        own = f"{parts.username}:{parts.password}"
        url = url.replace(own, mask(own))
    if len(parts.path) > 1:
        url = url.replace(parts.path[1:], mask(parts.path[1:]))
    if parts.query:
        values = {k: [mask(v) for v in vs if v] for k, vs in parse_qs(parts.query).items()}
        url = url.replace(parts.query, urlencode(values, safe="<pseudonym:>", doseq=True))
    return url


def url_masker(pattern: str, salt: str):
    """For texts with URLs: where the pattern captures anything, parts of each URL become pseudonyms, and then what is captured besides."""
    compiled, done = re.compile(pattern), re.compile(DONE)

    @F.pandas_udf("array<struct<text:string,parts:array<struct<pseudonym:string,origin:string>>>>")
    def work(batch: pd.Series) -> pd.Series:
        def one(text: str | None) -> dict | None:
            if text is None:
                return None
            parts: dict[str, str] = {}

            def mask(value: str) -> str:
                if done.match(value):
                    return value
                own = hashlib.sha256((value + salt).encode()).hexdigest()
                parts[own] = value
                return f"<pseudonym:{own}>"

            found = [g for m in compiled.finditer(text) for g in (m.groups() or (m[0],)) if g]
            values = dict.fromkeys(found)
            if values:
                for url in dict.fromkeys(_URL.findall(text)):
                    text = text.replace(url, masked_url(url, mask))
                    values.pop(url, None)
            for value in values:
                if value in text:
                    text = text.replace(value, mask(value))
            return {"text": text, "parts": [{"pseudonym": k, "origin": v} for k, v in parts.items()]}

        return batch.map(lambda xs: None if xs is None else [one(x) for x in xs])

    return work


def replacing(pattern: str, salt: str):
    return lambda v: F.struct(*(c.alias(n) for c, n in zip(captured(v, pattern, salt), ("text", "parts"))))


def sent(output: str, target: str):
    return lambda d: F.struct(F.lit(output).alias("output"), F.lit(target).alias("target"), d.alias("doc"))


@operator("pseudonymizer")
def pseudonymizer(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Replaces what a pattern captures in a field by a salted hash and sends (pseudonym, origin) to side outputs.

    All that is captured anywhere is replaced everywhere; elements of lists are treated one by one; what is a pseudonym already stays. The origin is encrypted with the
    public keys ``pubkey_analyst`` and ``pubkey_depseudo`` of the stage's options, in ``mode`` GCM or CTR, or by a function ``encrypt`` from an
    origin to text; with neither, no origin is sent. In fields that a rule names as ``url_fields``, the parts of URLs are replaced one by one.
    """
    pseudonyms = rule.option("pseudonyms")
    if not pseudonyms:
        raise RuleError("a rule of pseudonymizer needs pseudonyms")
    patterns = options.get("regex_mapping") or {}
    if isinstance(patterns, str):
        patterns = load_yaml(patterns)
    salt, encrypt = str(options.get("hash_salt", "")), options.get("encrypt")
    if encrypt is None and options.get("pubkey_analyst") and options.get("pubkey_depseudo"):
        encrypt = sealing.encrypter(get_raw(options["pubkey_analyst"]), get_raw(options["pubkey_depseudo"]), options.get("mode", "GCM"))
    lacking = F.lit(False)
    result = Effect(conflict_tags=rule.failure_tags)
    extra = F.array().cast("array<struct<output:string,target:string,doc:string>>")
    stamp = text_of(frame, "@timestamp") if frame.look("@timestamp") is not None else None
    steps: list[dict[str, Column]] = [{}, {}, {}]  # what is made once and used several times
    for i, (path, name) in enumerate(pseudonyms.items()):
        pattern = patterns.get(name, name)
        lacking = lacking | source(frame, path).isNull()
        many = isinstance(frame.kind(path), T.ArrayType)
        values = source(frame, path).cast("array<string>") if many else F.array(text_of(frame, path))
        steps[0][f"__pieces{i}"] = url_masker(pattern, salt)(values) if path in rule.option("url_fields", []) else F.transform(values, replacing(pattern, salt))
        pieces = F.col(f"__pieces{i}")
        new = F.transform(pieces, lambda x: x["text"])
        steps[1][f"__parts{i}"] = F.array_distinct(F.flatten(F.filter(F.transform(pieces, lambda x: x["parts"]), lambda x: x.isNotNull())))
        parts = F.col(f"__parts{i}")
        result.writes.append(Write(path, new if many else F.get(new, F.lit(0)), "overwrite"))
        if encrypt is not None:
            flat = F.transform(parts, lambda p: p["origin"])
            steps[2][f"__sealed{i}"] = F.pandas_udf(lambda s: s.map(lambda xs: None if xs is None else [encrypt(x) for x in xs]), "array<string>")(flat)
            parts = F.zip_with(parts, F.col(f"__sealed{i}"), lambda p, e: F.struct(p["pseudonym"].alias("pseudonym"), e.alias("origin")))
        shown = ("pseudonym", "origin") if encrypt is not None else ("pseudonym",)
        docs = F.transform(parts, lambda p: F.to_json(as_struct({n: p[n] for n in shown} | ({"@timestamp": stamp} if stamp is not None else {}))))  # noqa: B023 - called at once
        for x in options.get("outputs") or [{"pseudonyms": "pseudonyms"}]:
            for o, t in x.items():
                extra = F.concat(extra, F.transform(F.coalesce(docs, F.array().cast("array<string>")), sent(o, t)))
    if not rule.option("ignore_missing_fields", False):
        result.warn = [(lacking, rule.missing_tags)]
    result.extra, result.prepare = extra, [x for x in steps if x]
    return result
