"""Operators that take text apart."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dissect, grok
from ..plans.filters import as_text, java_pattern
from ..plans.frame import Effect, Frame, Write, yes
from ..plans.rules import Rule, RuleError
from .base import effect, gaps, is_text, operator, pairs, reject, source

TRUTHS = ("yes", "true", "on", "y")


def text_of(frame: Frame, path: str) -> Column:
    kind = frame.kind(path)
    return source(frame, path) if kind is None else as_text(source(frame, path), kind)


def _converted(value: Column, kind: str) -> tuple[Column, Column]:
    """Value of another type, and whether that failed."""
    clean = F.regexp_replace(F.trim(value), "_", "")
    if kind == "int":
        out = F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("long"))
    elif kind == "float":
        out = clean.try_cast("double")
    else:
        return F.lower(value).isin(*TRUTHS) | F.coalesce(clean.try_cast("long") != 0, F.lit(False)), F.lit(False)
    return out, value.isNotNull() & out.isNull()


@operator("dissector")
def dissector(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Cuts text at literal delimiters into fields, which may be appended to, named by other pieces, stripped and converted.

    Where a delimiter is missing what remains is all of the rest for that field and nothing for those after it. Fields
    that are named by the text itself (``%{?k}`` and ``%{&k}``) go to a map of that name.
    """
    mapping, convert = rule.option("mapping") or {}, rule.option("convert_datatype") or {}
    if not mapping and not convert:
        raise RuleError("a rule of dissector needs a mapping or convert_datatype")
    result = Effect(conflict_tags=rule.failure_tags, warn=[] if rule.option("ignore_missing_fields", False) else [(source(frame, s).isNull(), rule.failure_tags) for s in mapping])
    values: dict[str, Column] = {}
    where: dict[str, Column] = {}
    failed: list[Column] = []
    for path, pattern in mapping.items():
        head, parts = dissect.compile_pattern(pattern)
        value = source(frame, path)
        if not is_text(frame, path):
            failed.append(value.isNotNull())
            continue
        rest = value if not head else F.when(F.contains(value, F.lit(head)), F.substring(value, F.locate(head, value) + len(head), F.length(value))).otherwise(F.lit(""))
        cut: list[tuple[dissect.Part, Column]] = []
        for p in parts:
            if p.delimiter:
                at = F.locate(p.delimiter, rest)
                piece = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)
                rest = F.when(at > 0, F.substring(rest, at + len(p.delimiter), F.length(rest))).otherwise(F.lit(""))
            else:
                piece = rest
            cut.append((p, F.trim(piece, F.lit(p.strip)) if p.strip else piece))
        names = {p.name: c for p, c in cut if p.action == "?"}
        for p, piece in sorted(cut, key=lambda x: x[0].position):
            if p.action == "?" or not p.name and p.action != "&":
                continue
            if p.action == "&":
                if p.name not in names:
                    raise RuleError(f"nothing names the field %{{&{p.name}}}")
                values[p.name] = F.when(value.isNotNull(), F.create_map(names[p.name], piece))
                continue
            if p.action == "+":
                before = values.get(p.name)
                if before is None and isinstance(frame.kind(p.name), T.ArrayType):
                    values[p.name] = F.array_append(source(frame, p.name), piece)
                else:
                    before = text_of(frame, p.name) if before is None else before
                    values[p.name] = F.when(before.isNotNull() & (before != ""), F.concat(before, F.lit(p.separator), piece)).otherwise(piece)
            elif p.type:
                out, bad = _converted(piece, p.type)
                failed.append(bad)
                values[p.name] = out
            else:
                values[p.name] = piece
            where[p.name] = value.isNotNull()
    for path, kind in convert.items():
        now = values.get(path, text_of(frame, path))
        out, bad = _converted(now, kind)
        failed.append(bad)
        values[path] = out
    result.writes = [Write(p, v, "overwrite", when=where.get(p)) for p, v in values.items()]
    if failed:
        result.warn.append((reduce(lambda a, b: yes(a) | yes(b), failed), rule.failure_tags))
    if rule.option("delete_source_fields", False):
        result.remove = [s for s in mapping if s not in values]
    return result


@operator("string_splitter")
def string_splitter(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Splits text at a literal delimiter, one space by default."""
    reject(rule, "source_fields", "target_field")
    path = rule.sources[0]
    value = source(frame, path)
    bad = value.isNull() if is_text(frame, path) else F.lit(True)
    parts = F.split(value.cast("string"), re.escape(rule.option("delimeter", rule.option("delimiter", " "))), -1)
    if rule.option("drop_empty", False):
        parts = F.filter(parts, lambda x: F.trim(x) != "")
    tags = [] if rule.option("ignore_missing_fields", False) and is_text(frame, path) else [(bad, rule.failure_tags)]
    return effect(rule, frame, [(rule.target, F.when(~bad, parts))], warn=tags)


@operator("replacer")
def replacer(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Replaces the spans that a template names: ``before %{match:value} after``.

    ``*`` for the value keeps the span, ``%{*}`` any text, ``|g`` makes the span as long as possible. Text that the
    template doesn't fit stays as it is.
    """
    mapping = rule.option("mapping")
    if not mapping:
        raise RuleError("a rule of replacer needs a mapping")
    result = effect(rule, frame, [], sources=list(mapping))
    for path, template in mapping.items():
        pieces = re.split(r"%\{((?:\\.|[^}\\])*)\}", template)
        if len(pieces) < 3:
            raise RuleError(f"the template {template!r} replaces nothing")
        pattern, out, group = f"^({re.escape(pieces[0])})", "$1", 1
        for i in range(1, len(pieces), 2):
            spec, after = pieces[i], pieces[i + 1]
            greedy = spec.endswith("|g")
            spec = spec.removesuffix("|g")
            parts = re.split(r"(?<!\\):", spec, maxsplit=1)
            match, new = (parts[0], parts[1]) if len(parts) == 2 else ("*", parts[0])
            plain = lambda s: re.sub(r"\\([:}|\\*])", r"\1", s)
            inner = ("[\\s\\S]*" + ("" if greedy or i + 2 >= len(pieces) and not after else "?")) if match == "*" else re.escape(plain(match))
            pattern += f"({inner})({re.escape(after)})"
            group += 2
            out += (f"${group - 1}" if new == "*" else re.sub(r"([\\$])", r"\\\1", plain(new))) + f"${group}"
        value = text_of(frame, path)
        new_text = F.regexp_replace(value, pattern, out)
        target = rule.target or path
        mode = "overwrite" if rule.options.get("overwrite_target", True) else "add"
        result.writes.append(Write(target, new_text, mode, when=value.rlike(pattern)))
    return result


@operator("grokker")
def grokker(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Matches whole texts with grok patterns, of a list the first that fits, and writes what they capture."""
    mapping = rule.option("mapping")
    if not mapping:
        raise RuleError("a rule of grokker needs a mapping")
    extra = {**(grok.read_folder(options["custom_patterns_dir"]) if options.get("custom_patterns_dir") else {}), **options.get("patterns", {}), **rule.option("patterns", {})}
    result = effect(rule, frame, [], sources=list(mapping))
    fitted, present = F.lit(False), F.lit(False)
    for path, given in mapping.items():
        if not is_text(frame, path):
            result.fail.append((source(frame, path).isNotNull(), f"{path} isn't text"))
            continue
        value = source(frame, path)
        present = present | value.isNotNull()
        before = F.lit(False)
        fields: dict[str, list[tuple[Column, Column]]] = {}
        for one in [given] if isinstance(given, str) else given:
            java, captures = grok.expand(one, extra)
            java = f"^(?:{java})$"
            fits = yes(value.rlike(java)) & ~before
            before = before | fits
            for group, name, kind in captures:
                name = re.sub(r"\]\[", ".", name).strip("[]")
                piece = F.regexp_extract(value, java, group)
                piece = F.nullif(piece, F.lit(""))
                piece = piece.try_cast("long") if kind == "int" else piece.try_cast("double") if kind == "float" else piece
                fields.setdefault(name, []).append((fits, piece))
        for name, found in fields.items():
            result.writes.append(Write(name, F.coalesce(*(F.when(c, v) for c, v in reversed(found))), rule.mode))
        fitted = fitted | before
    result.warn.append((present & ~fitted, rule.failure_tags))
    return result


_STAMP, _QUOTED, _CALL = r"\[([^\]]*)\]", r'"([^"]*)"', r'"(\S+)(?: +([^"]*?)(?: +\S*)?)?"'
_PRI, _CLOCK, _WHO = r"<([0-9]+)>", r"([^ ]* {1,2}[^ ]* [^ ]*)", r"([a-zA-Z0-9_/.\-]*)(?:\[([0-9]+)\])?(?:[^:]*:)?"
_ISO = r"(\d{4}-[01]\d-[0-3]\dT(?:[0-2]\d)(?::[0-5]\d){2}\.\d+(?:Z|[+-][0-2]\d:[0-5]\d))"
#: For each format, patterns of whole lines and the names of what they capture; the first that fits counts.
_TEXT_FORMATS: dict[str, list[tuple[str, list[str]]]] = {
    "clf": [(r"(\S+)\s+(\S+)\s+(\S+)\s+\[(\S+\s+\S+)\]\s+" + r'"(.*)"\s+(\d{3})\s+(\d+)\s*', ["host", "ident", "authuser", "timestamp", "request_line", "status", "bytes"])],
    "nginx": [
        (rf"([^ ]*) - ([^ ]*) {_STAMP}\s+([^ ]*) {_CALL}\s+([^ ]*)\s+{_QUOTED}\s+{_QUOTED}\s+{_QUOTED}", ["host", "user", "time", "code", "method", "path", "size", "referer", "agent", "gzip_ratio"]),
        (rf"([^ ]*) - ([^ ]*) {_STAMP}\s+{_CALL}\s+([^ ]*) ([^ ]*)\s+{_QUOTED}\s+{_QUOTED}", ["host", "user", "time", "method", "path", "code", "size", "referer", "agent"]),
        (rf"([^ ]*) ([^ ]*) ([^ ]*) {_STAMP} {_CALL} ([^ ]*) ([^ ]*) {_QUOTED} {_QUOTED}", ["remote", "host", "user", "time", "method", "path", "code", "size", "referer", "agent"]),
    ],
    "syslog_rfc3164_local": [(rf"{_PRI}{_CLOCK} {_WHO} *(.*)", ["pri", "time", "ident", "pid", "message"])],
    "syslog_rfc3164": [(rf"{_PRI}{_CLOCK} ([^ ]*) {_WHO} *(.*)", ["pri", "time", "host", "ident", "pid", "message"])],
    "syslog_rfc5424": [(rf"<([0-9]{{1,5}})>1 {_ISO} ([^ ]+) ([^ ]+) ([-0-9]+) ([^ ]+) (\[.*?\]|-) (.+)", ["pri", "time", "host", "ident", "pid", "msgid", "extradata", "message"])],
    "cri": [(r"([^ ]*) ([^ ]*) ([^ ]*) ([\s\S]*)", ["timestamp", "stream", "flags", "message"])],
}


def decoded(value: Column, kind: str, shape: str | None = None) -> Column:
    """The value in another format, null where it doesn't fit: text, a struct or a map of texts. JSON objects are maps of texts, other JSON is text,
    unless a ``shape`` (a type as DDL) says what it is."""
    if kind == "json":
        if shape:
            own = F.from_json(value, shape) if shape.lower().startswith(("struct", "array", "map")) else F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), f"array<{shape}>"), F.lit(0))
            return F.when(F.try_parse_json(value).isNotNull(), own)
        return F.when(F.try_parse_json(value).isNotNull() & value.rlike(r"^\s*\{"), F.from_json(value, "map<string,string>"))
    if kind == "base64":
        raw = F.try_to_binary(value, F.lit("base64"))
        return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    if kind == "decolorize":
        return F.regexp_replace(value, r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[@-Z\\-_])", "")
    if kind == "logfmt":
        pattern = r'([\w*?.|#@/-]+)=("[^"]*"|\S*)'
        keys, values = (F.regexp_extract_all(value, F.lit(pattern), F.lit(i)) for i in (1, 2))
        entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), F.regexp_replace(v, r'^"+|"+$', "").alias("v")))
        # of a repeated key the last one counts
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["k"]))
        return F.when(value.isNotNull(), F.map_from_entries(last))
    if kind == "docker":
        row = F.from_json(value, "log string, stream string, time string")
        return F.when(row["log"].isNotNull() & row["stream"].isNotNull() & row["time"].isNotNull(), F.struct(row["log"].alias("output"), row["stream"].alias("stream"), row["time"].alias("timestamp")))
    if kind in _TEXT_FORMATS:
        choices = []
        names = list(dict.fromkeys(n for _, ns in _TEXT_FORMATS[kind] for n in ns))
        for pattern, own in _TEXT_FORMATS[kind]:
            whole = f"^(?:{pattern})$"
            fields = {n: F.regexp_extract(value, whole, i + 1) for i, n in enumerate(own)}
            fields |= {n: F.nullif(fields[n], F.lit("")) for n in ("pid", "path") if n in fields}  # what may be left out
            choices.append(F.when(value.rlike(whole), F.struct(*(fields.get(n, F.lit(None).cast("string")).alias(n) for n in names))))
        return F.coalesce(*choices)
    raise RuleError(f"there is no source format {kind!r}")


@operator("decoder")
def decoder(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Decodes text of one of eleven formats. If any of several fields doesn't fit, none is written.

    A JSON object becomes a map of texts, in which lists and objects are JSON themselves; with ``schema``, a type such as ``array<int>`` or ``struct<a: struct<b: string>>``, JSON of any kind
    is what that says."""
    if not rule.option("mapping") and not rule.sources:
        raise RuleError("a rule of decoder needs a mapping or source_fields")
    kind, found = rule.option("source_format", "json"), []
    bad = F.lit(False)
    for path, target in pairs(rule):
        if not is_text(frame, path):
            bad = bad | source(frame, path).isNotNull()
            continue
        value = source(frame, path)
        out = decoded(value, kind, rule.option("schema"))
        bad = bad | (value.isNotNull() & out.isNull())
        found.append((target, out))
    return effect(rule, frame, found, sources=[s for s, _ in pairs(rule)], warn=[(bad, rule.failure_tags)], together=~yes(bad))


def java_replacement(text: str) -> str:
    """A replacement in the notation of Python's patterns, in that of Java's."""
    out = re.sub(r"\\(\d{1,2})|\\g<(\w+)>|([\\$])", lambda m: f"${m[1]}" if m[1] else (f"${m[2]}" if m[2].isdigit() else f"${{{m[2]}}}") if m[2] else "\\" + m[3], text)
    return out


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body for a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """The value as a column that the optimizer neither repeats nor computes again for filters further on.

    Filters would be pushed through it, with the whole expression in the place of each mention: with several rules, which go on with one another's text, plans
    would grow as a power of the rules. What depends on the partition stays where it is."""
    return F.when(F.spark_partition_id() >= 0, value)


def substituted(text: Column, pattern: str, new: str, name: str) -> tuple[list[dict[str, Column]], Column]:
    """The text with a pattern replaced again and again, as long as there are fewer matches each time, as columns to prepare and the result.

    A round that has as many matches as the one before, or more, is the last. So there is at most one round more than there are matches at first. As Spark's loops
    can't be left, and copy the text each time, there are four, one in the other, each with the fourth root of that: what is left of them when a text is done is short."""
    java, into, first, often = F.lit(java_pattern(pattern)), F.lit(java_replacement(new)), F.col(f"{name}n"), F.col(f"{name}k")
    # text, its matches if it has another round, matches of the round before
    state = lambda t, n, last: F.struct(t.alias("t"), n.alias("n"), last.alias("last"))

    def again(x: Column) -> Column:
        return bound(F.regexp_replace(x["t"], java, into), lambda t: state(t, F.when(x["n"] < x["last"], F.regexp_count(t, java)).otherwise(0), x["n"]))

    def loops(x: Column, depth: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), often), x, lambda y, _: F.when(y["n"] > 0, loops(y, depth - 1)).otherwise(y)) if depth else again(x)

    steps = [{f"{name}n": F.regexp_count(text, java)}, {f"{name}k": F.ceil(F.pow(first + F.lit(1.0), F.lit(0.25))).cast("int")}]
    return steps, F.when(first > 0, loops(state(text, first, F.lit(2**31 - 1)), 4)["t"]).otherwise(text)


def signed(text: Column) -> Column:
    """A text with marks of a signature, of which those side by side are made one: the text, its signature, and whether a mark isn't closed."""
    single = lambda t, mark: F.when(t.contains(mark * 2), F.regexp_replace(t, f"({re.escape(mark)})+", mark)).otherwise(t)

    def marked(t: Column) -> Column:
        def taken(parts: Column) -> Column:
            # each part begins after a mark; what it lacks of its end stands in the next ones
            whole = lambda x, i: F.when(x.contains("</+>"), x).otherwise(F.array_join(F.slice(parts, i + 2, F.size(parts)), ""))
            tokens = F.transform(F.slice(parts, 2, F.size(parts)), lambda x, i: F.substring_index(whole(x, i), "</+>", 1))
            return F.struct(t.alias("text"), F.array_join(tokens, " ").alias("signature"), (~F.element_at(parts, -1).contains("</+>")).alias("open"))

        return bound(F.split(t, r"<\+>", -1), taken)

    without = lambda t: F.struct(t.alias("text"), F.lit("").alias("signature"), F.lit(False).alias("open"))
    return bound(single(text, "</+>"), lambda t: F.when(t.contains("<+>"), bound(single(t, "<+>"), marked)).otherwise(without(t)))


@operator("clusterer")
def clusterer(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Reduces a message to a signature: a pattern is replaced again and again, as long as there is less to replace each time, and the parts from each
    ``<+>`` to the next ``</+>`` make up the signature. Rules go on with the text that the rule before has left.

    An event takes part if its field ``clusterable`` is true, or, without that field, if it is tagged so or has both a syslog facility and a
    severity, which then stand before the signature.
    """
    reject(rule, "pattern")
    if "repl" not in rule.options:
        raise RuleError("a rule of clusterer needs 'repl'")
    path, target = (rule.sources or ["message"])[0], options.get("output_field_name") or rule.target
    if not target:
        raise RuleError("clusterer needs an output_field_name")
    message = text_of(frame, path)
    hidden = "__cluster"
    known = frame.leaf(hidden) is not None
    begin = F.coalesce(F.nullif(source(frame, hidden), F.lit("")), message) if known else message
    facility, severity = source(frame, "syslog.facility"), source(frame, "event.severity")
    has_pri = facility.isNotNull() & severity.isNotNull()
    flag, kind = source(frame, "clusterable"), frame.kind("clusterable")
    truth = flag if isinstance(kind, T.BooleanType) else flag.cast("string").isin("", "0", "0.0") == F.lit(False)
    tagged = F.array_contains(source(frame, "tags"), "clusterable") if isinstance(frame.kind("tags"), T.ArrayType) else F.lit(False)
    takes_part = yes(F.when(flag.isNotNull(), truth).otherwise(yes(tagged) | has_pri)) & begin.isNotNull()
    start, found = F.col("__begin"), F.col("__found")
    count, text = substituted(start, rule.options["pattern"], rule.options["repl"], "__sub")
    steps = [
        {"__begin": F.when(takes_part, begin), "__marked": takes_part & (message.contains("<+>") | message.contains("</+>"))},
        *count,
        {"__found": once(F.when(start.isNotNull(), bound(text, signed)))},
    ]
    signature = F.when(has_pri, F.concat_ws(" , ", facility.cast("string"), severity.cast("string"), found["signature"])).otherwise(found["signature"])
    result = Effect(warn=gaps(frame, rule, [path]), conflict_tags=rule.failure_tags, prepare=steps)
    result.fail = [(F.col("__marked"), f"{path} holds signature marks already"), (found["open"], "a mark of the signature isn't closed")]
    mode = "overwrite" if rule.options.get("overwrite_target", not rule.option("merge_with_target", False)) else rule.mode
    result.writes = [Write(hidden, found["text"], "overwrite", when=found.isNotNull()), Write(target, signature, mode, when=found.isNotNull())]
    return result
