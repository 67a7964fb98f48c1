"""Operators that move, add, join and remove fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import paths
from ..plans.frame import Effect, Frame, Write
from ..plans.rules import Rule, RuleError, load_yaml
from ..sources.getters import get_mapping
from .base import effect, is_text, literal, operator, reject, source


def _listed(frame: Frame, path: str, kind: str) -> Column:
    column, own = source(frame, path), frame.kind(path)
    if isinstance(own, T.ArrayType):
        return F.coalesce(column.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return F.when(column.isNotNull(), F.array(column.cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))


def _falsy(frame: Frame, path: str) -> Column:
    column, kind = source(frame, path), frame.kind(path)
    if isinstance(kind, T.StringType):
        return column.isNull() | (column == "")
    if isinstance(kind, T.NumericType):
        return column.isNull() | (column == 0)
    if isinstance(kind, T.BooleanType):
        return column.isNull() | ~column
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return column.isNull() | (F.size(column) == 0)
    return column.isNull()


@operator("field_manager")
def field_manager(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Copies or moves fields: each of a mapping, or all sources to one target, merged to a list without repetitions."""
    mapping, sources, target = rule.option("mapping") or {}, rule.sources, rule.target
    if not mapping and not (sources and target):
        raise RuleError("a rule of field_manager needs a mapping, or source_fields and target_field")
    merge, over = rule.option("merge_with_target", False), rule.option("overwrite_target", False)
    result = effect(rule, frame, [], sources=[*mapping, *sources])
    if mapping:
        some = reduce(lambda a, b: a | b, [~_falsy(frame, s) for s in mapping])
        result.writes += [Write(t, source(frame, s), rule.mode, when=some) for s, t in mapping.items()]
    if sources and target:
        kinds = {str(frame.kind(s)) for s in sources if frame.kind(s) is not None}
        if len(sources) == 1 and not merge:
            result.writes.append(Write(target, source(frame, sources[0]), rule.mode))
        else:
            inner = frame.kind(sources[0])
            inner = inner.elementType if isinstance(inner, T.ArrayType) else inner
            kind = inner.simpleString() if len(kinds) == 1 and inner is not None else "string"
            joined = F.array_distinct(F.array_compact(F.concat(*(_listed(frame, s, kind) for s in sources))))
            joined = F.when(F.size(joined) > 0, joined)
            if merge and frame.leaf(target):
                joined = F.array_distinct(F.concat(_listed(frame, target, kind), joined))
                result.writes.append(Write(target, joined, "overwrite"))
            else:
                result.writes.append(Write(target, joined, "overwrite" if over else "add"))
    return result


@operator("dropper")
def dropper(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Removes fields. A struct left without fields vanishes by itself; without ``drop_full`` it does so too, as an
    empty struct and none are one in typed columns."""
    if isinstance(rule.options, dict):
        fields = rule.option("drop", [])
    else:
        fields = rule.options
    if not fields:
        raise RuleError("a rule of dropper needs 'drop'")
    return Effect(remove=list(fields))


@operator("deleter")
def deleter(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Drops the whole event."""
    if not isinstance(rule.option("delete"), bool):
        raise RuleError("a rule of deleter needs 'delete: true' or 'delete: false'")
    return Effect(delete=rule.option("delete"))


@operator("concatenator")
def concatenator(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Joins fields by a separator, without those that are missing; a field that isn't text stops the event."""
    reject(rule, "source_fields", "target_field")
    values = [source(frame, s) for s in rule.sources]
    result = effect(rule, frame, [(rule.target, F.concat_ws(rule.option("separator", ""), *(v.cast("string") for v in values)))])
    result.fail += [(v.isNotNull(), f"{s} isn't text") for s, v in zip(rule.sources, values) if not is_text(frame, s)]
    return result


@operator("deduplicator")
def deduplicator(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Removes repeated elements of lists and keeps their order; other values stay as they are."""
    reject(rule, "source_fields")
    lists = [s for s in rule.sources if isinstance(frame.kind(s), T.ArrayType)]
    return Effect(writes=[Write(s, F.array_distinct(source(frame, s)), "overwrite") for s in lists])


@operator("key_checker")
def key_checker(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Lists the names of missing fields, sorted, beside those that the target lists already."""
    reject(rule, "source_fields", "target_field")
    lacking = F.array_compact(F.array(*(F.when(source(frame, s).isNull(), F.lit(s)) for s in rule.sources)))
    some = F.size(lacking) > 0
    result = Effect(conflict_tags=rule.failure_tags)
    if rule.option("overwrite_target", False) and frame.leaf(rule.target):
        lacking = F.sort_array(F.array_union(_listed(frame, rule.target, "string"), lacking))
        result.writes.append(Write(rule.target, lacking, "overwrite", when=some))
    else:
        result.writes.append(Write(rule.target, F.sort_array(F.array_distinct(lacking)), "add", when=some))
    return result


class Schema:
    """Allowed labels: a tree of ``{category: {label: {description, children..}}}``."""

    def __init__(self, tree: dict) -> None:
        self.tree = {c: {k: v for k, v in (labels or {}).items() if k != "description"} for c, labels in tree.items()}

    def ancestors(self, category: str, label: str) -> list[str] | None:
        def find(labels: dict, above: list[str]) -> list[str] | None:
            for name, below in labels.items():
                if name == "description":
                    continue
                if name == label:
                    return above
                if isinstance(below, dict) and (found := find(below, [*above, name])) is not None:
                    return found
            return None

        return find(self.tree.get(category, {}), [])


@operator("labeler")
def labeler(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Adds labels to ``label.<category>``, sorted and once each; a schema checks them and may add their parents."""
    labels = rule.options.get("label", rule.options)
    schema = Schema(load_yaml(options["schema"]) if isinstance(options.get("schema"), str) else options["schema"]) if options.get("schema") else None
    result = Effect(conflict_tags=rule.failure_tags)
    for category, names in labels.items():
        names = list(names)
        if schema:
            for n in list(names):
                above = schema.ancestors(category, n)
                if above is None:
                    raise RuleError(f"the schema doesn't know the label {category}: {n}")
                if options.get("include_parent_labels"):
                    names += above
        path = paths.join(["label", category])
        values = F.array(*(F.lit(n) for n in dict.fromkeys(names)))
        result.writes.append(Write(path, F.sort_array(F.array_union(_listed(frame, path, "string"), values)), "overwrite"))
    return result


@operator("generic_adder")
def generic_adder(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Adds constants from the rule and from files, of which the first that exists is enough if the rule says so. What a file
    says counts more than what the rule says, and a later file more than an earlier one."""
    items = dict(rule.option("add", {}))
    files = rule.option("add_from_file", [])
    first, missing = rule.option("only_first_existing_file", False), []
    for place in [files] if isinstance(files, str) else files:
        try:
            found = get_mapping(place)
        except FileNotFoundError:
            missing.append(place)
            continue
        if not isinstance(found, dict) or not all(isinstance(v, (str, bool, int, float, list)) for v in found.values()):
            raise RuleError(f"{place} must hold a mapping to plain values")
        items |= found
        if first:
            break
    if missing and not first:
        raise RuleError(f"files of a rule of generic_adder are missing: {missing}")
    if not items:
        raise RuleError("a rule of generic_adder adds nothing")
    return Effect(writes=[Write(p, literal(v), rule.mode) for p, v in items.items()], conflict_tags=rule.failure_tags)
