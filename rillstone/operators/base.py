"""What all operators share: the registry, stages, and the options that most rules have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import filters, order
from ..plans.frame import ALIVE, MATCH, Effect, Frame, Write, quoted, ticked, yes
from ..plans.rules import Rule, RuleError, load_yaml, rules_of

Compile = Callable[[Rule, Frame, dict[str, Any]], Effect]
OPERATORS: dict[str, Compile] = {}


def operator(name: str) -> Callable[[Compile], Compile]:
    """Registers a function that compiles the rules of an operator; users may add their own."""

    def add(function: Compile) -> Compile:
        OPERATORS[name] = function
        return function

    return add


@dataclass
class Stage:
    """One operator with its rules. All rules are matched against the events as they come in, then applied in order."""

    kind: str
    rules: list[Rule]
    options: dict[str, Any] = field(default_factory=dict)
    name: str = ""

    @classmethod
    def of(cls, kind: str, rules: Any, name: str = "", **options: Any) -> Stage:
        if kind not in OPERATORS:
            raise RuleError(f"unknown operator {kind!r}")
        return cls(kind, rules_of(kind, rules), options, name or kind)

    def in_order(self) -> list[Rule]:
        tree = self.options.get("tree_config") or {}
        if isinstance(tree, str):
            tree = load_yaml(tree)
        self.tags = tree.get("tag_map") or {}
        return [self.rules[i] for i in order.ordered([r.where for r in self.rules], tree.get("priority_dict"), self.tags)]

    def __call__(self, frame: Frame) -> Frame:
        rules = self.in_order()
        if not rules:
            return frame
        if not self.options.get("apply_multiple_times"):
            return _bare(self._round(frame, rules, []))
        done = [f"__done{i}" for i in range(len(rules))]
        frame = Frame(frame.df.select("*", *(F.lit(False).alias(d) for d in done)), frame.kinds)
        for _ in rules:  # each round applies at least one rule that hasn't been, or nothing more matches
            frame = self._round(frame, rules, done)
        return _bare(Frame(frame.df.drop(*done), frame.kinds))

    def _round(self, frame: Frame, rules: list[Rule], done: list[str]) -> Frame:
        tests = [yes(filters.to_column(order.guarded(r.where, self.tags), frame.look)) & quoted(ALIVE) for r in rules]
        if done:
            tests = [t & ~quoted(d) for t, d in zip(tests, done)]
        columns = [c for c in frame.df.columns if c not in done and c != MATCH]  # what the stage before has matched ends here
        marks = [(quoted(d) | t).alias(d) for d, t in zip(done, tests)]
        matched = F.struct(*(t.alias(f"m{i}") for i, t in enumerate(tests))).alias(MATCH)
        frame = Frame(frame.df.select(*(ticked(c) for c in columns), *marks, matched), frame.kinds)
        for i, rule in enumerate(rules):
            frame = frame.apply(OPERATORS[self.kind](rule, frame, self.options), F.col(MATCH).getField(f"m{i}"))
        return frame


def _bare(frame: Frame) -> Frame:
    """Without what rules of one stage leave for one another."""
    own = [p for p in frame.kinds if p.startswith("__")]
    return Frame(frame.df.drop(*own), {p: k for p, k in frame.kinds.items() if p not in own}) if own else frame


def source(frame: Frame, path: str) -> Column:
    """The value at a path, null where there can be none."""
    found = frame.get(path)
    return F.lit(None).cast("string") if found is None else found


def is_text(frame: Frame, path: str) -> bool:
    return isinstance(frame.kind(path), (T.StringType, type(None)))


def gaps(frame: Frame, rule: Rule, fields: list[str]) -> list[tuple[Column, list[str]]]:
    """The warning for fields that are missing, unless the rule ignores that."""
    if rule.option("ignore_missing_fields", False):
        return []
    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | source(frame, f).isNull()
    return [(lacking, rule.missing_tags)]


def effect(rule: Rule, frame: Frame, values: list[tuple[str, Column]], sources: list[str] | None = None, miss: bool = True, **more: Any) -> Effect:
    """Writes in the rule's mode, a warning for missing sources, and their removal if the rule asks for it."""
    fields = rule.sources if sources is None else sources
    result = Effect(**more)
    result.writes = [Write(p, v, rule.mode) for p, v in values] + result.writes
    if miss:
        result.warn = gaps(frame, rule, fields) + result.warn
    result.conflict_tags = result.conflict_tags or rule.failure_tags
    if rule.option("delete_source_fields", False):
        targets = {p for p, _ in values}
        result.remove = result.remove + [f for f in fields if f not in targets]
    return result


def pairs(rule: Rule) -> list[tuple[str, str]]:
    """(source, target) of a rule's mapping, or of its single source; the target is the source where none is named."""
    if mapping := rule.option("mapping"):
        return list(mapping.items())
    first = rule.sources[0]
    return [(first, rule.target or first)]


def reject(rule: Rule, *needed: str) -> None:
    for name in needed:
        if not rule.options.get(name):
            raise RuleError(f"a rule of {rule.kind} needs {name!r}")


def literal(value: Any) -> Column:
    """A constant of any JSON kind; lists of mixed kinds and of mappings become lists of text."""
    import json

    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(str(k)) for k, v in value.items()))
    if isinstance(value, list):
        kinds = {type(x) for x in value}
        if len(kinds) == 1 and kinds <= {str, int, float, bool}:
            return F.array(*(F.lit(x) for x in value))
        return F.array(*(F.lit(x if isinstance(x, str) else json.dumps(x)) for x in value)).cast("array<string>")
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("long" if abs(value) < 2**63 else "decimal(38,0)")
    return F.lit(value)
