"""Rules as users write them, read from dicts, files and folders."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from . import filters


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass
class Rule:
    """A filter, the options of one operator, and what belongs to every rule."""

    kind: str
    where: filters.Node
    options: dict[str, Any]
    filter_text: str = "*"
    id: str = ""
    description: str = ""
    tag_on_failure: list[str] = field(default_factory=list)

    @property
    def failure_tags(self) -> list[str]:
        return self.tag_on_failure or [f"_{self.kind}_failure"]

    @property
    def missing_tags(self) -> list[str]:
        return [f"_{self.kind}_missing_field_warning"]

    def same(self, other: Rule) -> bool:
        return self.where == other.where and self.options == other.options and self.kind == other.kind

    def option(self, name: str, default: Any = None) -> Any:
        value = self.options.get(name)
        return default if value is None else value

    @property
    def sources(self) -> list[str]:
        return list(self.option("source_fields", []))

    @property
    def target(self) -> str:
        return self.option("target_field", "")

    @property
    def mode(self) -> str:
        """add, merge or overwrite; a rule that wants to merge and to overwrite says two things at once."""
        if self.option("overwrite_target", False) and self.option("merge_with_target", False):
            raise RuleError(f"a rule of {self.kind} can't have both overwrite_target and merge_with_target")
        return "overwrite" if self.option("overwrite_target", False) else "merge" if self.option("merge_with_target", False) else "add"


def rule_of(kind: str, raw: dict[str, Any]) -> Rule:
    """One rule of an operator from its dict ``{filter: .., <operator>: {..}}``."""
    if not isinstance(raw, dict):
        raise RuleError(f"a rule must be a mapping, not {raw!r}")
    unknown = set(raw) - {"filter", kind, "description", "id", "tests", "regex_fields", "sigma_fields", "tag_on_failure"}
    if unknown:
        raise RuleError(f"unknown keys in a rule of {kind}: {sorted(unknown)}")
    if "filter" not in raw or kind not in raw:
        raise RuleError(f"a rule of {kind} needs the keys 'filter' and '{kind}'")
    options = raw[kind] or {}
    like = raw.get("sigma_fields", ())
    where = filters.parse(str(raw["filter"]), tuple(raw.get("regex_fields", ())), like if isinstance(like, bool) else tuple(like))
    if isinstance(options, dict):
        options = dict(options)
        own = {k: options.pop(k) for k in ("id", "description", "tag_on_failure") if k in options}
    else:
        own = {}
    if isinstance(options, dict) and options.get("overwrite_target") and options.get("merge_with_target"):
        raise RuleError(f"a rule of {kind} can't have both overwrite_target and merge_with_target")
    name = own.get("id") or raw.get("id") or hashlib.sha256(json.dumps([raw["filter"], options], sort_keys=True, default=str).encode()).hexdigest()
    rule = Rule(kind, where, options, str(raw["filter"]), str(name), own.get("description") or raw.get("description", ""), list(own.get("tag_on_failure") or raw.get("tag_on_failure") or []))
    return rule


class Loader(yaml.SafeLoader):
    """YAML with ``!include file``, and ``!set_anchor[:n] value`` that ``!load_anchor[:n]`` repeats, across documents."""

    base = Path(".")
    anchors: dict[str, Any] = {}


def _include(loader: Loader, node: yaml.Node) -> Any:
    return load_yaml(loader.base / loader.construct_scalar(node))


def _value(loader: Loader, node: yaml.Node) -> Any:
    if isinstance(node, yaml.MappingNode):
        return loader.construct_mapping(node, deep=True)
    if isinstance(node, yaml.SequenceNode):
        return loader.construct_sequence(node, deep=True)
    return yaml.safe_load(node.value) if node.value else None


def _set(loader: Loader, suffix: str, node: yaml.Node) -> Any:
    value = loader.anchors[suffix.lstrip(":") or "0"] = _value(loader, node)
    return value


def _load(loader: Loader, suffix: str, node: yaml.Node) -> Any:
    name = suffix.lstrip(":") or "0"
    if name not in loader.anchors:
        raise RuleError(f"no anchor {name!r} is set")
    return loader.anchors[name]


Loader.add_constructor("!include", _include)
Loader.add_multi_constructor("!set_anchor", _set)
Loader.add_multi_constructor("!load_anchor", _load)


def load_yaml(path: str | Path, all_documents: bool = False) -> Any:
    path = Path(path)
    own = type("_Loader", (Loader,), {"base": path.parent, "anchors": {}})
    with path.open(encoding="utf-8") as f:
        found = list(yaml.load_all(f, Loader=own))
    return found if all_documents else (found[0] if found else None)


def rule_dicts(source: Any) -> list[dict[str, Any]]:
    """All rules of a dict, a file, a folder with all below it, or a list of these. Files are read in the order of their paths."""
    if isinstance(source, dict):
        return [source]
    if isinstance(source, (list, tuple)):
        return [r for x in source for r in rule_dicts(x)]
    path = Path(str(source).removeprefix("file://"))
    if path.is_dir():
        files = sorted(p for p in path.rglob("*") if p.suffix in (".yml", ".yaml", ".json") and not p.name.endswith("_test.json"))
        return [r for p in files for r in rule_dicts(str(p))]
    if not path.exists():
        raise RuleError(f"there is no rule file {path}")
    if path.suffix == ".json":
        found = json.loads(path.read_text(encoding="utf-8"))
    else:
        found = load_yaml(path, all_documents=True)
    flat = [x for doc in (found if isinstance(found, list) else [found]) for x in (doc if isinstance(doc, list) else [doc])]
    return [x for x in flat if x]


def rules_of(kind: str, source: Any) -> list[Rule]:
    """Compiled rules without those equal to an earlier one."""
    out: list[Rule] = []
    for raw in rule_dicts(source):
        rule = rule_of(kind, raw)
        if not any(rule.same(x) for x in out):
            out.append(rule)
    return out
