"""Pipelines: preprocessing, stages in order, and the split of what comes out."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeformats
from ..operators.base import Stage
from .frame import ALIVE, DELETED, ERRORS, EXTRA, WARNINGS, Effect, Frame, Write, quoted
from .rules import RuleError, load_yaml

VERSION = "1.0"


@dataclass
class Results:
    """What a pipeline makes of its input: events for the default outputs, side records, failed events, warnings."""

    whole: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.whole.where(F.col(ALIVE) & ~F.col(DELETED) & (F.size(ERRORS) == 0)).drop(ALIVE, DELETED, ERRORS, WARNINGS, EXTRA)

    @property
    def extras(self) -> DataFrame:
        """(output, target, doc): one row for each side record of events that didn't fail."""
        return self.whole.where(F.size(ERRORS) == 0).select(F.explode(EXTRA).alias("x")).select("x.output", "x.target", "x.doc")

    @property
    def failed(self) -> DataFrame:
        """(event, errors, @timestamp): the event as it stood when it failed."""
        columns = [c for c in self.whole.columns if not c.startswith("__")]
        return self.whole.where(F.size(ERRORS) > 0).select(F.to_json(F.struct(*(quoted(c) for c in columns))).alias("event"), F.array_join(ERRORS, "; ").alias("errors"), timeformats.shown(F.current_timestamp(), "UTC").alias("@timestamp"))

    @property
    def warned(self) -> DataFrame:
        return self.whole.where(F.size(WARNINGS) > 0)


@dataclass
class Preprocessing:
    """What is added to each event before the first stage, in this order."""

    add_full_event_to_target_field: dict[str, Any] | None = None
    hmac: dict[str, str] | None = None
    version_info_target_field: str = ""
    log_arrival_time_target_field: str = ""
    log_arrival_timedelta: dict[str, str] | None = None
    enrich_by_env_variables: dict[str, str] = field(default_factory=dict)

    def __call__(self, frame: Frame) -> Frame:
        always = F.lit(True)
        if o := self.add_full_event_to_target_field:
            nested = frame.nested()
            whole = F.struct(*(frame.look(c)[0].alias(c) for c in nested.columns))
            target = o.get("target_field", "event.original")
            frame = frame.apply(Effect(writes=[Write(target, F.to_json(whole) if o.get("format", "str") == "str" else whole, "overwrite")], remove=[p for p in frame.kinds if p != target] if o.get("clear_event", True) else []), always)
        if o := self.hmac:
            raw = frame.get(o["target"]) if o["target"] != "<RAW_MSG>" else F.to_json(F.struct(*(frame.look(c)[0].alias(c) for c in frame.nested().columns)))
            if raw is None:
                frame = frame.apply(Effect(fail=[(always, f"there is no field {o['target']} to sign")]), always)
            else:
                signed = signature(raw, o["key"])
                base = o.get("output_field", "hmac")
                frame = frame.apply(Effect(writes=[Write(f"{base}.hmac", signed["hmac"]), Write(f"{base}.compressed_base64", signed["compressed_base64"])], fail=[(raw.isNull(), f"there is no field {o['target']} to sign")]), always)
        if t := self.version_info_target_field:
            frame = frame.apply(Effect(writes=[Write(f"{t}.rillstone", F.lit(VERSION)), Write(f"{t}.configuration", F.lit(os.environ.get("RILLSTONE_CONFIG_VERSION", "unset")))]), always)
        if t := self.log_arrival_time_target_field:
            old = frame.get(t)
            writes = [] if old is None else [Write(f"{t}@original", old)]
            frame = frame.apply(Effect(writes=[*writes, Write(t, timeformats.shown(F.current_timestamp(), "UTC"), "overwrite")]), always)
        if o := self.log_arrival_timedelta:
            arrived = timeformats.iso(frame.get(self.log_arrival_time_target_field or "@timestamp").cast("string"), "UTC")
            sent = frame.get(o["reference_field"])
            if sent is not None:
                span = (F.unix_micros(arrived) - F.unix_micros(timeformats.iso(sent.cast("string"), "UTC"))) / 1e6
                frame = frame.apply(Effect(writes=[Write(o["target_field"], span)]), always)
        if self.enrich_by_env_variables:
            frame = frame.apply(Effect(writes=[Write(t, F.lit(os.environ.get(v, ""))) for t, v in self.enrich_by_env_variables.items()]), always)
        return frame


def signature(raw: Column, key: str) -> Column:
    """HMAC-SHA256 as hex digits, and the message compressed."""
    @F.pandas_udf("struct<hmac:string,compressed_base64:string>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        import base64
        import hashlib
        import hmac
        import zlib

        rows = [(None, None) if t is None else (hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest(), base64.b64encode(zlib.compress(t.encode(), -1)).decode()) for t in texts]
        return pd.DataFrame(rows, columns=["hmac", "compressed_base64"])

    return sign(raw)


@dataclass
class Pipeline:
    """Stages in order; ``apply`` takes a DataFrame, static or streaming, of events."""

    stages: list[Stage]
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    config: dict[str, Any] = field(default_factory=dict)

    def apply(self, events: DataFrame) -> Results:
        frame = self.preprocessing(Frame.of(events))
        for stage in self.stages:
            frame = stage(frame)
        return Results(frame.nested(keep_hidden=True))

    @classmethod
    def of(cls, stages: list[Stage | tuple[str, Any]], **preprocessing: Any) -> Pipeline:
        return cls([s if isinstance(s, Stage) else Stage.of(*s) for s in stages], Preprocessing(**preprocessing))

    @classmethod
    def read(cls, *paths: str | Path) -> Pipeline:
        """From YAML or JSON files. Pipelines are joined in order; of other keys the last that is set counts."""
        return cls.from_config(read_config(*paths))

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Pipeline:
        stages = []
        for entry in config.get("pipeline") or []:
            if not isinstance(entry, dict) or len(entry) != 1:
                raise RuleError(f"an entry of a pipeline must be one named stage, not {entry!r}")
            (name, spec), = entry.items()
            spec = dict(spec)
            kind, rules = spec.pop("type", None), spec.pop("rules", [])
            if kind is None:
                raise RuleError(f"the stage {name!r} has no type")
            kind = kind.removeprefix("ng_")
            stages.append(Stage.of(kind, rules, name, **spec))
        names = [s.name for s in stages]
        if len(set(names)) < len(names):
            raise RuleError("two stages have the same name")
        pre: dict[str, Any] = {}
        for own in (config.get("input") or {}).values():
            pre = own.get("preprocessing") or {}
        return cls(stages, Preprocessing(**pre), config)


def read_config(*paths: str | Path) -> dict[str, Any]:
    whole: dict[str, Any] = {"pipeline": []}
    for p in paths:
        path = Path(str(p).removeprefix("file://"))
        own = json.loads(path.read_text(encoding="utf-8")) if path.suffix == ".json" else load_yaml(path)
        if not isinstance(own, dict):
            raise RuleError(f"{path} holds no configuration")
        for k, v in own.items():
            if k == "pipeline":
                whole["pipeline"] += v or []
            elif v not in (None, "", {}, []):
                whole[k] = v
    return whole


def verify(config: dict[str, Any]) -> list[str]:
    """What is wrong with a configuration; nothing if it can run."""
    problems = []
    try:
        Pipeline.from_config(config)
    except (RuleError, ValueError, OSError, KeyError, TypeError) as e:
        problems.append(str(e))
    known = {"version", "config_refresh_interval", "process_count", "restart_count", "timeout", "logger", "input", "output", "error_output", "pipeline", "metrics", "profile_pipelines", "print_auto_test_stack_trace", "error_backlog_size"}
    problems += [f"unknown key {k!r}" for k in config if k not in known]
    if not config.get("pipeline"):
        problems.append("the pipeline is empty")
    return problems
