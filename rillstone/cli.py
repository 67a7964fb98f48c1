"""``python -m rillstone.cli``: run pipelines, check configurations, try rules, make load, hash values."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from .functions import sealing
from .plans.pipeline import Pipeline, read_config, verify
from .sources.getters import get_raw


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def sink_of(o: dict) -> tuple:
    """Where an output of a configuration sends events, and where side records."""
    from .sources import sinks

    kind, auth = o["type"].removeprefix("ng_"), (o["user"], o.get("secret") or o.get("password", "")) if o.get("user") else None
    if kind == "jsonl_output":
        return lambda df: sinks.write_jsonl(df, o["output_file"]), lambda df: sinks.write_records(df, o.get("output_file_custom") or o["output_file"] + ".custom")
    if kind == "confluentkafka_output":
        servers, more = o["kafka_config"]["bootstrap.servers"], {k: str(v) for k, v in o["kafka_config"].items() if k != "bootstrap.servers"}
        return lambda df: sinks.write_kafka(df, o["topic"], servers, **more), lambda df: sinks.write_kafka(df, None, servers, **more)
    unwrapped = lambda df: df.select("target", "doc")
    if kind == "opensearch_output":
        options = {"chunk": o.get("chunk_size", 500), "size": o.get("max_chunk_bytes", 100 << 20), "auth": auth, "threads": o.get("thread_count", 4), "op": o.get("default_op_type", "index"), "attempts": o.get("max_connection_retries", 10)}
        return lambda df: sinks.write_search(df, o["hosts"], o["default_index"], **options), lambda df: sinks.write_search(unwrapped(df).withColumnRenamed("target", "_index"), o["hosts"], o["default_index"], **options)
    if kind == "s3_output":
        base = sinks.bucket(o["bucket"], o.get("base_prefix", ""))
        return lambda df: sinks.write_prefixed(df, base, o["prefix_field"], o.get("default_prefix", "default")), lambda df: sinks.write_prefixed(unwrapped(df), base, "target", o.get("default_prefix", "default"))
    one = {"http_output": lambda df: sinks.write_http(df, o["target_url"], auth), "console_output": sinks.write_console, "dummy_output": sinks.write_nothing}.get(kind)
    if one is None:
        raise ValueError(f"there is no output {o['type']!r}")
    return one, one


def _run(a: argparse.Namespace) -> int:
    from .sources import events
    from .streaming import Exporter, Outputs, Reloading, run

    spark, config = session(), read_config(*a.config)
    if problems := verify(config):
        print("\n".join(problems), file=sys.stderr)
        return 1
    (spec,) = config["input"].values()
    schema = spec.get("schema")
    readers = {
        "jsonl_input": lambda: events.jsonl(spark, spec["documents_path"], schema, bool(spec.get("stream"))),
        "json_input": lambda: events.json_documents(spark, spec["documents_path"], schema),
        "file_input": lambda: events.tail(spark, spec["logfile_path"], spec.get("start", "begin")) if spec.get("watch_file") else events.lines(spark, spec["logfile_path"]),
        "http_input": lambda: events.jsonl(spark, spec["landing"], schema, True),
        "confluentkafka_input": lambda: events.kafka(spark, spec["topic"], spec["kafka_config"], schema, max_offsets=spec.get("max_offsets")),
        "dummy_input": lambda: events.in_memory(spark, spec["documents"], schema, int(spec.get("repeat", 1))),
    }
    outputs = Outputs()
    for name, o in (config.get("output") or {}).items():
        events_to, records_to = sink_of(o)
        if o.get("default", True):
            outputs.default.append(events_to)
        outputs.named[name] = records_to
    if error := config.get("error_output"):
        (o,) = error.values()
        outputs.failed = sink_of(o)[0]
    if (config.get("metrics") or {}).get("enabled"):
        Exporter(spark, int(config["metrics"].get("port", 8000)))
    pipeline = Reloading(*a.config, every=float(config.get("config_refresh_interval") or 300))
    query = run(pipeline, readers[spec["type"]](), outputs, spec.get("checkpoint"))
    if query:
        query.awaitTermination()
    return 0


def _config(a: argparse.Namespace) -> int:
    problems = verify(read_config(*a.config))
    print("\n".join(problems) or "the configuration can run")
    return int(bool(problems))


def _dry(a: argparse.Namespace) -> int:
    from .testing import dry_run

    text = Path(a.events).read_text(encoding="utf-8")
    given = json.loads(text) if a.events.endswith(".json") else [json.loads(x) for x in text.splitlines() if x.strip()]
    for r in dry_run(session(), Pipeline.read(*a.config), given if isinstance(given, list) else [given]):
        print(json.dumps(r, indent=1, ensure_ascii=False))
    return 0


def _unit(a: argparse.Namespace) -> int:
    from .testing import run_rule_tests

    report = run_rule_tests(session(), a.rules)
    print(f"{report.passed} passed, {len(report.failed)} failed, {len(report.untested)} rules without test, coverage {report.coverage:.0%}")
    print("\n".join(report.failed))
    return int(bool(report.failed))


def _generate(a: argparse.Namespace) -> int:
    from .sources import sinks
    from .sources.generator import generate, samples

    made = generate(session(), samples(a.input), a.events, a.shuffle)
    if a.target.startswith("http"):
        print(sinks.write_http(made.drop("target"), a.target))
    else:
        made.select("value").write.mode("append").text(a.target)
    return 0


def _print(a: argparse.Namespace) -> int:
    print(json.dumps(read_config(*a.config), indent=2) if a.output == "json" else yaml.safe_dump(read_config(*a.config), sort_keys=False))
    return 0


def _keys(a: argparse.Namespace) -> int:
    private, public = sealing.make_keys(a.bits)
    for path, text in ((a.file, private), (f"{a.file}.pub", public)):
        Path(path).write_text(text, encoding="ascii")
    Path(a.file).chmod(0o600)
    return 0


def _seal(a: argparse.Namespace) -> int:
    print(sealing.encrypter(get_raw(a.analyst), get_raw(a.depseudo), a.mode)(a.value))
    return 0


def _unseal(a: argparse.Namespace) -> int:
    print(sealing.decrypt(a.value, get_raw(a.analyst), get_raw(a.depseudo)))
    return 0


def _pseudo(a: argparse.Namespace) -> int:
    print(f"<pseudonym:{hashlib.sha256((a.value + a.salt).encode()).hexdigest()}>")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rillstone")
    sub = p.add_subparsers(required=True)
    for name, function, extra in (("run", _run, []), ("check", _config, []), ("dry-run", _dry, ["--events"]), ("print", _print, ["--output"])):
        s = sub.add_parser(name)
        s.add_argument("config", nargs="+")
        for x in extra:
            s.add_argument(x, required=x == "--events", default="yaml")
        s.set_defaults(function=function)
    s = sub.add_parser("test")
    s.add_argument("rules")
    s.set_defaults(function=_unit)
    s = sub.add_parser("generate")
    s.add_argument("input")
    s.add_argument("target")
    s.add_argument("--events", type=int, default=1000)
    s.add_argument("--shuffle", action="store_true")
    s.set_defaults(function=_generate)
    s = sub.add_parser("hash")
    s.add_argument("value")
    s.add_argument("salt")
    s.set_defaults(function=_pseudo)
    s = sub.add_parser("make-keys")
    s.add_argument("file")
    s.add_argument("--bits", type=int, default=2048)
    s.set_defaults(function=_keys)
    for name, function in (("pseudonymize", _seal), ("depseudonymize", _unseal)):
        s = sub.add_parser(name)
        s.add_argument("analyst", help="key file in PEM")
        s.add_argument("depseudo", help="key file in PEM")
        s.add_argument("value")
        s.add_argument("--mode", default="GCM", choices=["GCM", "CTR"])
        s.set_defaults(function=function)
    a = p.parse_args(argv)
    return a.function(a)


if __name__ == "__main__":
    sys.exit(main())
