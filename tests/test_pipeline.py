import base64
import gzip
import hashlib
import hmac
import json
import time

import pytest

from rillstone.operators import Stage
from rillstone.plans.frame import Frame
from rillstone.plans.pipeline import Pipeline, Preprocessing, read_config, verify
from rillstone.plans.rules import RuleError, rule_dicts
from rillstone.sources import events, generator, sinks
from rillstone.sources.http import Landing
from rillstone.streaming import Outputs, Reloading, observed, run
from rillstone.testing import differences, dry_run, run_rule_tests

RULES = {"filter": "a: x", "generic_adder": {"add": {"b": "y"}}}


def test_results_are_split(spark):
    rows = [{"a": "x", "n": 1}, {"a": "d", "n": 2}, {"a": "f", "n": 3}]
    pipeline = Pipeline.of([("generic_adder", RULES), ("deleter", {"filter": "a: d", "deleter": {"delete": True}}), ("concatenator", {"filter": "a: f", "concatenator": {"source_fields": ["n"], "target_field": "c"}}), ("selective_extractor", {"filter": "*", "selective_extractor": {"source_fields": ["a"], "outputs": [{"o": "t"}]}})])
    found = pipeline.apply(events.in_memory(spark, rows))
    assert [json.loads(x) for x in found.events.toJSON().collect()] == [{"a": "x", "n": 1, "b": "y"}]
    assert [json.loads(r.doc) for r in found.extras.collect()] == [{"a": "x"}]
    (failed,) = found.failed.collect()
    assert json.loads(failed.event)["n"] == 3 and failed.errors == "n isn't text"


def test_stream_gives_what_a_table_gives(spark, tmp_path):
    rows = [{"a": "x" if i % 2 else "z", "n": i} for i in range(20)]
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[k::4]))
    pipeline = Pipeline.of([("generic_adder", RULES)])
    stream = events.jsonl(spark, str(tmp_path / "in"), "a string, n long", stream=True)
    query = run(pipeline, stream, Outputs(default=[lambda df: sinks.write_jsonl(df, str(tmp_path / "out"))], failed=lambda df: df.count()), str(tmp_path / "c"), available_now=True)
    query.awaitTermination(60)
    batch = pipeline.apply(events.in_memory(spark, rows)).events
    show = lambda df: sorted((r.a, r.n, r.b) for r in df.collect())
    assert show(spark.read.json(str(tmp_path / "out"))) == show(batch)


def test_configuration(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.yml").write_text("filter: 'a: x'\ngeneric_adder:\n  add: {b: y}\n---\nfilter: c\ngeneric_adder:\n  add: {d: e}\n")
    (tmp_path / "r" / "one_test.json").write_text(json.dumps([{"raw": {"a": "x"}, "processed": {"a": "x", "b|re": "%{WORD}"}}, {"target_rule_idx": 1, "raw": {"c": 1}, "processed": {"c": 1}}]))
    (tmp_path / "c.yml").write_text(f"version: 1\npipeline:\n  - adder:\n      type: generic_adder\n      rules: ['{tmp_path}/r']\n")
    (tmp_path / "d.yml").write_text("version: 2\npipeline:\n  - del:\n      type: deleter\n      rules: [{filter: q, deleter: {delete: true}}]\n")
    config = read_config(tmp_path / "c.yml", tmp_path / "d.yml")
    assert config["version"] == 2 and len(config["pipeline"]) == 2 and verify(config) == []
    assert verify({"pipeline": [{"x": {"type": "nothing"}}], "odd": 1})
    report = run_rule_tests(spark, tmp_path / "r")
    assert report.passed == 1 and len(report.failed) == 1 and report.coverage == 1
    (shown,) = dry_run(spark, Pipeline.from_config(config), [{"a": "x"}])
    assert shown["added"] == ["b"] and shown["output"] == {"a": "x", "b": "y"}
    (tmp_path / "i.yml").write_text("filter: !set_anchor:1 'a'\ngeneric_adder: {add: {x: !load_anchor:1 }}\n")
    assert rule_dicts(str(tmp_path / "i.yml")) == [{"filter": "a", "generic_adder": {"add": {"x": "a"}}}]
    with pytest.raises(RuleError):
        rule_dicts(str(tmp_path / "none.yml"))


def test_differences():
    assert differences({"a": {"b": 1}, "c|re": r"\d+"}, {"a": {"b": 1}, "c": "12"}) == []
    assert len(differences({"a": 1, "b": 2}, {"a": 2, "c": 3})) == 3


def test_preprocessing(spark, monkeypatch):
    monkeypatch.setenv("SITE", "s1")
    pre = Preprocessing(add_full_event_to_target_field={"target_field": "event.original", "clear_event": False}, hmac={"target": "m", "key": "k", "output_field": "h"}, version_info_target_field="v", log_arrival_time_target_field="at", enrich_by_env_variables={"site": "SITE", "none": "NOT_SET"}, log_arrival_timedelta={"target_field": "late", "reference_field": "t"})
    row = json.loads(pre(Frame.of(events.in_memory(spark, [{"m": "x", "t": "2020-01-01T00:00:00Z"}]))).nested().toJSON().first())
    assert json.loads(row["event"]["original"]) == {"m": "x", "t": "2020-01-01T00:00:00Z"} and row["site"] == "s1" and row["none"] == "" and row["late"] > 1e6
    assert row["h"]["hmac"] == hmac.new(b"k", b"x", hashlib.sha256).hexdigest()


def test_http_landing(tmp_path):
    landing = Landing(str(tmp_path / "l"), {"/j": "json", "/l.*": "jsonl", "/p": "plaintext"}, {"/p": ("u", "w")}, most=3)
    assert landing.handle("/j", b'{"a": 1}', {}) == 200
    assert landing.handle("/lines", gzip.compress(b'{"a": 2}\n{"a": 3}'), {"content-encoding": "gzip"}) == 200
    assert landing.handle("/p", b"hi", {}) == 401
    assert landing.handle("/p", b"hi", {"authorization": "Basic " + base64.b64encode(b"u:w").decode()}) == 200
    assert landing.handle("/j", b'{"a": 1}', {}) == 429 and landing.handle("/q", b"", {}) == 404
    found = [json.loads(x) for p in sorted((tmp_path / "l").glob("*.json")) for x in p.read_text().splitlines()]
    assert [f.get("a") for f in found] == [1, 2, 3, None] and found[3]["message"] == "hi"


def test_tail(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("one\ntwo\nthr")
    stream = events.tail(spark, str(log))
    query = stream.writeStream.format("memory").queryName("tailed").start()
    try:
        query.processAllAvailable()
        assert [r.message for r in spark.table("tailed").collect()] == ["one", "two"]
        with log.open("a") as f:
            f.write("ee\n")
        deadline = time.time() + 20
        while spark.table("tailed").count() < 3 and time.time() < deadline:
            query.processAllAvailable()
        assert [r.message for r in spark.table("tailed").collect()] == ["one", "two", "three"]
    finally:
        query.stop()


def test_sinks_and_generator(spark, tmp_path):
    df = spark.createDataFrame([(1, "p"), (2, None)], "n int, where string")
    sinks.write_prefixed(df, str(tmp_path / "s"), "where", "lost")
    assert spark.read.text(str(tmp_path / "s" / "prefix=p")).count() == 1 and spark.read.text(str(tmp_path / "s" / "prefix=lost")).count() == 1
    assert sinks.write_http(df, "http://x", send=lambda u, b: 200 + len(b.splitlines()) * 0) == {"200": 2}
    with pytest.raises(ValueError):
        sinks.write_http(df, "x")
    assert list(sinks.chunks(["a", "bb", "c"], 2, 100)) == [["a", "bb"], ["c"]] and list(sinks.chunks(["a", "bb"], 9, 2)) == [["a"], ["bb"]]
    assert sinks.bulk_lines('{"_index": "i", "a": 1}', "d").splitlines() == ['{"index": {"_index": "i"}}', '{"a": 1}']
    made = generator.generate(spark, [("t", '{"@timestamp": "x", "a": 1}'), ("u", '{"b": 2}')], 5, timestamp={"key": "@timestamp", "format": "%Y"}, tag="load").collect()
    assert len(made) == 5 and all(json.loads(r.value)["tags"] == ["load"] for r in made)
    (tmp_path / "e").mkdir()
    parsed = events.parsed(spark.createDataFrame([('{"a": 1}',), ("no",)], "value string"), "a int")
    assert sorted((r.a, r._raw) for r in parsed.collect() if r.a) == [(1, None)] and events.unreadable(parsed).count() == 1


def test_stage_keeps_first_of_equal_rules():
    assert len(Stage.of("generic_adder", [RULES, RULES]).rules) == 1


def test_reloading_and_metrics(spark, tmp_path):
    from pyspark.sql import Observation

    path = tmp_path / "c.yml"
    config = "version: {}\npipeline:\n  - adder:\n      type: generic_adder\n      rules: [{{filter: a, generic_adder: {{add: {{b: {}}}}}}}]\n"
    path.write_text(config.format(1, "x"))
    source = Reloading(str(path), every=0)
    seen = []
    store = Outputs(default=[lambda df: seen.append([r.b for r in df.collect()])])
    run(source, events.in_memory(spark, [{"a": 1}]), store)
    path.write_text(config.format(2, "y"))
    run(source, events.in_memory(spark, [{"a": 1}]), store)
    path.write_text("version: 3\npipeline: [{x: {type: nothing}}]\n")
    run(source, events.in_memory(spark, [{"a": 1}]), store)
    assert seen == [["x"], ["y"], ["y"]] and "nothing" in source.problem
    counts = Observation("counts")
    found = source().apply(events.in_memory(spark, [{"a": 1}, {"a": 2}]))
    observed(found, counts).whole.collect()
    assert counts.get["events"] == 2 and counts.get["failed"] == 0


def test_unreadable_inputs_go_to_the_failed_output(spark):
    seen = {}
    rows = [{"a": "x"}, ValueError("no such offset"), {"a": "z"}]
    keep = lambda name: lambda df: seen.setdefault(name, []).extend(df.collect())
    run(Pipeline.of([("generic_adder", RULES)]), events.in_memory(spark, rows), Outputs(default=[keep("events")], failed=keep("failed")))
    assert [(r.a, r.b) for r in seen["events"]] == [("x", "y"), ("z", None)] and [r.event for r in seen["failed"]] == ["ValueError: no such offset"]
    raw = spark.createDataFrame([('{"a": "x"}',), ("[1]",), ("{broken",)], "value string")
    assert sorted(r.event for r in events.unreadable(events.parsed(raw, "a string")).collect()) == ["[1]", "{broken"]


def test_search_output_retries_and_refusals(spark, tmp_path):
    """Busy items are sent again alone, a dead host is left for another, refused documents go to the failed output."""
    folder = str(tmp_path)

    def send(address, body):
        import os
        import uuid

        if "dead" in address:
            raise ConnectionError("nobody there")
        docs = [json.loads(x) for x in body.decode().splitlines()[1::2]]
        items = []
        for d in docs:
            mark = os.path.join(folder, f"seen-{d['n']}")
            first = not os.path.exists(mark)
            open(mark, "a").write("x")
            status = 400 if d["n"] == 3 else 429 if d["n"] == 5 and first else 201
            items.append({"index": {"status": status, **({"error": {"type": "bad" if status == 400 else "busy"}} if status > 201 else {})}})
        open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w").write(str(len(docs)))
        return {"errors": any("error" in i["index"] for i in items), "items": items}

    df, refused = spark.range(10).selectExpr("id AS n").coalesce(1), []
    sinks.write_search(df, ["dead:1", "alive:1"], "i", chunk=4, send=send, first=0.01, failed=lambda f: refused.extend(f.collect()))
    assert [(json.loads(r.event)["n"], json.loads(r.errors)["type"]) for r in refused] == [(3, "bad")]
    assert (tmp_path / "seen-5").read_text() == "xx" and (tmp_path / "seen-4").read_text() == "x"
    with pytest.raises(RuntimeError):
        sinks.write_search(df, "alive:1", "i", send=send)
    with pytest.raises(Exception, match="nobody there"):
        sinks.write_search(df, "dead:1", "i", send=send, attempts=2, first=0.01)


def test_prefixes_and_records(spark, tmp_path):
    assert sinks.bucket("b", "/x/") == "s3a://b/x" and sinks.bucket("file:///t") == "file:///t"
    assert sinks.dated("a/%{%Y}/%{%H-%M}") == time.strftime("a/%Y/%H-%M", time.gmtime())
    sinks.write_prefixed(spark.createDataFrame([("p%{%j}", 1), (None, 2)], "p string, n long"), f"{tmp_path}/s3", "p", "none")
    found = {(r.prefix, "reason" in r.value) for r in spark.read.text(f"{tmp_path}/s3").collect()}
    assert found == {(time.strftime("p%j", time.gmtime()), False), ("none", True)}
    sinks.write_records(spark.createDataFrame([("o", 't"1', '{"a": 1}')], "output string, target string, doc string"), f"{tmp_path}/r")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/r").collect()] == [{'t"1': {"a": 1}}]


class Service:
    """A small web server whose text and ETag can be changed."""

    def __init__(self):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        service, self.text, self.asked = self, "one\n", []

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                service.asked.append(dict(self.headers))
                tag = hashlib.sha256(service.text.encode()).hexdigest()
                same = self.headers.get("If-None-Match") == tag
                self.send_response(304 if same else 200)
                self.send_header("ETag", tag)
                self.end_headers()
                if not same:
                    self.wfile.write(service.text.encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/list.txt"


def test_web_lookups(tmp_path, monkeypatch):
    from rillstone.sources import getters

    service, told = Service(), []
    (tmp_path / "c.yml").write_text(f"{service.url[:20]}: {{username: u, password: p}}\n")
    monkeypatch.setenv(getters.CREDENTIALS, str(tmp_path / "c.yml"))
    assert getters.get_lines(service.url) == ["one"] == getters.get_lines(service.url) and len(service.asked) == 1
    assert service.asked[0]["Authorization"].startswith("Basic ")
    getters.on_change(service.url, told.append)
    later = time.monotonic() + getters.FRESH + 1
    assert getters.refresh(later) == [] and len(service.asked) == 2
    service.text = "two\n"
    assert getters.refresh(later + getters.FRESH) == [service.url] and told == ["two\n"] and getters.get_lines(service.url) == ["two"]
    getters._seen[service.url].callbacks.clear()
    getters.refresh(later + getters.UNUSED * 2)
    assert service.url not in getters._seen
    service.server.shutdown()


def test_exporter(spark, tmp_path):
    import urllib.error
    import urllib.request

    from rillstone.streaming import Exporter

    exporter = Exporter(spark)
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{exporter.port}{path}").read().decode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": "x"}\n{"a": "z"}\n')
    query = run(Pipeline.of([("generic_adder", RULES)]), events.jsonl(spark, str(tmp_path / "in"), "a string", stream=True), Outputs(default=[sinks.write_nothing]), str(tmp_path / "c"), available_now=True)
    query.awaitTermination(60)
    for _ in range(50):
        if "rillstone_events_total" in get("/metrics"):
            break
        time.sleep(0.2)
    assert "rillstone_events_total{stream=" in get("/metrics") and get("/health") == "well\n"
    exporter.ended("s", "it broke\nhere")
    with pytest.raises(urllib.error.HTTPError):
        get("/health")
    exporter.close()


def test_keys_on_the_command_line(tmp_path, capsys):
    from rillstone.cli import main

    for name in ("a", "b"):
        main(["make-keys", str(tmp_path / name), "--bits", "1024"])
    main(["pseudonymize", str(tmp_path / "a.pub"), str(tmp_path / "b.pub"), "origin"])
    main(["depseudonymize", str(tmp_path / "a"), str(tmp_path / "b"), capsys.readouterr().out.strip()])
    assert capsys.readouterr().out.strip() == "origin"


def test_outputs_of_a_configuration():
    from rillstone.cli import sink_of

    for o in ({"type": "dummy_output"}, {"type": "ng_opensearch_output", "hosts": ["h"], "default_index": "i", "user": "u"}, {"type": "s3_output", "bucket": "b", "prefix_field": "p"}, {"type": "jsonl_output", "output_file": "f"}, {"type": "confluentkafka_output", "topic": "t", "kafka_config": {"bootstrap.servers": "s"}}):
        assert all(map(callable, sink_of(o)))
    with pytest.raises(ValueError):
        sink_of({"type": "nothing"})
