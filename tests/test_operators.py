import json

import pytest

from rillstone.operators import OPERATORS, Stage
from rillstone.plans.rules import RuleError
from rillstone.testing import processed


def done(spark, event, kind, *rules, **options):
    return processed(spark, [Stage.of(kind, list(rules), **options)], event)


def rule(kind, where="*", **options):
    return {"filter": where, kind: options}


CASES = [
    ("generic_adder", {"a": 1}, rule("generic_adder", add={"b.c": "x", "l": [1, 2]}), {"a": 1, "b": {"c": "x"}, "l": [1, 2]}),
    ("generic_adder", {"a": "y"}, rule("generic_adder", add={"a": "x", "b": "z"}), {"a": "y", "b": "z", "tags": ["_generic_adder_failure"]}),
    ("generic_adder", {"a": "y"}, rule("generic_adder", add={"a": "x"}, overwrite_target=True), {"a": "x"}),
    ("generic_adder", {"a": "y"}, rule("generic_adder", add={"a.b": "x"}), {"a": "y", "tags": ["_generic_adder_failure"]}),
    ("field_manager", {"a": "x"}, rule("field_manager", mapping={"a": "b.c"}, delete_source_fields=True), {"b": {"c": "x"}}),
    ("field_manager", {"a": "x", "b": ["y", "x"]}, rule("field_manager", source_fields=["a", "b"], target_field="c"), {"a": "x", "b": ["y", "x"], "c": ["x", "y"]}),
    ("field_manager", {"a": "x", "c": ["z"]}, rule("field_manager", source_fields=["a"], target_field="c", merge_with_target=True), {"a": "x", "c": ["z", "x"]}),
    ("field_manager", {"a": "x"}, rule("field_manager", mapping={"a": "c", "b": "d"}), {"a": "x", "c": "x", "tags": ["_field_manager_missing_field_warning"]}),
    ("field_manager", {"l": ["a", "b", "c"]}, rule("field_manager", mapping={"l.-1": "last", "l.0:2": "two"}), {"l": ["a", "b", "c"], "last": "c", "two": ["a", "b"]}),
    ("dropper", {"a": {"b": 1, "c": 2}}, rule("dropper", drop=["a.b"]), {"a": {"c": 2}}),
    ("dropper", {"a": {"b": 1}, "d": 1}, rule("dropper", drop=["a.b"]), {"d": 1}),
    ("deleter", {"a": 1}, rule("deleter", delete=True), None),
    ("deleter", {"a": 1}, rule("deleter", delete=False), {"a": 1}),
    ("concatenator", {"a": "x", "b": "y"}, rule("concatenator", source_fields=["a", "b"], target_field="c", separator="-"), {"a": "x", "b": "y", "c": "x-y"}),
    ("concatenator", {"a": "x"}, rule("concatenator", source_fields=["a", "b"], target_field="c", separator="-"), {"a": "x", "c": "x", "tags": ["_concatenator_missing_field_warning"]}),
    ("deduplicator", {"l": ["b", "a", "b"], "s": "x"}, rule("deduplicator", source_fields=["l", "s", "q"]), {"l": ["b", "a"], "s": "x"}),
    ("key_checker", {"a": 1}, rule("key_checker", source_fields=["a", "z", "b.c"], target_field="m"), {"a": 1, "m": ["b.c", "z"]}),
    ("labeler", {"a": 1, "label": {"x": ["q"]}}, rule("labeler", label={"x": ["b", "a"]}), {"a": 1, "label": {"x": ["a", "b", "q"]}}),
    ("dissector", {"m": "x y:7"}, rule("dissector", mapping={"m": "%{a} %{b}:%{c|int}"}), {"m": "x y:7", "a": "x", "b": "y", "c": 7}),
    ("dissector", {"m": "xy"}, rule("dissector", mapping={"m": "%{a} %{b}"}), {"m": "xy", "a": "xy", "b": ""}),
    ("dissector", {"m": "k=v"}, rule("dissector", mapping={"m": "%{?k}=%{&k}"}), {"m": "k=v", "k": {"k": "v"}}),
    ("dissector", {"m": "a b c--"}, rule("dissector", mapping={"m": "%{+x/2} %{+(-)x/1} %{y-(-)}"}), {"m": "a b c--", "x": "ba", "y": "c"}),
    ("dissector", {"m": "on 1.5"}, rule("dissector", mapping={"m": "%{a|bool} %{b|float}"}), {"m": "on 1.5", "a": True, "b": 1.5}),
    ("dissector", {"m": "q"}, rule("dissector", convert_datatype={"m": "int"}, mapping={}), {"m": "q", "tags": ["_dissector_failure"]}),
    ("string_splitter", {"a": "x,,y"}, rule("string_splitter", source_fields=["a"], target_field="l", delimeter=",", drop_empty=True), {"a": "x,,y", "l": ["x", "y"]}),
    ("replacer", {"a": "from 1.2.3.4 to"}, rule("replacer", mapping={"a": "from %{*:IP} to"}), {"a": "from IP to"}),
    ("replacer", {"a": "other"}, rule("replacer", mapping={"a": "from %{*:IP} to"}), {"a": "other"}),
    ("grokker", {"m": "7 abc"}, rule("grokker", mapping={"m": "%{INT:n:int} %{WORD:w.x}"}), {"m": "7 abc", "n": 7, "w": {"x": "abc"}}),
    ("grokker", {"m": "abc"}, rule("grokker", mapping={"m": "%{INT:n:int}"}), {"m": "abc", "tags": ["_grokker_failure"]}),
    ("grokker", {"m": "abc"}, rule("grokker", mapping={"m": ["%{INT:n}", "%{WORD:n}"]}), {"m": "abc", "n": "abc"}),
    ("decoder", {"m": "aGk="}, rule("decoder", mapping={"m": "t"}, source_format="base64"), {"m": "aGk=", "t": "hi"}),
    ("decoder", {"m": "?"}, rule("decoder", mapping={"m": "t"}, source_format="base64"), {"m": "?", "tags": ["_decoder_failure"]}),
    ("decoder", {"m": '{"a": "b"}'}, rule("decoder", mapping={"m": "t"}), {"m": '{"a": "b"}', "t": {"a": "b"}}),
    ("decoder", {"m": 'a=b c="d e" a=f'}, rule("decoder", mapping={"m": "t"}, source_format="logfmt"), {"m": 'a=b c="d e" a=f', "t": {"c": "d e", "a": "f"}}),
    ("decoder", {"m": "<34>Oct 11 22:14:15 box su[1]: no"}, rule("decoder", mapping={"m": "t"}, source_format="syslog_rfc3164"), {"m": "<34>Oct 11 22:14:15 box su[1]: no", "t": {"pri": "34", "time": "Oct 11 22:14:15", "host": "box", "ident": "su", "pid": "1", "message": "no"}}),
    ("decoder", {"m": "2020-01-01T00:00:00Z stdout F hi you"}, rule("decoder", mapping={"m": "t"}, source_format="cri"), {"m": "2020-01-01T00:00:00Z stdout F hi you", "t": {"timestamp": "2020-01-01T00:00:00Z", "stream": "stdout", "flags": "F", "message": "hi you"}}),
    ("decoder", {"m": "[1, 2]"}, rule("decoder", mapping={"m": "t"}, schema="array<int>"), {"m": "[1, 2]", "t": [1, 2]}),
    ("decoder", {"m": "3"}, rule("decoder", mapping={"m": "t"}, schema="bigint"), {"m": "3", "t": 3}),
    ("decoder", {"m": '{"a": {"b": [1.5]}}'}, rule("decoder", mapping={"m": "t"}, schema="struct<a: struct<b: array<double>>>"), {"m": '{"a": {"b": [1.5]}}', "t": {"a": {"b": [1.5]}}}),
    ("decoder", {"m": "[1, 2"}, rule("decoder", mapping={"m": "t"}, schema="array<int>"), {"m": "[1, 2", "tags": ["_decoder_failure"]}),
    ("decoder", {"m": '1.2.3.4 - joe [10/Oct/2000:13:55:36 -0700] "GET /a b HTTP/1.0" 200 23'}, rule("decoder", mapping={"m": "t"}, source_format="clf"), {"m": '1.2.3.4 - joe [10/Oct/2000:13:55:36 -0700] "GET /a b HTTP/1.0" 200 23', "t": {"host": "1.2.3.4", "ident": "-", "authuser": "joe", "timestamp": "10/Oct/2000:13:55:36 -0700", "request_line": "GET /a b HTTP/1.0", "status": "200", "bytes": "23"}}),
    ("decoder", {"m": 'h - u [t o] "GET /x HTTP/1.1" 404 7 "r" "a b"'}, rule("decoder", mapping={"m": "t"}, source_format="nginx"), {"m": 'h - u [t o] "GET /x HTTP/1.1" 404 7 "r" "a b"', "t": {"host": "h", "user": "u", "time": "t o", "method": "GET", "path": "/x", "code": "404", "size": "7", "referer": "r", "agent": "a b"}}),
    ("decoder", {"m": "<28>Feb  1 10:00:00 su: hi"}, rule("decoder", mapping={"m": "t"}, source_format="syslog_rfc3164_local"), {"m": "<28>Feb  1 10:00:00 su: hi", "t": {"pri": "28", "time": "Feb  1 10:00:00", "ident": "su", "message": "hi"}}),
    ("decoder", {"m": "<165>1 2003-10-11T22:14:15.003Z box app 12 ID47 [x y=\"1\"] hi you"}, rule("decoder", mapping={"m": "t"}, source_format="syslog_rfc5424"), {"m": "<165>1 2003-10-11T22:14:15.003Z box app 12 ID47 [x y=\"1\"] hi you", "t": {"pri": "165", "time": "2003-10-11T22:14:15.003Z", "host": "box", "ident": "app", "pid": "12", "msgid": "ID47", "extradata": '[x y="1"]', "message": "hi you"}}),
    ("decoder", {"m": '{"log": "x", "stream": "stderr", "time": "t"}'}, rule("decoder", mapping={"m": "t"}, source_format="docker"), {"m": '{"log": "x", "stream": "stderr", "time": "t"}', "t": {"output": "x", "stream": "stderr", "timestamp": "t"}}),
    ("calculator", {"a": 1.26, "b": 2.344}, rule("calculator", calc="round(${a}, 1) + round(${b} * 1, 2)", target_field="c"), {"a": 1.26, "b": 2.344, "c": 1.3 + 2.34}),
    ("calculator", {"a": 2}, rule("calculator", calc="hypot(3, 4) + sgn(-${a}) + trunc(2.7) + multiply(2, 3)", target_field="c"), {"a": 2, "c": 12.0}),
    ("calculator", {"a": 2}, rule("calculator", calc="all(${a}, 1, PI)", target_field="c"), {"a": 2, "c": True}),
    ("decoder", {"m": "\x1b[31mred\x1b[0m"}, rule("decoder", mapping={"m": "t"}, source_format="decolorize"), {"m": "\x1b[31mred\x1b[0m", "t": "red"}),
    ("calculator", {"a": 7, "b": "2"}, rule("calculator", calc="(${a} + 1) / ${b}", target_field="c"), {"a": 7, "b": "2", "c": 4.0}),
    ("calculator", {"a": 7}, rule("calculator", calc="${a} / 0", target_field="c"), {"a": 7, "tags": ["_calculator_failure"]}),
    ("calculator", {"a": 7}, rule("calculator", calc="${a} > 3", target_field="c"), {"a": 7, "c": True}),
    ("calculator", {"a": "ff"}, rule("calculator", calc="from_hex(${a})", target_field="c"), {"a": "ff", "c": 255}),
    ("calculator", {"a": 1}, rule("calculator", calc="2 ^ 3 ^ 2 - -1", target_field="c"), {"a": 1, "c": 513}),
    ("timestamper", {"m": "01.02.2020 10:00"}, rule("timestamper", source_fields=["m"], source_format=["%d.%m.%Y %H:%M"], source_timezone="Europe/Berlin", target_field="t"), {"m": "01.02.2020 10:00", "t": "2020-02-01T09:00:00Z"}),
    ("timestamper", {"m": "1580551200123"}, rule("timestamper", source_fields=["m"], source_format="UNIX"), {"m": "1580551200123", "@timestamp": "2020-02-01T10:00:00.123000Z"}),
    ("timestamper", {"m": "20190802T094620Z"}, rule("timestamper", source_fields=["m"], target_timezone="Europe/Berlin"), {"m": "20190802T094620Z", "@timestamp": "2019-08-02T11:46:20+02:00"}),
    ("timestamper", {"m": "soon"}, rule("timestamper", source_fields=["m"]), {"m": "soon", "tags": ["_timestamper_failure"]}),
    ("timestamp_differ", {"a": "2020-01-02", "b": "2020-01-01T12:00:00Z"}, rule("timestamp_differ", diff="${a:%Y-%m-%d} - ${b}", target_field="d", show_unit=True), {"a": "2020-01-02", "b": "2020-01-01T12:00:00Z", "d": "43200.0 s"}),
    ("generic_resolver", {"a": "to 7"}, rule("generic_resolver", field_mapping={"a": "b"}, resolve_list=[{"x": "X"}, {"\\d": "number"}]), {"a": "to 7", "b": "number"}),
    ("template_replacer", {"a": "1", "b": "2"}, rule("template_replacer", pattern={"delimiter": "-", "fields": ["a", "b"], "target_field": "b"}, template={"1-2": "new"}), {"a": "1", "b": "new"}),
    ("list_comparison", {"a": ["x", "q"]}, rule("list_comparison", source_fields=["a"], target_field="r", lists={"l": ["x"], "m": ["y"]}), {"a": ["x", "q"], "r": {"in_list": ["l"]}}),
    ("list_comparison", {"b": 1}, rule("list_comparison", source_fields=["b"], target_field="r", lists={"l": ["1"]}), {"b": 1, "r": {"not_in_list": ["l"]}}),
    ("network_comparison", {"a": "2001:db8::1"}, rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": ["10.0.0.0/8", "2001:db8::/32"]}), {"a": "2001:db8::1", "r": {"in_list": ["l"]}}),
    ("network_comparison", {"a": "nonsense"}, rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": ["10.0.0.0/8"]}), {"a": "nonsense", "tags": ["_network_comparison_failure"]}),
    ("network_comparison", {"a": ["8.8.8.8", "10.1.1.1"]}, rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": ["10.0.0.0/8"]}), {"a": ["8.8.8.8", "10.1.1.1"], "r": {"in_list": ["l"]}}),
    ("ip_informer", {"a": "127.0.0.1"}, rule("ip_informer", source_fields=["a"], target_field="r", properties=["is_loopback", "version"]), {"a": "127.0.0.1", "r": {"127.0.0.1": {"is_loopback": True, "version": 4}}}),
    ("domain_label_extractor", {"u": "https://a.b.example.co.uk:8080/x"}, rule("domain_label_extractor", source_fields=["u"], target_field="d"), {"u": "https://a.b.example.co.uk:8080/x", "d": {"registered_domain": "example.co.uk", "top_level_domain": "co.uk", "subdomain": "a.b"}}),
    ("domain_label_extractor", {"u": "10.0.0.1"}, rule("domain_label_extractor", source_fields=["u"], target_field="d"), {"u": "10.0.0.1", "tags": ["ip_in_u"]}),
    ("clusterer", {"message": "user 12 and 7", "clusterable": True}, rule("clusterer", source_fields=["message"], target_field="s", pattern=r"(\d+)", repl=r"<+>N</+>"), {"message": "user 12 and 7", "clusterable": True, "s": "N N"}),
    ("clusterer", {"message": "user 12", "clusterable": True}, rule("clusterer", source_fields=["message"], target_field="s", pattern=r"(\d+)", repl=r"<+>\1</+>"), {"message": "user 12", "clusterable": True, "s": "12"}),
    ("clusterer", {"message": "a((((((x))))))b $", "clusterable": True}, rule("clusterer", target_field="s", pattern=r"\((\w*)\)|(\$)", repl=r"\1"), {"message": "a((((((x))))))b $", "clusterable": True, "s": ""}),
    ("clusterer", {"message": "m 1", "syslog": {"facility": 3}, "event": {"severity": "low"}}, rule("clusterer", source_fields=["message"], target_field="s", pattern=r"(\d)", repl=r"<+>\1</+>"), {"message": "m 1", "syslog": {"facility": 3}, "event": {"severity": "low"}, "s": "3 , low , 1"}),
    ("clusterer", {"message": "m 1", "clusterable": False, "tags": ["clusterable"]}, rule("clusterer", source_fields=["message"], target_field="s", pattern=r"(\d)", repl=""), {"message": "m 1", "clusterable": False, "tags": ["clusterable"]}),
    ("geoip_enricher", {"a": "2001:db8::5"}, rule("geoip_enricher", source_fields=["a"]), {"a": "2001:db8::5", "geoip": {"type": "Feature", "properties": {"country": "North"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}}),
    ("geoip_enricher", {"a": "10.0.0.9"}, rule("geoip_enricher", source_fields=["a"]), {"a": "10.0.0.9", "geoip": {"type": "Feature", "properties": {"country": "South", "accuracy_radius": 5}}}),
    ("geoip_enricher", {"a": "10.0.1.9"}, rule("geoip_enricher", source_fields=["a"]), {"a": "10.0.1.9"}),
    ("network_comparison", {"a": ["8.8.8.8", "2001:db8::1"]}, rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": ["10.0.0.0/8"], "m": ["2001:db8::/32"]}), {"a": ["8.8.8.8", "2001:db8::1"], "r": {"in_list": ["m"]}}),
    ("network_comparison", {"a": ["8.8.8.8", "x"]}, rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": ["10.0.0.0/8"]}), {"a": ["8.8.8.8", "x"], "tags": ["_network_comparison_failure"]}),
    ("amides", {"c": "net  user /add"}, rule("amides", source_fields=["c"]), {"c": "net  user /add", "amides": {"confidence": 0.958, "attributions": [{"rule": "b", "confidence": 0.88}, {"rule": "a", "confidence": 0.5}]}}),
    ("domain_resolver", {"u": "http://h.test/x"}, rule("domain_resolver", source_fields=["u"], target_field="ip"), {"u": "http://h.test/x", "ip": "1.2.3.4"}),
    ("requester", {"a": "x"}, rule("requester", url="http://s/${a}", method="GET", target_field_mapping={"v": "out.v"}), {"a": "x", "out": {"v": "1"}}),
    ("datetime_extractor", {"t": "2019-08-02T09:46:18.625+02:00"}, rule("datetime_extractor", source_fields=["t"], target_field="d"), {"t": "2019-08-02T09:46:18.625+02:00", "d": {"year": 2019, "month": 8, "day": 2, "hour": 9, "minute": 46, "second": 18, "microsecond": 625000, "weekday": "Friday", "timezone": "UTC+02:00"}}),
]
LINEAR = {"idf": {"user": 1.0, "net": 1.0}, "weights": {"user": 3.0}, "bias": 1.0}
OPTIONS = {"amides": {"model": {"misuse": LINEAR | {"threshold": 0.9}, "attribution": {"b": LINEAR | {"bias": -0.128}, "a": {"idf": {"x": 1.0}, "weights": {}}}}}, "geoip_enricher": {"ranges": [{"start": "10.0.0.0", "end": "10.0.0.255", "country": "South", "accuracy_radius": "5"}, {"start": "2001:db8::", "end": "2001:db8::ff", "country": "North", "longitude": "1.5", "latitude": "2.5"}]}, "domain_resolver": {"resolver": lambda n: "1.2.3.4" if n == "h.test" else None}, "requester": {"caller": lambda r: (200, '{"v": 1}')}}


@pytest.mark.parametrize("kind, event, given, want", [c for c in CASES if c[3] is not None or c[0] == "deleter"])
def test_cases(spark, kind, event, given, want):
    found, _, errors = done(spark, event, kind, given, **OPTIONS.get(kind, {}))
    assert not errors
    assert found == want


def test_all_operators_are_there():
    assert len(OPERATORS) == 31


def test_errors_stop_the_event(spark):
    found, _, errors = done(spark, {"a": 1, "b": "x"}, "concatenator", rule("concatenator", source_fields=["a", "b"], target_field="c"))
    assert found is None and errors == ["a isn't text"]
    found, _, errors = done(spark, {"t": "never"}, "datetime_extractor", rule("datetime_extractor", source_fields=["t"], target_field="d"))
    assert found is None and errors


def test_rules_match_what_came_in_and_are_applied_once(spark):
    rules = [rule("generic_adder", "a", add={"b": "x"}), rule("generic_adder", "b", add={"c": "y"})]
    assert done(spark, {"a": 1}, "generic_adder", *rules)[0] == {"a": 1, "b": "x"}
    assert done(spark, {"a": 1, "b": None}, "generic_adder", *rules, apply_multiple_times=True)[0] == {"a": 1, "b": "x", "c": "y"}


def test_side_records(spark):
    found, extras, _ = done(spark, {"a": 1, "b": 2}, "selective_extractor", rule("selective_extractor", source_fields=["a", "z"], outputs=[{"o": "t"}]))
    assert found == {"a": 1, "b": 2} and extras == [{"a": 1}]
    found, extras, _ = done(spark, {"a": 1, "host": {"name": "h"}, "@timestamp": "2020-01-01T00:00:00+01:00"}, "pre_detector", {"filter": "a", "pre_detector": {"id": "i", "title": "t", "severity": "low", "mitre": [], "case_condition": "c"}, "description": "d"})
    (record,) = extras
    assert record["pre_detection_id"] == found["pre_detection_id"] and record["host"] == {"name": "h"} and record["@timestamp"] == "2019-12-31T23:00:00Z" and record["rule_filter"] == "a" and record["description"] == "d"


def test_pseudonyms(spark):
    import hashlib

    options = {"regex_mapping": {"NAME": r"user (\w+)"}, "hash_salt": "s", "encrypt": lambda x: x[::-1]}
    found, extras, _ = done(spark, {"m": "user bob saw bob"}, "pseudonymizer", rule("pseudonymizer", pseudonyms={"m": "NAME"}), **options)
    mark = f"<pseudonym:{hashlib.sha256(b'bobs').hexdigest()}>"
    assert found == {"m": f"user {mark} saw {mark}"} and extras == [{"pseudonym": mark[11:-1], "origin": "bob"}]
    found, extras, _ = done(spark, {"m": "user ann, user bob"}, "pseudonymizer", rule("pseudonymizer", pseudonyms={"m": "NAME"}), **options)
    assert found["m"].count("<pseudonym:") == 2 and [x["origin"] for x in extras] == ["nna", "bob"]
    found, extras, _ = done(spark, {"m": ["one", "", "two\nlines", mark, None]}, "pseudonymizer", rule("pseudonymizer", pseudonyms={"m": "(.*)"}), **options)
    assert [x["origin"] for x in extras] == ["eno", "owt", "senil"] and found["m"][1] == "" and found["m"][2].count("<pseudonym:") == 2 and found["m"][3] == mark and found["m"][0].startswith("<pseudonym:")
    again, extras, _ = done(spark, {"m": mark}, "pseudonymizer", rule("pseudonymizer", pseudonyms={"m": "(.*)"}), hash_salt="s")
    assert again == {"m": mark} and extras == []


def test_bad_rules():
    for kind, options in (("calculator", {"calc": "1 +", "target_field": "x"}), ("calculator", {"calc": "what(1)", "target_field": "x"})):
        from rillstone.functions.arithmetic import Expression

        with pytest.raises(RuleError):
            Expression(options["calc"], None).compile()
    with pytest.raises(RuleError):
        Stage.of("nothing", [])
    with pytest.raises(RuleError):
        Stage.of("deleter", {"filter": "*"})
    json.dumps([])


def test_encrypted_origins(spark):
    """Both modes against the JVM's own RSA, and AES by its published examples."""
    import base64

    from rillstone.functions import sealing

    assert sealing.aes_block(sealing._round_keys(bytes(range(32))), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    key, text = bytes.fromhex("feffe9928665731c6d6a8f9467308308"), bytes.fromhex("d9313225f88406e5a55909c5aff5269a86a7a953")
    assert sealing.aes_gcm(key, bytes.fromhex("cafebabefacedbaddecaf888"), text).hex().startswith("42831ec2217774244b7221b784d0d49c") and sealing.aes_gcm(key, bytes.fromhex("cafebabefacedbad"), text).hex().startswith("61353b4c2806934a777ff51fa22a4755")
    java, pems = spark._jvm, []
    for bits in (1024, 2048):
        made = java.java.security.KeyPairGenerator.getInstance("RSA")
        made.initialize(bits)
        pair, factory = made.generateKeyPair(), java.java.security.KeyFactory.getInstance("RSA")
        coded = lambda key, spec: factory.getKeySpec(key, java.java.lang.Class.forName(f"java.security.spec.{spec}EncodedKeySpec")).getEncoded()
        pem = lambda name, data: f"-----BEGIN {name} KEY-----\n{base64.b64encode(bytes(b & 255 for b in data)).decode()}\n-----END {name} KEY-----\n"
        pems.append((pem("PRIVATE", coded(pair.getPrivate(), "PKCS8")), pem("PUBLIC", coded(pair.getPublic(), "X509"))))
        cipher = java.javax.crypto.Cipher.getInstance("RSA/ECB/OAEPWithSHA-1AndMGF1Padding")
        cipher.init(2, pair.getPrivate())
        assert bytes(b & 255 for b in cipher.doFinal(sealing.rsa_encrypt(sealing.read_key(pems[-1][1]), b"text"))) == b"text"
    (a, open_a), (b, open_b) = pems
    for mode in ("GCM", "CTR"):
        assert sealing.decrypt(sealing.encrypter(open_a, open_b, mode)("gr\u00fc\u00dfe"), a, b) == "gr\u00fc\u00dfe"
    private, public = sealing.make_keys(1024)
    assert sealing.rsa_decrypt(sealing.read_key(private), sealing.rsa_encrypt(sealing.read_key(public), b"x" * 50)) == b"x" * 50


def test_pseudonyms_with_keys(spark, tmp_path):
    from rillstone.functions import sealing

    keys = [sealing.make_keys(1024) for _ in range(2)]
    for name, (_, public) in zip(("a", "b"), keys):
        (tmp_path / name).write_text(public)
    found, extras, _ = done(spark, {"m": ["user ann", "user bob", "user ann"]}, "pseudonymizer", rule("pseudonymizer", pseudonyms={"m": r"user (\w+)"}), pubkey_analyst=str(tmp_path / "a"), pubkey_depseudo=str(tmp_path / "b"))
    assert found["m"][0] == found["m"][2] and [sealing.decrypt(x["origin"], keys[0][0], keys[1][0]) for x in extras] == ["ann", "bob"]


@pytest.mark.parametrize("count", [199, 201, 4999, 5001])
def test_large_lookups(spark, count):
    """On both sides of where a map is a literal; a text that is no key, and a null."""
    table = {f"{i}-x": f"value {i}" for i in range(count)}
    last = {"a": str(count - 1), "b": "x"}
    spec = {"pattern": {"delimiter": "-", "fields": ["a", "b"], "target_field": "b"}, "template": table}
    assert done(spark, last, "template_replacer", rule("template_replacer"), **spec)[0] == last | {"b": f"value {count - 1}"}
    assert done(spark, {"a": "no", "b": "x"}, "template_replacer", rule("template_replacer"), **spec)[0] == {"a": "no", "b": "x"}
    names = [f"n{i}" for i in range(count)]
    listed = rule("list_comparison", source_fields=["a"], target_field="r", lists={"l": names, "few": ["n0"]})
    for value, want in (("n0", {"in_list": ["l", "few"]}), (names[-1], {"in_list": ["l"]}), ("q", {"not_in_list": ["l", "few"]}), (["q", names[-1]], {"in_list": ["l"]})):
        assert done(spark, {"a": value}, "list_comparison", listed)[0] == {"a": value, "r": want}


def test_resolver_with_a_large_file(spark, tmp_path):
    (tmp_path / "map.yml").write_text("".join(f"k{i}: v{i}\n" for i in range(6000)))
    given = rule("generic_resolver", field_mapping={"a": "b"}, resolve_from_file={"path": str(tmp_path / "map.yml"), "pattern": r"to (?P<mapping>\w+)"}, resolve_list={"other": "o"})
    for value, want in (("to k5999", {"b": "v5999"}), ("other", {"b": "o"}), ("to none", {})):
        assert done(spark, {"a": value}, "generic_resolver", given)[0] == {"a": value} | want


def test_many_networks(spark):
    nets = [f"10.{i // 256}.{i % 256}.0/25" for i in range(0, 1000)] + ["2001:db8::/32"]
    given = rule("network_comparison", source_fields=["a"], target_field="r", lists={"l": nets, "m": ["9.0.0.0/8"]})
    for value, want in (("10.3.231.127", {"in_list": ["l"]}), ("10.3.231.128", {"not_in_list": ["l", "m"]}), ("2001:db8:1::", {"in_list": ["l"]}), ("9.9.9.9", {"in_list": ["m"]}), ("2001:db9::", {"not_in_list": ["l", "m"]})):
        assert done(spark, {"a": value}, "network_comparison", given)[0] == {"a": value, "r": want}


def test_lists_whose_place_is_in_the_event(spark, tmp_path):
    for name, lines in (("x", "one\ntwo\n"), ("y", "three\n")):
        (tmp_path / f"list_{name}.txt").write_text(lines)
    given = rule("list_comparison", source_fields=["a"], target_field="r", list_file_paths=["list_${tenant.id}.txt"])
    options = {"list_search_base_path": str(tmp_path)}
    name = "list_${tenant.id}.txt"
    for event, want in (
        ({"a": "one", "tenant": {"id": "x"}}, {"r": {"in_list": [name]}}), ({"a": "one", "tenant": {"id": "y"}}, {"r": {"not_in_list": [name]}}), ({"a": ["q", "three"], "tenant": {"id": "y"}}, {"r": {"in_list": [name]}}),
        ({"a": "one", "tenant": {"id": "z"}}, {"tags": ["_list_comparison_failure"]}), ({"a": "one"}, {"tags": ["_list_comparison_failure"]}),
    ):
        assert done(spark, event, "list_comparison", given, **options)[0] == event | want


def test_files_of_additions_count_more_than_the_rule(spark, tmp_path):
    for i, text in enumerate(("a: file\nb: file\n", '{"b": "second"}')):
        (tmp_path / f"{i}.yml").write_text(text)
    files = [str(tmp_path / f"{i}.yml") for i in range(2)]
    adds = lambda **o: rule("generic_adder", add={"a": "rule", "c": "rule"}, **o)
    assert done(spark, {"x": 1}, "generic_adder", adds(add_from_file=files))[0] == {"x": 1, "a": "file", "b": "second", "c": "rule"}
    assert done(spark, {"x": 1}, "generic_adder", adds(add_from_file=["/none", *files], only_first_existing_file=True))[0] == {"x": 1, "a": "file", "b": "file", "c": "rule"}
    with pytest.raises(RuleError):
        done(spark, {"x": 1}, "generic_adder", adds(add_from_file=["/none", *files]))


def test_merging_and_overwriting_at_once_is_an_error():
    with pytest.raises(RuleError):
        Stage.of("field_manager", rule("field_manager", mapping={"a": "b"}, overwrite_target=True, merge_with_target=True))


def test_rules_of_the_clusterer_follow_one_another(spark):
    rules = [rule("clusterer", source_fields=["message"], target_field="s", pattern=p, repl=r) for p, r in ((r"\d+", ""), (r"(\w+)ing\b", r"\1"), (r"(\w+)", r"<+>\1</+>"))]
    found, _, errors = done(spark, {"message": "walking 12 dogs", "tags": ["clusterable"]}, "clusterer", *rules)
    assert not errors and found == {"message": "walking 12 dogs", "tags": ["clusterable"], "s": "walk dogs"}
    _, _, errors = done(spark, {"message": "a <+>b</+>", "clusterable": True}, "clusterer", rules[0])
    assert errors


def test_substitutions_as_by_a_loop(spark):
    """Against a plain loop, for patterns whose matches fall, rise or stay."""
    import random
    import re

    rnd = random.Random(2)
    texts = ["".join(rnd.choices("ab()x1 ", k=rnd.randrange(30))) for _ in range(150)] + ["(" * 20 + ")" * 20, ""]
    for pattern, new in ((r"\(([^()]*)\)", r"\1"), (r"(\d+)", r"<+>\1</+>"), ("ab", "b"), ("a", "aa"), (r"b(a)", r"\g<1>b")):
        from pyspark.sql import functions as F

        from rillstone.operators.text import substituted

        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
        steps, result = substituted(F.col("t"), pattern, new, "__s")
        for columns in steps:
            df = df.select("*", *(c.alias(n) for n, c in columns.items()))
        found = {r.i: r.x for r in df.select("i", result.alias("x")).collect()}
        for i, t in enumerate(texts):
            t, n = re.subn(pattern, new, t)
            last = n + 1
            while 0 < n < last:
                last = n
                t, n = re.subn(pattern, new, t)
            assert found[i] == t, (pattern, texts[i])


def test_plans_of_the_clusterer_grow_with_its_rules(spark):
    """Each rule goes on with the text of the one before, which must not be written out again for every mention."""
    from rillstone.plans.pipeline import Pipeline

    df = spark.createDataFrame([("walking (12) dogs", True), (None, True), ("x", False)], "message string, clusterable boolean")

    def size(rules: int) -> int:
        given = [rule("clusterer", source_fields=["message"], target_field="s", pattern=p, repl=r) for p, r in [(r"\((\w*)\)", r"\1")] * (rules - 1) + [(r"(\w+)", r"<+>\1</+>")]]
        events = Pipeline.of([("clusterer", given)]).apply(df).events
        if rules == 8:
            assert sorted((r.message or "", r.s or "") for r in events.collect()) == [("", ""), ("walking (12) dogs", "walking 12 dogs"), ("x", "")]
        return events._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")

    one = size(1)
    assert one <= 3 and size(2) <= 2 * one and size(8) <= 8 * one


def test_long_texts_of_the_clusterer(spark):
    """Many rounds with fewer matches each time, and many matches; no text goes through Python."""
    from pyspark.sql import functions as F

    from rillstone.plans.pipeline import Pipeline

    nested = lambda *depths: " ".join("(" * d + f"x{d}" + ")" * d for d in depths)
    for pattern, new, text, want in ((r"\((\w+)\)", r"<+>\1</+>", "(a) (b)", "a b"), (r"\((\w+)\)", r"\1", nested(*range(60)), None), (r"\d+", "<+>n</+>", "a1 " * 60000, " ".join("n" * 60000))):
        given = rule("clusterer", source_fields=["message"], target_field="s", pattern=pattern, repl=new)
        after = rule("clusterer", source_fields=["message"], target_field="s", pattern=r"^(\w[^()<>]*)$", repl=r"<+>\1</+>")
        df = spark.createDataFrame([(text,)], "message string").select("message", F.lit(True).alias("clusterable"))
        events = Pipeline.of([("clusterer", [given] if want else [given, after])]).apply(df).events
        assert "Python" not in events._jdf.queryExecution().optimizedPlan().toString()
        assert events.first().s == (want or " ".join(f"x{d}" for d in range(60)))


def test_plans_of_the_calculator_grow_with_the_expression(spark):
    """Each sum is tested for being finite, and mustn't be written out for every mention."""
    from rillstone.plans.pipeline import Pipeline

    df = spark.createDataFrame([(0.5, 2), (1e308, 2), (None, 2), (-1.5, -(2**63))], "a double, n long")

    def events(calc: str):
        return Pipeline.of([("calculator", rule("calculator", calc=calc, target_field="r"))]).apply(df).events

    size = lambda terms: events(" + ".join(["${a} * ${n}"] * terms))._jdf.queryExecution().optimizedPlan().toString().count("isnan(")
    assert 1 <= size(1) <= 2 and size(4) <= 8
    assert size(12) <= 24
    for calc, want in ((" + ".join(["${a} * ${n}"] * 12), [12.0, None, None, -1.5 * -(2.0**63) * 12]), ("(2 ^ ${n}) ^ 2 + sgn(${a}) + abs(${n}) - -${n}", [16 + 1 + 2 + 2, 16 + 1 + 2 + 2, None, None])):
        found = events(calc).collect()
        assert [r.r for r in found] == want and [r.tags for r in found] == [["_calculator_failure"] if w is None and r.a is not None else ["_calculator_missing_field_warning"] if r.a is None else None for r, w in zip(found, want)]


def test_merging_fields_into_fields(spark):
    given = rule("field_manager", source_fields=["a"], target_field="b", merge_with_target=True)
    event = {"a": {"x": 1, "y": {"q": 2}}, "b": {"x": 0, "z": 3}}
    assert done(spark, event, "generic_adder", rule("generic_adder", add={"n": 1}))[0] == event | {"n": 1}
    from pyspark.sql import functions as F

    from rillstone.plans.frame import Effect, Frame, Write
    from rillstone.sources.events import in_memory

    frame = Frame.of(in_memory(spark, [event]))
    row = frame.apply(Effect(writes=[Write("b", frame.get("a"), "merge")]), F.lit(True)).nested().toJSON().first()
    assert json.loads(row)["b"] == {"x": 1, "y": {"q": 2}, "z": 3} and given["field_manager"]["merge_with_target"]


def test_pseudonyms_in_urls(spark):
    import hashlib

    mark = lambda x: f"<pseudonym:{hashlib.sha256((x + 's').encode()).hexdigest()}>"
    given = rule("pseudonymizer", pseudonyms={"u": "(.*)"}, url_fields=["u"])
    for url, want in (
        ("https://www.example.com/a/b?k=v&k=w#frag", f"https://{mark('www')}.example.com/{mark('a/b')}?k={mark('v')}&k={mark('w')}#{mark('frag')}"),
        ("example.com", "example.com"), ("http://me:pw@example.com", f"http://{mark('me:pw')}@example.com"), ("no address", mark("no address")),
    ):
        found, extras, _ = done(spark, {"u": url}, "pseudonymizer", given, hash_salt="s")
        assert found == {"u": want} and len(extras) == want.count("<pseudonym:")


def test_patterns_from_a_folder(spark, tmp_path):
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "own").write_text("# ours\nTICKET T-%{INT}\n")
    found = done(spark, {"m": "see T-12"}, "grokker", rule("grokker", mapping={"m": "see %{TICKET:t}"}), custom_patterns_dir=str(tmp_path))[0]
    assert found == {"m": "see T-12", "t": "T-12"}
