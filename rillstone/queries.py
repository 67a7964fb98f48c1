"""Queries of the event operators on the driver's tables, with the same in SQL. Lists are shown as joined text."""

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import Stage
from .operators.lookups import keyed_list_comparison
from .plans import filters
from .plans.frame import Frame
from .plans.pipeline import Pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, function: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = function
    if sql is not None:
        SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(name: str, source: str, columns: list[str], stages: list[tuple], sql: str, finish: list[str], before: dict[str, str] | None = None, which: str = "events", **options) -> None:
    """A query that runs stages over some columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(*columns, *(F.expr(e).alias(n) for n, e in (before or {}).items()))
        pipeline = Pipeline.of([Stage.of(kind, rules, **options) for kind, rules in stages])
        return getattr(pipeline.apply(df), which).selectExpr(*finish)

    add(name, sql, run)


def filtered(name: str, source: str, columns: str, text: str, where: str, **options) -> None:
    """A query that counts nothing and keeps the rows that a filter matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(*columns.split(", "))
        frame = Frame.of(df)
        return frame.df.where(filters.to_column(filters.parse(text, **options), frame.look)).select(*columns.split(", "))

    add(name, f"SELECT {columns} FROM {source} WHERE {where}", run)


filtered("filter_equality", "events", "event_id, event_type, user_id", "event_type: error AND NOT user_id: 8", "event_type = 'error' AND user_id <> 8")
filtered("filter_or_group", "events", "event_id, event_type", "event_type: (click OR error)", "event_type IN ('click', 'error')")
filtered("filter_integer_range", "lineitem", "l_orderkey, l_linenumber", "l_linenumber: [2 TO 4] AND NOT l_linenumber: {2 TO 4}", "l_linenumber BETWEEN 2 AND 4 AND NOT (l_linenumber > 2 AND l_linenumber < 4)")
filtered("filter_float_range", "lineitem", "l_orderkey, l_linenumber, l_quantity", "l_quantity: {10.0 TO 20.0}", "l_quantity > 10 AND l_quantity < 20")
filtered("filter_string_range", "customer", "c_custkey, c_mktsegment", "c_mktsegment: [AUTO TO C]", "c_mktsegment >= 'AUTO' AND c_mktsegment <= 'C'")
filtered("filter_regex", "part", "p_partkey, p_type", "p_type: /ECON.*/", "regexp_full_match(p_type, 'ECON.*')")
filtered("filter_regex_modifier", "part", "p_partkey, p_brand", 'p_brand|re: "Brand#[1-3].*"', "regexp_full_match(p_brand, 'Brand#[1-3].*')")
filtered("filter_wildcard", "part", "p_partkey, p_name", 'p_name: "*D w?DGET"', "regexp_full_match(p_name, '.*d w.?dget', 'i')", like_keys=("p_name",))
filtered("filter_exists_and_missing", "orders", "o_orderkey, o_orderstatus", "o_orderstatus AND NOT nothing", "o_orderstatus IS NOT NULL")
filtered("filter_float_text", "lineitem", "l_orderkey, l_linenumber, l_quantity, l_discount", "l_quantity: 17.0 OR l_discount: 0.05", "l_quantity = 17 OR l_discount = 0.05")

staged("generic_adder", "events", ["event_id", "event_type", "user_id"], [("generic_adder", {"filter": "event_type: error AND NOT user_id: 8", "generic_adder": {"add": {"alert.level": "high", "event_type": "never"}}})],
       "SELECT event_id, CASE WHEN event_type = 'error' AND user_id <> 8 THEN 'high' END AS level, CASE WHEN event_type = 'error' AND user_id <> 8 THEN '_generic_adder_failure' ELSE '' END AS tags FROM events",
       ["event_id", "alert.level AS level", "array_join(coalesce(tags, array()), ',') AS tags"])
staged("field_manager_move", "customer", ["c_custkey", "c_name", "c_mktsegment"], [("field_manager", {"filter": "c_mktsegment: BUILDING", "field_manager": {"mapping": {"c_name": "customer.name"}, "delete_source_fields": True}})],
       "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END AS moved FROM customer",
       ["c_custkey", "c_name", "customer.name AS moved"])
staged("field_manager_merge", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], [("field_manager", {"filter": "*", "field_manager": {"source_fields": ["l_returnflag", "l_linestatus"], "target_field": "flags"}})],
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = l_linestatus THEN l_returnflag ELSE l_returnflag || ',' || l_linestatus END AS flags FROM lineitem",
       ["l_orderkey", "l_linenumber", "array_join(coalesce(flags, array()), ',') AS flags"])
staged("dropper", "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"], [("dropper", {"filter": "o_orderstatus: F", "dropper": {"drop": ["o_orderpriority"]}})],
       "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders", ["o_orderkey", "o_orderpriority"])
staged("deleter", "events", ["event_id", "event_type"], [("deleter", {"filter": "event_type: click", "deleter": {"delete": True}})],
       "SELECT event_id, event_type FROM events WHERE event_type <> 'click'", ["event_id", "event_type"])
staged("concatenator", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], [("concatenator", {"filter": "*", "concatenator": {"source_fields": ["l_returnflag", "l_linestatus"], "target_field": "joined", "separator": "-"}})],
       "SELECT l_orderkey, l_linenumber, concat_ws('-', l_returnflag, l_linestatus) AS joined FROM lineitem", ["l_orderkey", "l_linenumber", "joined"])
staged("string_splitter_deduplicator", "documents", ["doc_id", "text"], [("string_splitter", {"filter": "text", "string_splitter": {"source_fields": ["text"], "target_field": "words"}}), ("deduplicator", {"filter": "*", "deduplicator": {"source_fields": ["words"]}})],
       "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n, len(list_distinct(string_split(text, ' ')))::BIGINT AS different FROM documents",
       ["doc_id", "cast(size(split(text, ' ', -1)) as bigint) AS n", "cast(size(words) as bigint) AS different"])
staged("key_checker", "events", ["event_id", "event_type"], [("key_checker", {"filter": "*", "key_checker": {"source_fields": ["event_type", "b.c", "a"], "target_field": "missing"}})],
       "SELECT event_id, 'a,b.c' AS missing FROM events", ["event_id", "array_join(coalesce(missing, array()), ',') AS missing"], before={"only": "CASE WHEN event_type = 'error' THEN 'x' END"})
staged("labeler", "events", ["event_id", "event_type"], [("labeler", [{"filter": "event_type: error", "labeler": {"label": {"action": ["failed", "alert"]}}}, {"filter": "event_type: (error OR click)", "labeler": {"label": {"action": ["seen"]}}}])],
       "SELECT event_id, CASE event_type WHEN 'error' THEN 'alert,failed,seen' WHEN 'click' THEN 'seen' ELSE '' END AS action FROM events",
       ["event_id", "array_join(coalesce(label.action, array()), ',') AS action"])
staged("dissector", "customer", ["c_custkey", "c_name"], [("dissector", {"filter": "c_name", "dissector": {"mapping": {"c_name": "%{kind}#%{number|int}"}}})],
       "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2)::BIGINT AS number FROM customer", ["c_custkey", "kind", "number"])
staged("dissector_append", "orders", ["o_orderkey", "o_orderpriority"], [("dissector", {"filter": "*", "dissector": {"mapping": {"o_orderpriority": "%{b}-%{+(/)b}"}}})],
       "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) || '/' || CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) ELSE '' END AS b FROM orders", ["o_orderkey", "b"])
staged("grokker", "pages", ["page_id", "url"], [("grokker", {"filter": "url", "grokker": {"mapping": {"url": "%{URIPROTO:scheme}://%{HOSTNAME:host}/%{WORD:section}%{GREEDYDATA:rest}"}}})],
       r"SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([0-9A-Za-z][0-9A-Za-z_-]*(?:\.[0-9A-Za-z][0-9A-Za-z_-]*)*)/([0-9A-Za-z_]+)(.*)$', 1), '') AS scheme, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([0-9A-Za-z][0-9A-Za-z_-]*(?:\.[0-9A-Za-z][0-9A-Za-z_-]*)*)/([0-9A-Za-z_]+)(.*)$', 2), '') AS host, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([0-9A-Za-z][0-9A-Za-z_-]*(?:\.[0-9A-Za-z][0-9A-Za-z_-]*)*)/([0-9A-Za-z_]+)(.*)$', 3), '') AS section FROM pages",
       ["page_id", "scheme", "host", "section"])
staged("decoder_json", "events", ["event_id", "props"], [("decoder", {"filter": "props", "decoder": {"mapping": {"props": "decoded"}, "source_format": "json"}})],
       "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events", ["event_id", "cast(decoded['k'] as bigint) AS k"])
staged("decoder_base64", "nation", ["n_nationkey"], [("decoder", {"filter": "coded", "decoder": {"mapping": {"coded": "plain"}, "source_format": "base64"}})],
       "SELECT n_nationkey, n_name AS plain FROM nation", ["n_nationkey", "plain"], before={"coded": "base64(n_name)"})
staged("calculator", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"], [("calculator", {"filter": "*", "calculator": {"calc": "${l_extendedprice} * (1 - ${l_discount})", "target_field": "net"}})],
       "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", ["l_orderkey", "l_linenumber", "net"])
staged("calculator_whole_numbers", "lineitem", ["l_orderkey", "l_linenumber"], [("calculator", {"filter": "*", "calculator": {"calc": "${l_linenumber} ^ 2 + round(7 / 2) - abs(-${l_linenumber})", "target_field": "r"}})],
       "SELECT l_orderkey, l_linenumber, (l_linenumber::BIGINT * l_linenumber + 4 - l_linenumber)::BIGINT AS r FROM lineitem", ["l_orderkey", "l_linenumber", "r"])
staged("timestamper", "orders", ["o_orderkey"], [("timestamper", {"filter": "*", "timestamper": {"source_fields": ["raw"], "target_field": "at", "source_format": ["ISO8601", "%d.%m.%Y %H:%M"], "source_timezone": "UTC", "target_timezone": "UTC"}})],
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:00Z') AS at FROM orders", ["o_orderkey", "at"], before={"raw": "date_format(o_orderdate, 'dd.MM.yyyy HH:mm')"})
staged("timestamp_differ", "orders", ["o_orderkey"], [("timestamp_differ", {"filter": "*", "timestamp_differ": {"diff": "${a:ISO8601} - ${b:%Y-%m-%d}", "target_field": "span"}})],
       "SELECT o_orderkey, (epoch(date_trunc('day', o_orderdate)) - epoch(TIMESTAMP '1992-01-01'))::BIGINT::VARCHAR || '.0' AS span FROM orders", ["o_orderkey", "span"], before={"a": "date_format(o_orderdate, 'yyyy-MM-dd')", "b": "'1992-01-01'"})
staged("datetime_extractor", "orders", ["o_orderkey"], [("datetime_extractor", {"filter": "*", "datetime_extractor": {"source_fields": ["raw"], "target_field": "t"}})],
       "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayname(o_orderdate) AS weekday, 'UTC' AS zone FROM orders",
       ["o_orderkey", "t.year AS y", "t.month AS m", "t.day AS d", "t.weekday AS weekday", "t.timezone AS zone"], before={"raw": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"})
staged("list_comparison", "customer", ["c_custkey", "c_mktsegment"], [("list_comparison", {"filter": "*", "list_comparison": {"source_fields": ["c_mktsegment"], "target_field": "r", "lists": {"a": ["BUILDING", "MACHINERY"], "b": ["BUILDING"]}}})],
       "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'a,b' WHEN 'MACHINERY' THEN 'a' ELSE '' END AS inside, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '' ELSE 'a,b' END AS outside FROM customer",
       ["c_custkey", "array_join(coalesce(r.in_list, array()), ',') AS inside", "array_join(coalesce(r.not_in_list, array()), ',') AS outside"])
staged("generic_resolver", "nation", ["n_nationkey", "n_name"], [("generic_resolver", {"filter": "n_name", "generic_resolver": {"field_mapping": {"n_name": "group"}, "resolve_list": {"_1\\d?$": "ones", "\\d": "others"}}})],
       "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '_1[0-9]?$') THEN 'ones' WHEN regexp_matches(n_name, '[0-9]') THEN 'others' END AS grp FROM nation", ["n_nationkey", "group AS grp"])
staged("template_replacer", "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"], [("template_replacer", {"filter": "*", "template_replacer": {"pattern": {"delimiter": "-", "fields": ["l_returnflag", "l_linestatus"], "target_field": "meaning"}, "template": {"A-F": "accepted", "R-F": "returned", "N-O": "new"}}})],
       "SELECT l_orderkey, l_linenumber, m AS meaning FROM lineitem LEFT JOIN (VALUES ('A','F','accepted'),('R','F','returned'),('N','O','new')) v(a, b, m) ON a = l_returnflag AND b = l_linestatus", ["l_orderkey", "l_linenumber", "meaning"])
staged("network_comparison", "events", ["event_id"], [("network_comparison", {"filter": "*", "network_comparison": {"source_fields": ["ip"], "target_field": "r", "lists": {"low": ["10.0.0.0/25"], "all": ["10.0.0.0/8", "2001:db8::/32"]}}})],
       "SELECT event_id, CASE WHEN user_id % 256 < 128 THEN 'low,all' ELSE 'all' END AS inside FROM events", ["event_id", "array_join(r.in_list, ',') AS inside"], before={"ip": "concat('10.0.0.', cast(user_id % 256 as string))"})
staged("ip_informer", "events", ["event_id"], [("ip_informer", {"filter": "*", "ip_informer": {"source_fields": ["ip"], "target_field": "r", "properties": ["version", "is_private", "is_loopback"]}})],
       "SELECT event_id, user_id % 2 = 0 AS private, false AS loopback, 4::BIGINT AS version FROM events",
       ["event_id", "r[ip].is_private AS private", "r[ip].is_loopback AS loopback", "r[ip].version AS version"], before={"ip": "concat(if(user_id % 2 = 0, '10', '8'), '.8.8.', cast(user_id % 200 as string))"})
staged("geoip_enricher", "events", ["event_id"], [("geoip_enricher", {"filter": "*", "geoip_enricher": {"source_fields": ["ip"]}})],
       "SELECT event_id, CASE WHEN user_id % 256 < 64 THEN 'North' WHEN user_id % 256 BETWEEN 100 AND 199 THEN 'South' END AS country FROM events", ["event_id", "geoip.properties.country AS country"],
       before={"ip": "concat('10.0.0.', cast(user_id % 256 as string))"}, ranges=[{"start": "10.0.0.0", "end": "10.0.0.63", "country": "North", "longitude": "1.5", "latitude": "2.5"}, {"start": "10.0.0.100", "end": "10.0.0.199", "country": "South"}])
staged("domain_label_extractor", "pages", ["page_id", "url"], [("domain_label_extractor", {"filter": "url", "domain_label_extractor": {"source_fields": ["url"], "target_field": "d"}})],
       r"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#:]*)', 1)) AS host FROM pages), e AS (SELECT page_id, regexp_extract(host, '^(?:(.*)\.)?([^.]+\.(com|org|net|edu|gov|de|example|test))$', ['sub', 'dom', 'tld']) AS x FROM h) SELECT page_id, nullif(x.dom, '') AS domain, nullif(x.tld, '') AS suffix FROM e",
       ["page_id", "d.registered_domain AS domain", "d.top_level_domain AS suffix"])
staged("pseudonymizer", "events", ["event_id"], [("pseudonymizer", {"filter": "*", "pseudonymizer": {"pseudonyms": {"user": "RE_WHOLE"}}})],
       "SELECT event_id, '<pseudonym:' || sha256(user_id::VARCHAR || 'salt') || '>' AS \"user\" FROM events", ["event_id", "user"], before={"user": "cast(user_id as string)"}, regex_mapping={"RE_WHOLE": "(.*)"}, hash_salt="salt")
staged("pre_detector_records", "events", ["event_id", "event_type"], [("pre_detector", {"filter": "event_type: error", "pre_detector": {"id": "r1", "title": "an error", "severity": "high", "mitre": ["a", "b"], "case_condition": "directly", "copy_fields_to_detection_event": ["event_id"]}})],
       "SELECT 'detections' AS output, event_id, 'an error' AS title FROM events WHERE event_type = 'error'", ["output", "cast(get_json_object(doc, '$.event_id') as bigint) AS event_id", "get_json_object(doc, '$.title') AS title"],
       which="extras", outputs=[{"detections": "alerts"}])
staged("selective_extractor", "events", ["event_id", "event_type", "user_id"], [("selective_extractor", {"filter": "event_type: click", "selective_extractor": {"source_fields": ["event_id", "user_id"], "outputs": [{"kafka": "extract"}]}})],
       "SELECT event_id, user_id, 'extract' AS target FROM events WHERE event_type = 'click'", ["cast(get_json_object(doc, '$.event_id') as bigint) AS event_id", "cast(get_json_object(doc, '$.user_id') as bigint) AS user_id", "target"], which="extras")
staged("replacer", "customer", ["c_custkey", "c_name"], [("replacer", {"filter": "c_name", "replacer": {"mapping": {"c_name": "Customer#%{*:anonymous}"}}})],
       "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN 'Customer#anonymous' ELSE c_name END AS c_name FROM customer", ["c_custkey", "c_name"])
staged("clusterer", "documents", ["doc_id"], [("clusterer", {"filter": "message", "clusterer": {"source_fields": ["message"], "target_field": "signature", "pattern": "\\d+", "repl": "<+>number</+>"}})],
       "SELECT doc_id, CASE WHEN n > 0 THEN repeat('number ', n - 1) || 'number' ELSE '' END AS signature FROM (SELECT doc_id, len(regexp_extract_all(text, '\\d+')) AS n FROM documents)",
       ["doc_id", "signature"], before={"message": "text", "clusterable": "true"})
staged("clusterer_repeated", "events", ["event_id"], [("clusterer", [{"filter": "message", "clusterer": {"source_fields": ["message"], "target_field": "signature", "pattern": "\\((\\w*)\\)", "repl": "\\1"}}, {"filter": "message", "clusterer": {"source_fields": ["message"], "target_field": "signature", "pattern": "(\\w+)", "repl": "<+>\\1</+>"}}])],
       "SELECT event_id, event_type || ' ' || event_type || 'b' AS signature FROM events",
       ["event_id", "signature"], before={"message": "concat(repeat('(', cast(user_id % 9 as int)), event_type, repeat(')', cast(user_id % 9 as int)), ' ((', event_type, '))b')", "clusterable": "true"})
staged("requester", "region", ["r_regionkey", "r_name"], [("requester", {"filter": "*", "requester": {"url": "http://service/${r_name}", "method": "GET", "target_field": "answer"}})],
       "SELECT r_regionkey, 'GET http://service/' || r_name AS answer FROM region", ["r_regionkey", "answer"], caller=lambda r: (200, f"{r['method']} {r['url']}"))
staged("domain_resolver", "pages", ["page_id", "url"], [("domain_resolver", {"filter": "url", "domain_resolver": {"source_fields": ["url"], "target_field": "ip"}})],
       r"SELECT page_id, CASE WHEN h <> '' THEN '10.0.0.' || (length(h) % 256)::VARCHAR END AS ip FROM (SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^@/?#]*@)?([^/?#:]*)', 1)) AS h FROM pages)",
       ["page_id", "ip"], resolver=lambda name: f"10.0.0.{len(name) % 256}")
staged("amides", "part", ["p_partkey", "p_type"], [("amides", {"filter": "p_type", "amides": {"source_fields": ["p_type"]}})],
       "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 0.881::DOUBLE ELSE 0.119::DOUBLE END AS confidence FROM part", ["p_partkey", "amides.confidence AS confidence"],
       model={"misuse": {"idf": {"economy": 2.0}, "weights": {"economy": 4.0}, "bias": -2.0, "threshold": 0.5}})

staged("decoder_logfmt", "orders", ["o_orderkey"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "logfmt"}})],
       "SELECT o_orderkey, o_orderstatus AS status, 'a ' || o_orderpriority AS priority FROM orders", ["o_orderkey", "d['status'] AS status", "d['priority'] AS priority"], before={"line": "concat('status=', o_orderstatus, ' priority=\"a ', o_orderpriority, '\" done')"})
staged("decoder_syslog", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "syslog_rfc3164"}})],
       "SELECT event_id, '13' AS pri, event_type AS ident, user_id::VARCHAR AS pid, 'value ' || event_id::VARCHAR AS message FROM events", ["event_id", "d.pri AS pri", "d.ident AS ident", "d.pid AS pid", "d.message AS message"],
       before={"line": "concat('<13>Oct 11 22:14:15 box ', event_type, '[', user_id, ']: value ', event_id)"})
staged("decoder_cri", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "cri"}})],
       "SELECT event_id, 'stdout' AS stream, event_type || ' x' AS message FROM events", ["event_id", "d.stream AS stream", "d.message AS message"], before={"line": "concat('2020-01-01T00:00:00Z stdout F ', event_type, ' x')"})
staged("decoder_failure_tags", "events", ["event_id"], [("decoder", {"filter": "coded", "decoder": {"mapping": {"coded": "plain"}, "source_format": "base64"}})],
       "SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS plain, CASE WHEN event_type = 'error' THEN '_decoder_failure' ELSE '' END AS tags FROM events",
       ["event_id", "plain", "array_join(coalesce(tags, array()), ',') AS tags"], before={"coded": "if(event_type = 'error', '?', base64(event_type))"})
staged("decoder_clf", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "clf"}})],
       "SELECT event_id, '10.0.0.' || (user_id % 256)::VARCHAR AS host, 'GET /' || event_type || ' HTTP/1.0' AS request_line, '200' AS status, event_id::VARCHAR AS bytes FROM events", ["event_id", "d.host AS host", "d.request_line AS request_line", "d.status AS status", "d.bytes AS bytes"],
       before={"line": "concat('10.0.0.', user_id % 256, ' - joe [10/Oct/2000:13:55:36 -0700] \"GET /', event_type, ' HTTP/1.0\" 200 ', event_id)"})
staged("decoder_nginx", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "nginx"}})],
       "SELECT event_id, '10.0.0.1' AS host, '/' || event_type AS path, CASE WHEN event_id % 2 = 0 THEN '1.5' END AS gzip_ratio, 'an agent' AS agent FROM events", ["event_id", "d.host AS host", "d.path AS path", "d.gzip_ratio AS gzip_ratio", "d.agent AS agent"],
       before={"line": "if(event_id % 2 = 0, concat('10.0.0.1 - u [t o] 200 \"GET /', event_type, ' HTTP/1.1\" 7 \"r\" \"an agent\" \"1.5\"'), concat('10.0.0.1 - u [t o] \"GET /', event_type, ' HTTP/1.1\" 200 7 \"r\" \"an agent\"'))"})
staged("decoder_syslog_local", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "syslog_rfc3164_local"}})],
       "SELECT event_id, '13' AS pri, event_type AS ident, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS pid, 'value ' || event_id::VARCHAR AS message FROM events", ["event_id", "d.pri AS pri", "d.ident AS ident", "d.pid AS pid", "d.message AS message"],
       before={"line": "concat('<13>Oct 11 22:14:15 ', event_type, if(user_id % 2 = 0, concat('[', user_id, ']'), ''), ': value ', event_id)"})
staged("decoder_syslog_rfc5424", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "syslog_rfc5424"}})],
       "SELECT event_id, event_type AS ident, user_id::VARCHAR AS pid, '[a b=\"1\"]' AS extradata, 'value' AS message FROM events", ["event_id", "d.ident AS ident", "d.pid AS pid", "d.extradata AS extradata", "d.message AS message"],
       before={"line": "concat('<13>1 2003-10-11T22:14:15.003Z box ', event_type, ' ', user_id, ' ID1 [a b=\"1\"] value')"})
staged("decoder_docker", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "docker"}})],
       "SELECT event_id, event_type AS output, 'stderr' AS stream FROM events", ["event_id", "d.output AS output", "d.stream AS stream"], before={"line": "concat('{\"log\": \"', event_type, '\", \"stream\": \"stderr\", \"time\": \"t\"}')"})
staged("decoder_decolorize", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "decolorize"}})],
       "SELECT event_id, event_type || ' plain' AS text FROM events", ["event_id", "d AS text"], before={"line": "concat(chr(27), '[1;31m', event_type, chr(27), '[0m plain')"})
staged("decoder_json_array", "events", ["event_id"], [("decoder", {"filter": "line", "decoder": {"mapping": {"line": "d"}, "source_format": "json", "schema": "array<bigint>"}})],
       "SELECT event_id, event_id + user_id AS total, CASE WHEN event_id % 3 = 0 THEN '_decoder_failure' ELSE '' END AS tags FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN user_id END AS user_id FROM events)", ["event_id", "d[0] + d[1] AS total", "array_join(coalesce(tags, array()), ',') AS tags"],
       before={"line": "concat('[', event_id, ',', user_id, if(event_id % 3 = 0, '', ']'))"})
staged("calculator_comparison", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [("calculator", {"filter": "*", "calculator": {"calc": "${l_quantity} >= 10 * ${l_linenumber}", "target_field": "r"}})],
       "SELECT l_orderkey, l_linenumber, l_quantity >= 10 * l_linenumber AS r FROM lineitem", ["l_orderkey", "l_linenumber", "r"])
staged("calculator_functions", "lineitem", ["l_orderkey", "l_linenumber", "l_discount"], [("calculator", {"filter": "*", "calculator": {"calc": "trunc(${l_discount} * 100 + 0.5) + sgn(${l_linenumber} - 3) + multiply(2, ${l_linenumber}) + hypot(3, 4) + from_hex(ff)", "target_field": "r"}})],
       "SELECT l_orderkey, l_linenumber, trunc(l_discount * 100 + 0.5) + sign(l_linenumber - 3) + 2 * l_linenumber + 5.0::DOUBLE + 255 AS r FROM lineitem", ["l_orderkey", "l_linenumber", "r"])
staged("calculator_two_rounds", "lineitem", ["l_orderkey", "l_linenumber"], [("calculator", {"filter": "*", "calculator": {"calc": "round(${a}, 1) * 1000 + round(${b}, 2)", "target_field": "r"}})],
       "SELECT l_orderkey, l_linenumber, round(l_linenumber + 0.26, 1)::DOUBLE * 1000 + round(l_linenumber + 0.344, 2)::DOUBLE AS r FROM lineitem", ["l_orderkey", "l_linenumber", "r"], before={"a": "cast(l_linenumber + 0.26 as double)", "b": "cast(l_linenumber + 0.344 as double)"})
staged("dissector_kinds", "events", ["event_id"], [("dissector", {"filter": "line", "dissector": {"mapping": {"line": "%{flag|bool} %{}:%{number|float}"}}})],
       "SELECT event_id, event_id % 2 = 0 AS flag, user_id + 0.5::DOUBLE AS number FROM events", ["event_id", "flag", "number"], before={"line": "concat(if(event_id % 2 = 0, 'yes', 'no'), ' skipped:', user_id, '.5')"})
staged("dissector_order_and_strip", "orders", ["o_orderkey"], [("dissector", {"filter": "line", "dissector": {"mapping": {"line": "%{+x/2} %{+x/1} %{y-(.)}"}}})],
       "SELECT o_orderkey, o_orderstatus || o_orderkey::VARCHAR AS x, o_orderpriority AS y FROM orders", ["o_orderkey", "x", "y"], before={"line": "concat(o_orderkey, ' ', o_orderstatus, ' ', o_orderpriority, '...')"})
staged("regex_fields", "part", ["p_partkey", "p_type"], [("generic_adder", {"filter": 'p_type: "ECON.*"', "regex_fields": ["p_type"], "generic_adder": {"add": {"hit": "yes"}}})],
       "SELECT p_partkey, CASE WHEN regexp_full_match(p_type, 'ECON.*') THEN 'yes' END AS hit FROM part", ["p_partkey", "hit"])
TEN_THOUSAND = {f"{i}": f"customer {i}" for i in range(0, 20000, 2)}
staged("template_replacer_large", "orders", ["o_orderkey", "o_custkey"], [("template_replacer", {"filter": "*", "template_replacer": {"pattern": {"delimiter": "-", "fields": ["customer"], "target_field": "name"}, "template": TEN_THOUSAND}})],
       "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey < 20000 THEN 'customer ' || o_custkey::VARCHAR END AS name FROM orders", ["o_orderkey", "name"], before={"customer": "cast(o_custkey as string)"})
staged("list_comparison_large", "orders", ["o_orderkey"], [("list_comparison", {"filter": "*", "list_comparison": {"source_fields": ["customer"], "target_field": "r", "lists": {"even": list(TEN_THOUSAND), "few": ["1", "2"]}}})],
       "SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 2 = 0 AND o_custkey < 20000 THEN 'even' END, CASE WHEN o_custkey IN (1, 2) THEN 'few' END) AS inside FROM orders", ["o_orderkey", "array_join(coalesce(r.in_list, array()), ',') AS inside"], before={"customer": "cast(o_custkey as string)"})
#: An address of version 6 for any user; numbers of more than four hexadecimal digits take more groups, as five in one aren't an address.
SIX = "lower(concat('2001:db8::', if(user_id between 0 and 65535, '', concat_ws(':', hex(shiftrightunsigned(user_id, 48)), hex(shiftright(user_id, 32) & 65535), hex(shiftright(user_id, 16) & 65535), '')), hex(user_id & 65535)))"
staged("network_comparison_large", "events", ["event_id"], [("network_comparison", {"filter": "*", "network_comparison": {"source_fields": ["ip"], "target_field": "r", "lists": {"even": [f"10.0.{i}.0/24" for i in range(0, 256, 2)] + [f"10.1.{i}.0/24" for i in range(0, 256, 2)], "six": ["2001:db8::/32"]}}})],
       "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'six' WHEN user_id % 2 = 0 THEN 'even' ELSE '' END AS inside FROM events", ["event_id", "array_join(coalesce(r.in_list, array()), ',') AS inside"], before={"ip": f"if(event_id % 4 = 0, {SIX}, concat('10.1.', user_id % 256, '.7'))"})
staged("geoip_enricher_six", "events", ["event_id"], [("geoip_enricher", {"filter": "*", "geoip_enricher": {"source_fields": ["ip"], "target_field": "place"}})],
       "SELECT event_id, CASE WHEN user_id < 64 THEN 'North' END AS country FROM events", ["event_id", "place.properties.country AS country"],
       before={"ip": SIX}, ranges=[{"start": "2001:db8::", "end": "2001:db8::3f", "country": "North"}, {"start": "10.0.0.0", "end": "10.0.0.9", "country": "South"}])
staged("pseudonymizer_parts", "events", ["event_id"], [("pseudonymizer", {"filter": "*", "pseudonymizer": {"pseudonyms": {"line": r"(?:user|friend) (\w+)"}}})],
       "SELECT event_id, 'user <pseudonym:' || sha256('u' || user_id::VARCHAR || 'salt') || '> and friend <pseudonym:' || sha256('f' || event_type || 'salt') || '>' AS line FROM events", ["event_id", "line"], before={"line": "concat('user u', user_id, ' and friend f', event_type)"}, hash_salt="salt")
staged("amides_attribution", "part", ["p_partkey", "p_type"], [("amides", {"filter": "p_type", "amides": {"source_fields": ["p_type"]}})],
       "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'first,second' ELSE '' END AS rules FROM part", ["p_partkey", "array_join(coalesce(transform(amides.attributions, x -> x.rule), array()), ',') AS rules"],
       model={"misuse": {"idf": {"economy": 2.0}, "weights": {"economy": 4.0}, "bias": -2.0, "threshold": 0.5}, "attribution": {"second": {"idf": {"economy": 1.0}, "weights": {}, "bias": 0.0}, "first": {"idf": {"economy": 1.0}, "weights": {"economy": 1.0}, "bias": 0.0}}})


def adder_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file says counts more than what the rule says."""
    with tempfile.NamedTemporaryFile("w", suffix=".yml") as f:  # read on the driver while the rule is compiled
        f.write("level: file\nmore: 7\n")
        f.flush()
        stage = Stage.of("generic_adder", {"filter": "event_type: error", "generic_adder": {"add": {"level": "rule", "other": "rule"}, "add_from_file": [f.name]}})
        return Pipeline.of([stage]).apply(table(spark, sf_dir, "events").select("event_id", "event_type")).events.select("event_id", "level", "other", "more")


add("generic_adder_from_file", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'file' END AS level, CASE WHEN event_type = 'error' THEN 'rule' END AS other, CASE WHEN event_type = 'error' THEN 7::BIGINT END AS more FROM events", adder_from_file)
staged("timestamper_unix", "events", ["event_id"], [("timestamper", {"filter": "*", "timestamper": {"source_fields": ["raw"], "source_format": "UNIX", "target_field": "at"}})],
       "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events", ["event_id", "at"], before={"raw": "cast(unix_seconds(cast(ts as timestamp)) as string)"})
staged("rules_in_tree_order", "events", ["event_id", "event_type", "user_id"], [("generic_adder", [{"filter": "user_id: [0 TO 20]", "generic_adder": {"add": {"first": "by user"}}}, {"filter": "event_type: (error OR click)", "generic_adder": {"add": {"first": "by type"}}}])],
       "SELECT event_id, CASE WHEN user_id BETWEEN 0 AND 20 THEN 'by user' WHEN event_type IN ('error', 'click') THEN 'by type' END AS first, CASE WHEN user_id BETWEEN 0 AND 20 AND event_type IN ('error', 'click') THEN '_generic_adder_failure' ELSE '' END AS tags FROM events",
       ["event_id", "first", "array_join(coalesce(tags, array()), ',') AS tags"])
staged("apply_multiple_times", "events", ["event_id", "event_type"], [("generic_adder", [{"filter": "event_type: error", "generic_adder": {"add": {"a": "1"}}}, {"filter": "a", "generic_adder": {"add": {"b": "2"}}}, {"filter": "b", "generic_adder": {"add": {"c": "3"}}}])],
       "SELECT event_id, CASE WHEN event_type = 'error' THEN '123' ELSE '' END AS abc FROM events", ["event_id", "concat_ws('', a, b, c) AS abc"], apply_multiple_times=True)
staged("failed_events", "events", ["event_id", "event_type", "user_id"], [("concatenator", {"filter": "event_type: error", "concatenator": {"source_fields": ["event_type", "user_id"], "target_field": "x"}})],
       "SELECT event_id, 'user_id isn''t text' AS errors FROM events WHERE event_type = 'error'", ["cast(get_json_object(event, '$.event_id') as bigint) AS event_id", "errors"], which="failed")


add("keyed_list_comparison", "SELECT c_custkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 50 = c_custkey % 50) AS in_list FROM customer",
    lambda spark, d: keyed_list_comparison(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("part")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("part")), "nation", "part").select("c_custkey", "in_list"))

MODEL = {"misuse": {"idf": {"error": 2.0}, "weights": {"error": 4.0}, "bias": -2.0, "threshold": 0.5}}
EIGHT = [
    ("labeler", {"filter": "event_type: error", "labeler": {"label": {"action": ["failed"]}}}),
    ("dissector", {"filter": "props", "dissector": {"mapping": {"props": '{"%{key}": %{number|int}}'}}}),
    ("dropper", {"filter": "event_type: view", "dropper": {"drop": ["value"]}}),
    ("pre_detector", {"filter": "event_type: error", "pre_detector": {"id": "r1", "title": "an error", "severity": "high", "mitre": [], "case_condition": "directly", "copy_fields_to_detection_event": []}}),
    ("amides", {"filter": "event_type", "amides": {"source_fields": ["event_type"]}}),
    ("pseudonymizer", {"filter": "user", "pseudonymizer": {"pseudonyms": {"user": "(.*)"}}}),
    ("calculator", {"filter": "number", "calculator": {"calc": "${number} * 2 + 1", "target_field": "odd"}}),
    ("list_comparison", {"filter": "*", "list_comparison": {"source_fields": ["event_type"], "target_field": "known", "lists": {"used": ["click", "view"]}}}),
]


def eight_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: eight stages, as a log pipeline has them, over all events."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props", F.col("user_id").cast("string").alias("user"))
    pipeline = Pipeline.of([Stage.of(kind, rules, **({"deterministic_id": True} if kind == "pre_detector" else {"hash_salt": "s"} if kind == "pseudonymizer" else {"model": MODEL} if kind == "amides" else {})) for kind, rules in EIGHT])
    found = pipeline.apply(df).events
    return found.select("event_id", "user", "value", "number", "odd", F.col("amides.confidence").alias("confidence"), F.array_join(F.coalesce("label.action", F.array().cast("array<string>")), ",").alias("action"), F.col("pre_detection_id").isNotNull().alias("detected"), F.array_join(F.coalesce("known.in_list", F.array().cast("array<string>")), ",").alias("known"))


add("pipeline_eight_stages", r"""SELECT event_id, '<pseudonym:' || sha256(user_id::VARCHAR || 's') || '>' AS "user", CASE WHEN event_type <> 'view' THEN value END AS value,
  regexp_extract(props, ': (\d+)\}', 1)::BIGINT AS number, regexp_extract(props, ': (\d+)\}', 1)::BIGINT * 2 + 1 AS odd,
  CASE WHEN event_type = 'error' THEN 0.881::DOUBLE ELSE 0.119::DOUBLE END AS confidence, CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS action,
  event_type = 'error' AS detected, CASE WHEN event_type IN ('click', 'view') THEN 'used' ELSE '' END AS known FROM events""", eight_stages)
