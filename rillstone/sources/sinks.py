"""Where events, side records and failed events go. Each takes a static DataFrame, so that streams use them by batch."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_records(extras: DataFrame, path: str) -> None:
    """Side records (output, target, doc) as lines ``{target: record}``."""
    record = F.concat(F.lit('{"'), F.replace(F.replace("target", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('": '), F.col("doc"), F.lit("}"))
    extras.select(record.alias("value")).write.mode("append").text(path)


def write_nothing(df: DataFrame) -> None:
    """Computes the rows and leaves them."""
    df.write.format("noop").mode("overwrite").save()


def write_kafka(df: DataFrame, topic: str | None, servers: str, **options: str) -> None:
    """JSON values to a topic; side records (output, target, doc) go to the topic that each one's target names."""
    rows = df.select(F.col("target").alias("topic"), F.col("doc").alias("value")) if topic is None else as_json(df).withColumn("topic", F.lit(topic))
    writer = rows.write.format("kafka").option("kafka.bootstrap.servers", servers)
    for k, v in options.items():
        writer = writer.option("kafka." + k.replace("_", "."), v)
    writer.save()


def dated(prefix: str) -> str:
    """``%{format}`` replaced by the present time in that format of strftime, in UTC."""
    now = datetime.now(timezone.utc)
    return re.sub(r"%\{(.+?)\}", lambda m: now.strftime(m[1]), prefix)


def bucket(name: str, prefix: str = "") -> str:
    """The address of a bucket and a folder in it; what has a scheme stays as it is."""
    return "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((name if "://" in name else f"s3a://{name}", prefix)) if x)


def write_prefixed(df: DataFrame, base: str, prefix: str, default: str) -> None:
    """JSON files below ``base/<prefix>``, where the prefix comes from a field and ``%{format}`` in it from the clock.
    Events without the field go below ``default``, wrapped in an object that tells so."""
    clock = F.pandas_udf(lambda s: s.map({x: None if x is None else dated(x) for x in s.unique()}), "string")
    whole = F.to_json(F.struct("*"))
    given = df[prefix].cast("string") if prefix in df.columns else F.lit(None).cast("string")
    wrapped = F.to_json(F.struct(whole.alias("message"), F.lit(f"there is no prefix field {prefix}").alias("reason")))
    df.select(F.when(given.isNotNull(), whole).otherwise(wrapped).alias("value"), clock(F.coalesce(given, F.lit(default))).alias("prefix")).write.mode("append").partitionBy("prefix").text(base)


def retried(call: Callable[[], Any], attempts: int = 3, wait: float = 0.2, transient: tuple[type[BaseException], ...] = (OSError,)) -> Any:
    """Calls again after a growing pause; the last failure is raised, and the task with it."""
    for i in range(attempts):
        try:
            return call()
        except transient:
            if i + 1 == attempts:
                raise
            time.sleep(wait * 2**i)


def chunks(rows: Iterable[str], most: int, size: int) -> Iterator[list[str]]:
    """Runs of rows of at most so many and at most so many bytes; a longer row is a run of its own."""
    held: list[str] = []
    n = 0
    for r in rows:
        b = len(r.encode()) + 1
        if held and (len(held) >= most or n + b > size):
            yield held
            held, n = [], 0
        held.append(r)
        n += b
    if held:
        yield held


def bulk_lines(doc: str, index: str, op: str = "index") -> str:
    """Action and document of the bulk interface of search engines; ``_index`` and ``_op_type`` of the document count."""
    found = json.loads(doc)
    index, op = found.pop("_index", index), found.pop("_op_type", op)
    return json.dumps({op: {"_index": index}}) + "\n" + json.dumps(found)


class Breaker:
    """Stops all calls of a task while a service fails, and lets one try again after each pause, which doubles up to ``most`` seconds.
    After ``attempts`` failures in a row the last one is raised."""

    def __init__(self, attempts: int = 10, first: float = 0.2, most: float = 30.0, transient: tuple[type[BaseException], ...] = (OSError,)) -> None:
        self.attempts, self.first, self.most, self.transient = attempts, first, most, transient
        self.failures, self.lock = 0, threading.Lock()

    def __call__(self, call: Callable[[int], Any]) -> Any:
        """The result of ``call``, which is given the number of failures so far."""
        while True:
            seen = self.failures
            if seen:
                with self.lock:  # one at a time while the service is down
                    time.sleep(min(self.most, self.first * 2 ** (self.failures - 1)) if self.failures else 0)
                    ok, result = self._once(call)
            else:
                ok, result = self._once(call)
            if ok:
                self.failures = 0
                return result

    def _once(self, call: Callable[[int], Any]) -> tuple[bool, Any]:
        try:
            return True, call(self.failures)
        except self.transient:
            self.failures += 1
            if self.failures >= self.attempts:
                raise
            return False, None


def write_search(df: DataFrame, hosts: str | list[str], index: str, op: str = "index", chunk: int = 500, size: int = 100 << 20, send: Callable[[str, bytes], dict] | None = None, auth: tuple[str, str] | None = None, threads: int = 4, retry_status: tuple[int, ...] = (429,), item_retries: int = 10, failed: Callable[[DataFrame], Any] | None = None, **breaker: Any) -> None:
    """Bulk requests from each partition, several at a time, to any of the hosts. Items that the engine is too busy for are sent again, alone; while it can't
    be reached, requests wait. Documents that it refuses go to ``failed`` as (event, errors); without that they fail the write."""
    hosts = [hosts] if isinstance(hosts, str) else list(hosts)
    schemes = [h if "://" in h else f"http://{h}" for h in hosts]

    def post(address: str, body: bytes) -> dict:
        import requests

        answer = requests.post(address, data=body, headers={"content-type": "application/x-ndjson"}, auth=auth, timeout=30)
        if answer.status_code in (502, 503, 504):
            raise ConnectionError(f"{address} answered {answer.status_code}")
        answer.raise_for_status()
        return answer.json()

    push = send or post

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        own = Breaker(**breaker)

        def stored(part: list[str]) -> list[tuple[str, str]]:
            refused: list[tuple[str, str]] = []
            for i in range(item_retries + 1):
                body = ("\n".join(bulk_lines(x, index, op) for x in part) + "\n").encode()
                answer = own(lambda n, body=body: push(f"{schemes[n % len(schemes)]}/_bulk", body))
                if not answer.get("errors"):
                    return refused
                again = []
                for doc, item in zip(part, answer.get("items", [])):
                    (outcome,) = item.values()
                    if "error" not in outcome:
                        continue
                    if outcome.get("status") in retry_status and i < item_retries:
                        again.append(doc)
                    else:
                        refused.append((doc, json.dumps(outcome["error"])))
                if not again:
                    return refused
                part = again
                time.sleep(min(own.most, own.first * 2**i))
            return refused

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for found in pool.map(stored, chunks(batch["value"], chunk, size)):
                    if found:
                        yield pd.DataFrame(found, columns=["event", "errors"])

    refused = as_json(df).mapInPandas(each, "event string, errors string").persist()  # so that nothing is sent twice
    try:
        if failed is not None:
            failed(refused)
        elif bad := refused.head(5):
            raise RuntimeError(f"{refused.count()} documents were refused: {[r['errors'] for r in bad]}")
    finally:
        refused.unpersist()


def write_http(df: DataFrame, url: str, auth: tuple[str, str] | None = None, chunk: int = 500, send: Callable[[str, bytes], int] | None = None) -> dict[str, int]:
    """JSON lines by POST; how many events met which status. Failures are counted, not raised."""
    if "://" not in url:
        raise ValueError(f"{url!r} has no scheme")

    def post(address: str, body: bytes) -> int:
        import requests

        return requests.post(address, data=body, auth=auth, timeout=10).status_code

    push = send or post

    def each(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for part in chunks(batch["value"], chunk, 10 << 20):
                try:
                    status = str(push(url, ("\n".join(part) + "\n").encode()))
                except Exception as e:  # noqa: BLE001 - whatever the client raises is counted under its name
                    status = type(e).__name__
                yield pd.DataFrame({"status": [status], "n": [len(part)]})

    found = as_json(df).mapInPandas(each, "status string, n long").groupBy("status").agg(F.sum("n").alias("n")).collect()
    return {r["status"]: r["n"] for r in found}


def write_console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)
