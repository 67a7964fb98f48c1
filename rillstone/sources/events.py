"""Events from files, streams and services."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, stream: bool = False) -> DataFrame:
    """One JSON event a line. A stream needs a schema; with one, lines that don't fit are nulls in ``_corrupt_record`` if named."""
    reader = (spark.readStream if stream else spark.read).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole files of JSON: an event or a list of events."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Each line of text files that isn't blank as ``message``."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.col("value").alias("message")).where(F.trim("message") != "")


def in_memory(spark: SparkSession, events: list[dict[str, Any]], schema: T.StructType | str | None = None, repeat: int = 1) -> DataFrame:
    """Given events, as often as wanted. An exception among them is an input that couldn't be read: it has its message in ``_raw``."""
    if any(isinstance(e, Exception) for e in events):
        rows = [(json.dumps(e), None) if not isinstance(e, Exception) else (None, f"{type(e).__name__}: {e}") for e in events] * repeat
        good = [e for e in events if not isinstance(e, Exception)]
        kind = schema or in_memory(spark, good).schema
        frame = spark.createDataFrame(rows, "value string, _raw string")
        return frame.select(F.from_json("value", kind).alias("e"), "_raw").select("e.*", "_raw")
    rows = [json.dumps(e) for e in events] * repeat
    frame = spark.createDataFrame([(r,) for r in rows], "value string")
    if schema is None:
        schema = spark.read.json(spark.createDataFrame([(json.dumps(e),) for e in events], "value string").rdd.map(lambda r: r[0])).schema if events else T.StructType()
    return frame.select(F.from_json("value", schema).alias("e")).select("e.*")


def kafka(spark: SparkSession, topic: str, kafka_config: dict[str, str], schema: T.StructType | str, stream: bool = True, max_offsets: int | None = None) -> DataFrame:
    """JSON values of a topic. Values that aren't JSON objects have ``_raw`` and nulls otherwise; offsets live in the
    query's checkpoint, so events are taken at least once."""
    for key in ("bootstrap.servers", "group.id"):
        if key not in kafka_config:
            raise ValueError(f"kafka_config needs {key!r}")
    reader = (spark.readStream if stream else spark.read).format("kafka").option("subscribe", topic)
    for k, v in kafka_config.items():
        reader = reader.option("kafka." + k, v)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parsed(reader.load().select(F.col("value").cast("string").alias("value")), schema)


def parsed(raw: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Text rows (value) to events, with the text itself in ``_raw`` where it isn't a JSON object."""
    event = F.from_json("value", schema)
    good = F.get_json_object("value", "$").isNotNull() & F.col("value").rlike(r"^\s*\{")
    rows = raw.select(F.when(good, event).alias("e"), F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias("_raw"))
    return rows.select("e.*", "_raw")


def unreadable(events: DataFrame) -> DataFrame:
    """(event, errors, @timestamp) of the inputs that couldn't be parsed."""
    return events.where("_raw is not null").select(F.col("_raw").alias("event"), F.lit("no JSON object").alias("errors"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("@timestamp"))


class TailSource(DataSource):
    """A file that grows, as a stream of lines (``message``). A file that was replaced, which a checksum of its first 256
    bytes shows, is read from its beginning; a last line without an end waits for the rest."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "message string"

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _Tail(self.options)


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.start = Path(options["path"]), options.get("start", "begin")

    def _mark(self, size: int) -> int:
        import zlib

        with self.path.open("rb") as f:
            return zlib.crc32(f.read(min(256, size)))

    def initialOffset(self) -> dict:
        at = self.path.stat().st_size if self.start == "end" and self.path.exists() else 0
        return {"at": at, "seen": min(at, 256), "crc": self._mark(at) if at else 0}

    def _lines(self, begin: int, end: int | None) -> tuple[list[tuple], int]:
        with self.path.open("rb") as f:
            f.seek(begin)
            data = f.read() if end is None else f.read(end - begin)
        whole = data[: data.rfind(b"\n") + 1]
        return [(x.decode("utf-8", "replace"),) for x in whole.splitlines() if x.strip()], begin + len(whole)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.path.exists():
            return iter(()), start
        size, at = self.path.stat().st_size, start["at"]
        if size < at or start["seen"] and self._mark(start["seen"]) != start["crc"]:
            at = 0
        rows, at = self._lines(at, None)
        seen = min(at, 256)
        return iter(rows), {"at": at, "seen": seen, "crc": self._mark(seen) if seen else 0}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        begin = start["at"] if start["at"] <= end["at"] else 0
        return iter(self._lines(begin, end["at"])[0])


def tail(spark: SparkSession, path: str, start: str = "begin") -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("start", start).load()
