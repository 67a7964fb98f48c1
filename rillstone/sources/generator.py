"""Load: sample events over and over, with fresh times, mixed and in a fixed number."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeformats import java_format


def samples(folder: str | Path) -> list[tuple[str, str]]:
    """(class, JSON line) of all ``*.jsonl`` files in the folders of a folder, one folder for each class."""
    found = []
    for path in sorted(Path(folder).glob("*/*.jsonl")):
        found += [(path.parent.name, json.dumps(json.loads(x))) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()]
    return found


def generate(spark: SparkSession, given: list[tuple[str, str]], count: int, shuffle: bool = False, seed: int = 0, timestamp: dict[str, str] | None = None, tag: str = "") -> DataFrame:
    """(target, value): ``count`` events from the samples in turn. ``timestamp`` {key, format, delta_seconds} replaces a time
    by the current one."""
    n = len(given)
    table = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(given)], "k long, target string, value string")
    rows = spark.range(count).withColumn("k", F.col("id") % n).join(F.broadcast(table), "k")  # the samples fit the driver
    value = F.col("value")
    if timestamp:
        moment = F.expr(f"current_timestamp() + make_interval(0,0,0,0,0,0,{float(timestamp.get('delta_seconds', 0))})")
        text = F.date_format(moment, java_format(timestamp["format"]))
        value = F.regexp_replace(value, F.lit(rf'("{timestamp["key"]}"\s*:\s*)"[^"]*"'), F.concat(F.lit('$1"'), text, F.lit('"')))
    if tag:
        value = F.regexp_replace(value, r"\}$", F.lit(f', "tags": ["{tag}"]}}'))
    rows = rows.select("id", "target", value.alias("value"))
    return rows.orderBy(F.xxhash64("id", F.lit(seed))).select("target", "value") if shuffle else rows.select("target", "value")
