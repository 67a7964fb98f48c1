"""Routing of main events, side records and failed events, for static tables and for streams."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..plans.pipeline import Pipeline, Results, read_config
from ..sources import getters
from ..sources.events import unreadable

Sink = Callable[[DataFrame], object]


@dataclass
class Outputs:
    """Sinks: ``default`` ones take every event, ``named`` ones side records, ``failed`` what went wrong."""

    default: list[Sink] = field(default_factory=list)
    named: dict[str, Sink] = field(default_factory=dict)
    failed: Sink | None = None

    def store(self, results: Results) -> None:
        """Failed events first, then side records, then events. What is computed once is kept for all of them: in the folder of checkpoints, if there is
        one, else in the memory and on the disks of executors."""
        if len(self.default) + len(self.named) + (self.failed is not None) > 1:
            shared = results.whole.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
            results = Results(results.whole.checkpoint() if shared else results.whole.persist())
        try:
            if self.failed is not None:
                self.failed(results.failed)
            for name, sink in self.named.items():
                sink(results.extras.where(F.col("output") == name))
            for sink in self.default:
                sink(results.events)
        finally:
            results.whole.unpersist()


class Reloading:
    """A pipeline that is read again when its configuration gets another ``version``, or a lookup from the web another text, looked at every so many seconds.

    Rules and lookup files are read anew with it. A new configuration that can't be compiled is left aside and the
    old one stays."""

    def __init__(self, *paths: str, every: float = 300.0) -> None:
        self.paths, self.every, self.problem = paths, every, ""
        self.pipeline, self.seen = Pipeline.read(*paths), time.monotonic()

    def __call__(self) -> Pipeline:
        if time.monotonic() - self.seen >= self.every:
            self.seen = time.monotonic()
            try:
                config = read_config(*self.paths)
                if getters.refresh() or config.get("version") != self.pipeline.config.get("version"):
                    self.pipeline, self.problem = Pipeline.from_config(config), ""
            except (ValueError, OSError, KeyError, TypeError) as e:
                self.problem = str(e)
        return self.pipeline


def run(pipeline: Pipeline | Callable[[], Pipeline], events: DataFrame, outputs: Outputs, checkpoint: str | None = None, available_now: bool = False, interval: str | None = None) -> StreamingQuery | None:
    """Stores the results of a static table, or starts a query that stores those of each micro-batch, at least once each.

    A function that gives the pipeline is asked for each batch."""
    now = (lambda: pipeline) if isinstance(pipeline, Pipeline) else pipeline

    def batch(df: DataFrame, number: int = 0) -> None:
        if "_raw" in df.columns:  # inputs that couldn't be read never reach the pipeline
            if outputs.failed is not None:
                outputs.failed(unreadable(df))
            df = df.where("_raw is null").drop("_raw")
        outputs.store(now().apply(df))

    if not events.isStreaming:
        batch(events)
        return None

    writer = events.writeStream.foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def stream_metrics(spark, seen: Callable[[dict], None]) -> StreamingQueryListener:
    """Calls ``seen`` with the numbers of each micro-batch."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            p = event.progress
            seen({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def observed(results: Results, name: str | Observation) -> Results:
    """The results with counts of events, failures and warnings, to be had from the Observation or, by name, from the progress of a stream."""
    counts = (F.count(F.lit(1)).alias("events"), F.count_if(F.size("__errors") > 0).alias("failed"), F.count_if(F.size("__warnings") > 0).alias("warned"), F.sum(F.size("__extra")).alias("extras"))
    return Results(results.whole.observe(name, *counts))
