"""Numbers of running streams for those who watch them, and whether they are well, over HTTP."""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Exporter:
    """``/metrics`` in the text format of Prometheus, ``/health`` with 200 while all streams that were started are running, else 503."""

    def __init__(self, spark: SparkSession, port: int = 0) -> None:
        self.counts: dict[tuple[str, str], float] = defaultdict(float)
        self.failures: dict[str, str] = {}
        self.lock, exporter = threading.Lock(), self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                exporter.set("rillstone_stream_up", event.name or str(event.id), 1)

            def onQueryProgress(self, event) -> None:
                exporter.progress(event.progress)

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                exporter.ended(str(event.id), event.exception)

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, body = (200, exporter.text()) if self.path.startswith("/metrics") else exporter.health() if self.path.startswith("/health") else (404, "")
                self.send_response(status)
                self.send_header("content-type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args) -> None:
                pass

        self.listener = Listener()
        spark.streams.addListener(self.listener)
        self.spark = spark
        self.server = ThreadingHTTPServer(("", port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def set(self, name: str, stream: str, value: float) -> None:
        with self.lock:
            self.counts[name, stream] = value

    def progress(self, progress) -> None:
        stream = progress.name or str(progress.id)
        with self.lock:
            self.counts["rillstone_events_total", stream] += progress.numInputRows
            self.counts["rillstone_batches_total", stream] += 1
            self.counts["rillstone_events_per_second", stream] = progress.processedRowsPerSecond
            for observed in (progress.observedMetrics or {}).values():
                for k, v in observed.asDict().items():
                    if isinstance(v, (int, float)):
                        self.counts[f"rillstone_{k}_observed_total", stream] += v

    def ended(self, stream: str, problem: str | None) -> None:
        with self.lock:
            self.counts["rillstone_stream_up", stream] = 0
            if problem:
                self.failures[stream] = problem.splitlines()[0][:200]

    def text(self) -> str:
        with self.lock:
            return "".join(f"{name}{{stream={json.dumps(stream)}}} {value:g}\n" for (name, stream), value in sorted(self.counts.items()))

    def health(self) -> tuple[int, str]:
        with self.lock:
            return (503, "\n".join(f"{k}: {v}" for k, v in self.failures.items()) + "\n") if self.failures else (200, "well\n")

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)
        self.server.shutdown()
        self.server.server_close()
