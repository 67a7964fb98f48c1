"""Pipelines on streams: every micro-batch takes the way of a static table and is routed to its outputs."""

from .exporter import Exporter
from .router import Outputs, Reloading, observed, run, stream_metrics

__all__ = ["Exporter", "Outputs", "Reloading", "observed", "run", "stream_metrics"]
