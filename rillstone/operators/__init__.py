"""The operators that rules configure. Each turns a rule into an effect on the frame of events."""

from . import detection, external, fields, lookups, network, reckoning, text, times
from .base import OPERATORS, Stage, operator

__all__ = ["OPERATORS", "Stage", "operator", "detection", "external", "fields", "lookups", "network", "reckoning", "text", "times"]
