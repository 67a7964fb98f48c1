"""The operator that computes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arithmetic import Expression
from ..plans.frame import Effect, Frame
from ..plans.rules import Rule
from .base import effect, operator, reject, source


@operator("calculator")
def calculator(rule: Rule, frame: Frame, options: dict) -> Effect:
    """Computes an expression of fields. A result that can't be computed gives a warning; text that isn't a number too."""
    reject(rule, "calc", "target_field")
    fields = list(dict.fromkeys(re.findall(r"\$\{([^}]+)\}", rule.options["calc"])))

    def field(path: str, raw: bool = False):
        column, kind = source(frame, path), frame.kind(path)
        if raw:
            return column, "string"
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return column.cast("long"), "long"
        if isinstance(kind, T.NumericType):
            return column.cast("double"), "double"
        return column.cast("string").try_cast("double"), "double"

    expression = Expression(rule.options["calc"], field)
    value, _ = expression.compile()
    if expression.steps:
        value = expression.kept(value)
    present = F.lit(True)
    for f in fields:
        present = present & source(frame, f).isNotNull()
    return effect(rule, frame, [(rule.target, F.when(present, value))], sources=fields, warn=[(present & value.isNull(), rule.failure_tags)], prepare=expression.steps)
