"""Arithmetic expressions over fields, compiled to columns.

``+ - * /`` (true division), ``^`` (right to left), one comparison, functions, PI and E, and ``${field}``. A result that
can't be computed is null.
"""

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import RuleError

_TOKEN = re.compile(r"\s*(?:(\$\{[^}]+\})|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|==|!=|[-+*/^(),<>]))")


def _half_even(x: Column, n: int = 0) -> Column:
    return F.bround(x, n)


class Expression:
    """Recursive descent; values are (column, whole), whole for integers that stay integers.

    What is needed several times is named once: ``steps`` are columns to be projected, one after the other, before the result. Written out at each mention,
    expressions would grow as a power of their depth."""

    def __init__(self, text: str, field, name: str = "__calc") -> None:
        self.steps: list[dict[str, Column]] = []
        self.name = name
        self.tokens: list[tuple[int, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise RuleError(f"the expression {text!r} isn't understood at character {at}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.i, self.field, self.text = 0, field, text

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.peek() in wanted and self.peek():
            self.i += 1
            return self.tokens[self.i - 1][1]
        return ""

    def kept(self, column: Column) -> Column:
        """The column by a name of its own."""
        self.steps.append({f"{self.name}{len(self.steps)}": column})
        return F.col(*self.steps[-1])

    def finite(self, column: Column) -> Column:
        """The column, null where it is infinite or no number."""
        kept = self.kept(column)
        return F.when(~F.isnan(kept) & (F.abs(kept) < F.lit(float("inf"))), kept)

    def compile(self) -> tuple[Column, str]:
        """The column and its kind: long, double or boolean."""
        left = self.sum()
        op = self.take("<", ">", "<=", ">=", "==", "!=")
        if op:
            right = self.sum()
            a, b = left[0], right[0]
            column = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
            result = column, "boolean"
        else:
            result = left
        if self.i < len(self.tokens):
            raise RuleError(f"the expression {self.text!r} goes on where it should end")
        return result

    def sum(self) -> tuple[Column, str]:
        left = self.product()
        while op := self.take("+", "-"):
            left = self._both(left, self.product(), F.try_add if op == "+" else F.try_subtract)
        return left

    def product(self) -> tuple[Column, str]:
        left = self.sign()
        while op := self.take("*", "/"):
            right = self.sign()
            left = self._both(left, right, F.try_multiply) if op == "*" else (F.try_divide(left[0].cast("double"), right[0].cast("double")), "double")
        return left

    def sign(self) -> tuple[Column, str]:
        if self.take("-"):
            column, kind = self.sign()
            return self.negative(column, kind), kind
        self.take("+")
        return self.power()

    @staticmethod
    def negative(column: Column, kind: str) -> Column:
        """Null for the least whole number."""
        return F.try_subtract(F.lit(0).cast("long"), column) if kind == "long" else -column

    def power(self) -> tuple[Column, str]:
        base = self.atom()
        if self.take("^"):
            raised = self.sign()
            whole = base[1] == raised[1] == "long"
            exponent = self.kept(raised[0]) if whole else raised[0]
            column = self.finite(F.pow(base[0].cast("double"), exponent.cast("double")))
            if not whole:
                return column, "double"
            column = self.kept(column)
            return F.when((exponent >= 0) & (F.abs(column) < 2.0**53), column).cast("long"), "long"
        return base

    def atom(self) -> tuple[Column, str]:
        if self.i >= len(self.tokens):
            raise RuleError(f"the expression {self.text!r} ends too early")
        kind, token = self.tokens[self.i]
        self.i += 1
        if token == "(":
            inner = self.sum()
            if not self.take(")"):
                raise RuleError(f"a parenthesis of {self.text!r} isn't closed")
            return inner
        if kind == 1:
            return self.field(token[2:-1])
        if kind == 2:
            return (F.lit(int(token)).cast("long"), "long") if re.fullmatch(r"\d{1,18}", token) else (F.lit(float(token)), "double")
        if kind == 3 and token in ("PI", "E") and self.peek() != "(":
            return F.lit(math.pi if token == "PI" else math.e), "double"
        if kind == 3 and self.take("("):
            if token == "from_hex":
                return self._hex()
            starts, arguments = [self.i], [self.sum()] if self.peek() != ")" else []
            while self.take(","):
                starts.append(self.i)
                arguments.append(self.sum())
            last = "".join(t for _, t in self.tokens[starts[-1] : self.i])
            if not self.take(")"):
                raise RuleError(f"a parenthesis of {self.text!r} isn't closed")
            return self._call(token, arguments, last)
        raise RuleError(f"{token!r} in {self.text!r} isn't known")

    def _hex(self) -> tuple[Column, str]:
        """The digits stand as they are or come from a field."""
        text = ""
        while self.i < len(self.tokens) and self.peek() != ")":
            text += self.peek()
            self.i += 1
        self.i += 1
        if m := re.fullmatch(r"\$\{([^}]+)\}", text):
            digits = self.kept(F.regexp_replace(self.field(m[1], True)[0].cast("string"), "^0[xX]", ""))
            return F.when(digits.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(digits, 16, 10).cast("long")), "long"
        try:
            return F.lit(int(text, 16)).cast("long"), "long"
        except ValueError as e:
            raise RuleError(f"{text!r} isn't hexadecimal") from e

    def _both(self, a: tuple[Column, str], b: tuple[Column, str], function) -> tuple[Column, str]:
        if a[1] == b[1] == "long":
            return function(a[0], b[0]), "long"
        return self.finite(function(a[0].cast("double"), b[0].cast("double"))), "double"

    def _call(self, name: str, given: list[tuple[Column, str]], last: str) -> tuple[Column, str]:
        """A function of its arguments; ``last`` is the last one as it is written."""
        x = [c for c, _ in given]
        wide = [c.cast("double") for c in x]
        one = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp}
        if name in one and len(x) == 1:
            return one[name](wide[0]), "double"
        if name == "abs" and len(x) == 1:
            of, kind = self.kept(x[0]) if given[0][1] == "long" else x[0], given[0][1]
            return F.when(of < 0, self.negative(of, kind)).otherwise(of) if kind == "long" else F.abs(of), kind
        if name == "trunc" and len(x) == 1:
            return wide[0].try_cast("long"), "long"
        if name == "round" and len(x) == 1:
            return _half_even(wide[0]).try_cast("long"), "long"
        if name == "round" and len(x) == 2:
            if not re.fullmatch(r"[+-]?\d+", last):
                raise RuleError(f"the digits of round in {self.text!r} must be a whole number")
            return _half_even(wide[0], int(last)), "double"
        if name == "sgn" and len(x) == 1:
            of = self.kept(wide[0])
            return F.when(of > 1e-12, 1).when(of < -1e-12, -1).otherwise(0).cast("long"), "long"
        if name == "multiply" and len(x) == 2:
            return self._both(given[0], given[1], F.try_multiply)
        if name == "hypot" and len(x) == 2:
            return F.hypot(*wide), "double"
        if name == "all" and x:
            result = F.lit(True)
            for c in wide:
                result = result & (c != 0)
            return result, "boolean"
        raise RuleError(f"there is no function {name!r} of {len(x)} values")
