"""The filter language of rules: a parser to a small tree, and columns from the tree.

Every leaf is true or false, never null: a missing field makes a leaf false and its negation true.
"""

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


class FilterError(ValueError):
    """The text isn't a filter."""


@dataclass(frozen=True)
class Node:
    """Part of a filter; ``text`` is its form by which members of a conjunction are ordered."""

    @property
    def text(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Always(Node):
    text = "*"


@dataclass(frozen=True)
class Leaf(Node):
    key: str


@dataclass(frozen=True)
class Exists(Leaf):
    @property
    def text(self) -> str:
        return f"{self.key}: *"


@dataclass(frozen=True)
class Null(Leaf):
    @property
    def text(self) -> str:
        return f"{self.key}:None"


@dataclass(frozen=True)
class Equals(Leaf):
    value: str

    @property
    def text(self) -> str:
        return f'{self.key}:"{self.value}"'


@dataclass(frozen=True)
class Matches(Leaf):
    pattern: str

    @property
    def text(self) -> str:
        return f"{self.key}:/{self.pattern}/"


@dataclass(frozen=True)
class Like(Leaf):
    """Wildcards * and ?, in any case of letters; both may stand for nothing."""

    value: str

    @property
    def text(self) -> str:
        return f'{self.key}:"{self.value}"'


@dataclass(frozen=True)
class Between(Leaf):
    low: int | float | str
    high: int | float | str
    from_low: bool
    to_high: bool

    @property
    def text(self) -> str:
        return f"{self.key}:{'[' if self.from_low else '{'}{self.low} TO {self.high}{']' if self.to_high else '}'}"


@dataclass(frozen=True)
class Not(Node):
    of: Node

    @property
    def text(self) -> str:
        return f"NOT({self.of.text})"


@dataclass(frozen=True)
class And(Node):
    of: tuple[Node, ...]

    @property
    def text(self) -> str:
        return "AND(" + ", ".join(x.text for x in self.of) + ")"


@dataclass(frozen=True)
class Or(Node):
    of: tuple[Node, ...]

    @property
    def text(self) -> str:
        return "OR(" + ", ".join(x.text for x in self.of) + ")"


class Parser:
    """Recursive descent over the text. ``regex_keys`` makes all values of those keys regular expressions, ``like_keys``
    (True for all) makes them wildcards."""

    def __init__(self, text: str, regex_keys: tuple[str, ...] = (), like_keys: tuple[str, ...] | bool = ()) -> None:
        self.s, self.i, self.regex_keys, self.like_keys = text, 0, regex_keys, like_keys

    def fail(self, why: str) -> FilterError:
        return FilterError(f"{why} at character {self.i} of {self.s!r}")

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def word(self, name: str) -> bool:
        """Takes an operator that stands as a word of its own."""
        self.space()
        end = self.i + len(name)
        if self.s[self.i : end] == name and (end == len(self.s) or self.s[end].isspace() or self.s[end] in "()"):
            self.i = end
            return True
        return False

    def parse(self) -> Node:
        node = self.either(None)
        self.space()
        if self.i < len(self.s):
            raise self.fail("an operator is missing")
        return node

    def either(self, key: str | None) -> Node:
        found = [self.both(key)]
        while self.word("OR"):
            found.append(self.both(key))
        return found[0] if len(found) == 1 else Or(tuple(found))

    def both(self, key: str | None) -> Node:
        found = [self.one(key)]
        while self.word("AND"):
            found.append(self.one(key))
        return found[0] if len(found) == 1 else And(tuple(found))

    def one(self, key: str | None) -> Node:
        if self.word("NOT"):
            return Not(self.one(key))
        self.space()
        if self.i >= len(self.s):
            raise self.fail("something is missing")
        if self.s[self.i] == "(":
            self.i += 1
            node = self.either(key)
            self.space()
            if self.i >= len(self.s) or self.s[self.i] != ")":
                raise self.fail("a parenthesis isn't closed")
            self.i += 1
            return node
        return self.value(key) if key is not None else self.term()

    def term(self) -> Node:
        name = self.bare(":")
        if name == "*" and not (self.i < len(self.s) and self.s[self.i] == ":"):
            return Always()
        if not name:
            raise self.fail("a field name is missing")
        if self.i >= len(self.s) or self.s[self.i] != ":":
            return Exists(name)
        self.i += 1
        self.space()
        if self.i < len(self.s) and self.s[self.i] == "(":
            self.i += 1
            node = self.either(name)
            self.space()
            if self.i >= len(self.s) or self.s[self.i] != ")":
                raise self.fail("a parenthesis isn't closed")
            self.i += 1
            return node
        return self.value(name)

    def value(self, key: str) -> Node:
        key, _, modifier = key.partition("|")
        if modifier not in ("", "re"):
            raise self.fail(f"unknown modifier {modifier!r}")
        c = self.s[self.i] if self.i < len(self.s) else ""
        if c == "/" and not modifier:
            return Matches(key, self.pattern())
        if c in "[{" and c:
            return self.span(key)
        quoted = c == '"'
        text = self.quoted() if quoted else self.bare("")
        if not quoted and not text:
            raise self.fail("a value is missing")
        if not quoted and self.i < len(self.s) and self.s[self.i] in "^~":
            raise self.fail("boosts and fuzzy terms aren't supported")
        if modifier or key in self.regex_keys:
            return Matches(key, text)
        if not quoted and text == "null":
            return Null(key)
        if not quoted and text == "*":
            return Exists(key)
        if self.like_keys is True or (self.like_keys and key in self.like_keys):
            return Like(key, text)
        return Equals(key, text)

    def bare(self, stops: str) -> str:
        out = ""
        while self.i < len(self.s) and not self.s[self.i].isspace() and self.s[self.i] not in "()" + stops:
            if self.s[self.i] in "^~" and out and not stops:
                break
            if self.s[self.i] == "\\" and self.i + 1 < len(self.s):
                # an escaped dot of a field name stays escaped, for the path to see
                out += self.s[self.i : self.i + 2] if stops and self.s[self.i + 1] == "." else self.s[self.i + 1]
                self.i += 2
                continue
            out += self.s[self.i]
            self.i += 1
        return out

    def quoted(self) -> str:
        out, self.i = "", self.i + 1
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\" and self.s[self.i + 1 : self.i + 2] in ('"', "\\"):
                out += self.s[self.i + 1]
                self.i += 2
                continue
            self.i += 1
            if c == '"':
                return out
            out += c
        raise self.fail("a quotation isn't closed")

    def pattern(self) -> str:
        out, self.i = "", self.i + 1
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\" and self.i + 1 < len(self.s):
                out += "/" if self.s[self.i + 1] == "/" else self.s[self.i : self.i + 2]
                self.i += 2
                continue
            self.i += 1
            if c == "/":
                return out
            out += c
        raise self.fail("a regular expression isn't closed")

    def span(self, key: str) -> Node:
        opened = self.s[self.i]
        self.i += 1
        low = self.bound()
        if not self.word("TO"):
            raise self.fail("TO is missing in a range")
        high = self.bound()
        self.space()
        closed = self.s[self.i : self.i + 1]
        if closed not in ("]", "}"):
            raise self.fail("a range isn't closed")
        self.i += 1
        kinds = {type(low), type(high)}
        if kinds == {int, float}:
            low, high = float(low), float(high)
        elif len(kinds) > 1:
            raise self.fail("the bounds of a range are of different kinds")
        if low > high:
            raise self.fail("the bounds of a range are reversed")
        return Between(key, low, high, opened == "[", closed == "]")

    def bound(self) -> int | float | str:
        self.space()
        if self.s[self.i : self.i + 1] == '"':
            return self.quoted()
        text = ""
        while self.i < len(self.s) and not self.s[self.i].isspace() and self.s[self.i] not in "]}":
            text += self.s[self.i]
            self.i += 1
        text = text.replace("\\-", "-")
        if not text or text == "*":
            raise self.fail("a range must have both bounds")
        if re.fullmatch(r"[+-]?\d+", text):
            return int(text)
        try:
            number = float(text)
        except ValueError:
            return text
        if not math.isfinite(number):
            raise self.fail("a bound isn't finite")
        return number


def parse(text: str, regex_keys: tuple[str, ...] = (), like_keys: tuple[str, ...] | bool = ()) -> Node:
    return Parser(text, regex_keys, like_keys).parse()


def java_pattern(pattern: str) -> str:
    """A Python regular expression in the dialect of the JVM, with words and digits of all scripts."""
    names: dict[str, str] = {}

    def plain(name: str) -> str:
        return names.setdefault(name, f"g{len(names)}x" + re.sub(r"[^A-Za-z0-9]", "", name))

    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{plain(m[1])}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{plain(m[1])}>", pattern)
    return "(?U)" + pattern.replace(r"\Z", r"\z")


def anchored(pattern: str) -> str:
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    head = flags[0] if flags else ""
    return head + java_pattern(f"^(?:{pattern[len(head):]})$")


def like_pattern(value: str) -> str:
    """Regular expression of a wildcard; a backslash before a wildcard makes it an ordinary character."""
    out, i = "", 0
    while i < len(value):
        c = value[i]
        if c == "\\" and value[i + 1 : i + 2] in ("*", "?", "\\") and value[i + 1 : i + 2]:
            out += re.escape(value[i + 1])
            i += 2
            continue
        out += ".*" if c == "*" else ".?" if c == "?" else re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def as_text(column: Column, kind: T.DataType) -> Column:
    """The value as Python would print it."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("True")).when(~column, F.lit("False"))
    if isinstance(kind, FLOATING):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, F.concat(column.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(F.replace(F.lower(column.cast("string")), F.lit("infinity"), F.lit("inf")))
    return column.cast("string")


def _equals(column: Column, kind: T.DataType, value: str) -> Column:
    if isinstance(kind, T.StringType):
        return column == value
    if isinstance(kind, T.BooleanType):
        return column == (value == "True") if value in ("True", "False") else F.lit(False)
    if isinstance(kind, INTEGRAL):
        return column == int(value) if re.fullmatch(r"-?(0|[1-9]\d{0,17})", value) and value != "-0" else F.lit(False)
    if isinstance(kind, FLOATING):
        try:
            return column == float(value) if repr(float(value)) == value else F.lit(False)
        except ValueError:
            return F.lit(False)
    if isinstance(kind, T.ArrayType):
        return F.array_contains(column, value) if isinstance(kind.elementType, T.StringType) else F.lit(False)
    return F.lit(False) if isinstance(kind, (T.StructType, T.MapType)) else column.cast("string") == value


def _pattern(column: Column, kind: T.DataType, pattern: str) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: F.coalesce(as_text(x, kind.elementType).rlike(pattern), F.lit(False)))
    return F.lit(False) if isinstance(kind, (T.StructType, T.MapType)) else as_text(column, kind).rlike(pattern)


def _between(column: Column, kind: T.DataType, x: Between) -> Column:
    fits = INTEGRAL if isinstance(x.low, int) else FLOATING if isinstance(x.low, float) else (T.StringType,)
    if not isinstance(kind, fits):
        return F.lit(False)
    return (column >= x.low if x.from_low else column > x.low) & (column <= x.high if x.to_high else column < x.high)


def to_column(node: Node, look) -> Column:
    """The filter as a column. ``look(key)`` gives the column and type of a field, or None if there is none."""
    if isinstance(node, Always):
        return F.lit(True)
    if isinstance(node, Not):
        return ~to_column(node.of, look)
    if isinstance(node, (And, Or)):
        first, *rest = (to_column(x, look) for x in node.of)
        for x in rest:
            first = first & x if isinstance(node, And) else first | x
        return first
    found = look(node.key)
    if found is None:
        return F.lit(False)
    column, kind = found
    if isinstance(node, Exists):
        return column.isNotNull()
    if isinstance(node, Null):  # null and missing are one in typed columns
        return column.isNull()
    if isinstance(node, Equals):
        test = _equals(column, kind, node.value)
    elif isinstance(node, Matches):
        test = _pattern(column, kind, anchored(node.pattern))
    elif isinstance(node, Like):
        test = _pattern(column, kind, like_pattern(node.value))
    else:
        test = _between(column, kind, node)
    return F.coalesce(test, F.lit(False))
