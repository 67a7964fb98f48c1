"""Dissection patterns: ``%{field}`` between literal delimiters."""

import re
from dataclasses import dataclass

from ..plans.rules import RuleError

_FIELD = re.compile(r"^(?P<action>[+?&]?)(?:\((?P<separator>(?:\\\)|[^)])*)\))?(?P<name>(?:\\.|[^-/|])*)(?:-\((?P<strip>.)\))?(?:/(?P<position>\d+))?(?:\|(?P<type>int|float|bool))?$")


@dataclass(frozen=True)
class Part:
    """A captured piece: where it goes, how, and the delimiter after it (empty at the end)."""

    name: str
    action: str
    separator: str
    strip: str
    position: int
    type: str
    delimiter: str


def compile_pattern(pattern: str) -> tuple[str, list[Part]]:
    """The literal before the first field, and the fields in order."""
    pieces = re.split(r"%\{([^}]*)\}", pattern)
    if len(pieces) < 3:
        raise RuleError(f"the dissection pattern {pattern!r} has no field")
    found = []
    for i in range(1, len(pieces), 2):
        m = _FIELD.match(pieces[i])
        if m is None:
            raise RuleError(f"the field {pieces[i]!r} of a dissection pattern isn't understood")
        if pieces[i + 1] == "" and i + 2 < len(pieces):
            raise RuleError(f"two fields of {pattern!r} have no delimiter between them")
        separator = (m["separator"] or "").replace("\\)", ")").replace("\\(", "(")
        found.append(Part(m["name"], m["action"], separator, m["strip"] or "", int(m["position"] or 0), m["type"] or "", pieces[i + 1]))
    return pieces[0], found
