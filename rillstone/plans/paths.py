"""Dotted field paths: ``a.b``, ``a\\.b`` for a dot in a name, ``list.0`` and ``list.start:stop:step`` for elements."""

import re

_SLICE = re.compile(r"^(-?\d*):(-?\d*)(?::(-?\d*))?$")


def split(path: str) -> list[str]:
    parts, now, i = [], "", 0
    while i < len(path):
        if path[i] == "\\" and i + 1 < len(path):
            now += path[i + 1]
            i += 2
            continue
        if path[i] == ".":
            parts.append(now)
            now = ""
        else:
            now += path[i]
        i += 1
    return [*parts, now]


def join(parts: list[str]) -> str:
    return ".".join(p.replace("\\", "\\\\").replace(".", "\\.") for p in parts)


def element(part: str) -> int | slice | None:
    """The index or slice that a part of a path stands for on a list, if any."""
    if re.fullmatch(r"-?\d+", part):
        return int(part)
    if m := _SLICE.match(part):
        return slice(*(int(x) if x else None for x in m.groups()))
    return None
