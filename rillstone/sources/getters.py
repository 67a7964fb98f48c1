"""Lookup data from files and web addresses, on the driver."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

#: Seconds for which an answer from the web is used without asking again, and after which one that nobody asks for is dropped.
FRESH, UNUSED = 300.0, 3600.0
#: Names of environment variables: a file with credentials by address, and one with times by address.
CREDENTIALS, TIMES = "RILLSTONE_CREDENTIALS_FILE", "RILLSTONE_GETTER_FILE"


@dataclass
class Held:
    """An answer from the web: when it came, its ETag, the text, when it was last asked for, and who wants to know of changes."""

    came: float = 0.0
    tag: str | None = None
    text: str = ""
    used: float = 0.0
    callbacks: list[Callable[[str], object]] = field(default_factory=list)


_seen: dict[str, Held] = {}


def _settings(variable: str, place: str) -> dict[str, Any]:
    """What a file says of the longest address that this one begins with."""
    path = os.environ.get(variable)
    if not path:
        return {}
    table = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    fits = [k for k in table if place.startswith(k)]
    return table[max(fits, key=len)] or {} if fits else {}


def _asked(place: str, tag: str | None) -> tuple[str, str] | None:
    """ETag and text from the web, None if nothing has changed. Credentials are ``username`` and ``password`` or a ``token``."""
    import requests

    own = _settings(CREDENTIALS, place)
    headers = {"If-None-Match": tag} if tag else {}
    if own.get("token"):
        headers["Authorization"] = f"Bearer {own['token']}"
    auth = (own["username"], own.get("password", "")) if own.get("username") else None
    answer = requests.get(place, headers=headers, auth=auth, timeout=5)
    if answer.status_code == 304:
        return None
    answer.raise_for_status()
    return answer.headers.get("ETag", ""), answer.text


def on_change(place: str, call: Callable[[str], object]) -> None:
    """Calls back with the new text when ``refresh`` finds that an address has another one."""
    _seen.setdefault(expanded(place), Held(used=time.monotonic())).callbacks.append(call)


def refresh(now: float | None = None) -> list[str]:
    """Asks again for what is older than its interval, tells who wants to know, drops what wasn't asked for since its timeout, and returns
    the addresses whose texts have changed. An address that can't be reached keeps its text."""
    import requests

    now, changed = time.monotonic() if now is None else now, []
    for place, held in list(_seen.items()):
        times = _settings(TIMES, place)
        if now - held.used > float(times.get("timeout", UNUSED)) and not held.callbacks:
            del _seen[place]
        elif now - held.came >= float(times.get("refresh_interval", FRESH)):
            try:
                answer = _asked(place, held.tag)
            except requests.RequestException:
                continue
            held.came = now
            if answer and answer[1] != held.text:
                changed.append(place)
                held.tag, held.text = answer
                for call in held.callbacks:
                    call(held.text)
    return changed


def expanded(text: str) -> str:
    """``${NAME}`` and ``$NAME`` replaced by environment variables that are set; others stay."""
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: os.environ.get(m[1] or m[2], m[0]), text)


def get_raw(place: str, default: str | None = None) -> str:
    """Text of a file, ``file://`` or ``http(s)://`` address. Web answers are kept, and asked for again by their ETag."""
    place = expanded(place)
    if not place.startswith(("http://", "https://")):
        path = Path(place.removeprefix("file://"))
        if not path.exists() and default is not None:
            return default
        return path.read_text(encoding="utf-8")
    import requests

    held, now = _seen.setdefault(place, Held()), time.monotonic()
    held.used = now
    if held.tag is not None and now - held.came < float(_settings(TIMES, place).get("refresh_interval", FRESH)):
        return held.text
    try:
        answer = _asked(place, held.tag)
        if answer:
            held.tag, held.text = answer
        held.came = now
    except requests.RequestException:
        if held.tag is None:
            del _seen[place]
            if default is None:
                raise
            return default
    return held.text


def get_structured(place: str) -> Any:
    """JSON, JSON lines or YAML by the suffix, text otherwise."""
    text = get_raw(place)
    suffix = Path(place.split("?")[0]).suffix
    if suffix == ".json":
        return json.loads(text)
    if suffix == ".jsonl":
        return [json.loads(x) for x in text.splitlines() if x.strip()]
    return yaml.safe_load(text) if suffix in (".yml", ".yaml") else text


def get_mapping(place: str) -> Any:
    """JSON or YAML, whatever the suffix."""
    return yaml.safe_load(get_raw(place))


def get_lines(place: str, content_field: str | None = None) -> list[str]:
    """A list: a JSON or YAML list, the field of an object that holds one, or lines without comments (#)."""
    found = get_structured(place)
    if isinstance(found, dict) and content_field:
        for part in content_field.split("."):
            found = found[part]
    if isinstance(found, list):
        return [str(x) for x in found]
    text = found if isinstance(found, str) else get_raw(place)
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
