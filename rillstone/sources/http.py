"""An HTTP endpoint that lands events as files of JSON lines for a stream to read."""

from __future__ import annotations

import base64
import gzip
import json
import os
import re
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path


class Landing:
    """Takes POST requests at routes of the kinds json, jsonl and plaintext, and writes one file for each.

    ``most`` unread files make it answer 429. ``credentials`` maps routes to (user, password). GET tells that it lives.
    """

    def __init__(self, folder: str, routes: dict[str, str], credentials: dict[str, tuple[str, str]] | None = None, most: int = 15000, metadata: str = "@metadata", original: str = "") -> None:
        self.folder, self.routes, self.credentials = Path(folder), [(re.compile(f"^{r}$"), r, k) for r, k in routes.items()], credentials or {}
        self.most, self.metadata, self.original = most, metadata, original
        self.folder.mkdir(parents=True, exist_ok=True)

    def handle(self, route: str, body: bytes, headers: dict[str, str], client: str = "") -> int:
        """The status that answers a request."""
        found = next(((name, kind) for pattern, name, kind in self.routes if pattern.match(route)), None)
        if found is None:
            return 404
        name, kind = found
        if (want := self.credentials.get(name)) is not None:
            given = headers.get("authorization", "")
            if given != "Basic " + base64.b64encode(":".join(want).encode()).decode():
                return 401
        if sum(1 for _ in self.folder.glob("*.json")) >= self.most:
            return 429
        try:
            if headers.get("content-encoding") == "gzip":
                body = gzip.decompress(body)
            text = body.decode()
            events = [{"message": text}] if kind == "plaintext" else [json.loads(x) for x in text.splitlines() if x.strip()] if kind == "jsonl" else json.loads(text)
            events = events if isinstance(events, list) else [events]
            if not all(isinstance(e, dict) for e in events):
                return 400
        except (ValueError, OSError, EOFError):
            return 400
        for e in events:
            if self.original:
                e[self.original] = json.dumps(e)
            if self.metadata:
                e[self.metadata] = {"url": route, "remote_addr": client, "user_agent": headers.get("user-agent", "")}
        name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
        hidden = self.folder / f".{name}.tmp"
        hidden.write_text("".join(json.dumps(e) + "\n" for e in events), encoding="utf-8")
        os.replace(hidden, self.folder / name)
        return 200

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        landing = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                size = int(self.headers.get("content-length") or 0)
                self.answer(landing.handle(self.path.split("?")[0], self.rfile.read(size), {k.lower(): v for k, v in self.headers.items()}, self.client_address[0]))

            def do_GET(self) -> None:
                self.answer(200)

            def answer(self, status: int) -> None:
                self.send_response(status)
                self.send_header("content-length", "0")
                self.end_headers()

            def log_message(self, *args: object) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
