"""Requests by path and parameters, answered with one envelope: the store's and the engine's functions for HTTP clients.

Api.request() needs no server; serve() puts it behind Python's own HTTP server.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .engine import Engine, Options, Result
from .errors import InvalidRangeError, TidemarkError, WriteError
from .lang import parse
from .model import MAX_TIME, MIN_TIME, parse_duration
from .sources.requests import MOST_BYTES
from .sources.store import Store

Parameters = Mapping[str, list[str]]


def parse_time(text: str, default: int) -> int:
    """Milliseconds of epoch seconds, fractions too, or of an RFC 3339 time."""
    if not text:
        return default
    try:
        return int(float(text) * 1000)
    except (ValueError, OverflowError):
        pass
    try:
        at = datetime.fromisoformat(text)
        if at.tzinfo is None or "T" not in text.upper():
            raise ValueError
        return math.floor(at.timestamp() * 1000)
    except ValueError:
        raise InvalidRangeError(f"{text!r} is neither epoch seconds nor RFC 3339") from None


def parse_step(text: str, default: int) -> int:
    """Milliseconds of a number of seconds or of a duration literal."""
    if not text:
        return default
    try:
        ms = int(float(text) * 1000)
    except (ValueError, OverflowError):
        try:
            ms = parse_duration(text.strip())
        except ValueError as e:
            raise InvalidRangeError(str(e)) from None
    if ms <= 0:
        raise InvalidRangeError(f"must be positive, got {text}")
    return ms


def number(v: float) -> float | str:
    """JSON has no NaN and no infinity: those are strings."""
    if math.isnan(v):
        return "NaN"
    return ("+Inf" if v > 0 else "-Inf") if math.isinf(v) else v


def _label_map(labels) -> dict[str, str]:
    return {x["name"]: x["value"] for x in labels}


class Api:
    def __init__(self, store: Store, options: Options | None = None):
        self.store, self.options = store, options or Options()
        self.counts = {"samplesIngested": 0, "queriesRun": 0, "queryErrors": 0}

    def engine(self, first: int = MIN_TIME, last: int = MAX_TIME) -> Engine:
        return Engine(self.store.samples(first, last), self.options, self.store.series)

    def request(self, method: str, path: str, parameters: Parameters | None = None, body: bytes = b"") -> tuple[int, dict]:
        """Status and envelope: {"status": "success", "data"} or {"status": "error", "errorType", "error"}."""
        get = lambda name, default="": (parameters or {}).get(name, [default])[0]
        try:
            data = self._answer(method, path, parameters or {}, get, body)
        except TidemarkError as e:
            return e.status, {"status": "error", "errorType": e.kind, "error": str(e)}
        except Exception as e:
            return 500, {"status": "error", "errorType": "internal", "error": str(e).split("\n", 1)[0]}
        if data is None:
            return 404, {"status": "error", "errorType": "not_found", "error": f"no such endpoint: {method} {path}"}
        return 200, {"status": "success", "data": data}

    def _answer(self, method: str, path: str, parameters: Parameters, get, body: bytes):
        now = int(time.time() * 1000)
        if path == "/healthz":
            return "ok"
        if path == "/api/v1/write" and method == "POST":
            if len(body) > MOST_BYTES:
                raise WriteError("the request body is too large")
            written = self.store.write_request(body)
            self.counts["samplesIngested"] += written.accepted
            return {"accepted": written.accepted, "rejected": written.rejected} | ({"errors": written.errors} if written.errors else {})
        if path == "/api/v1/query":
            node = parse(get("query"))
            at = parse_time(get("time"), now)
            return self._query(lambda: self.engine().instant(node, at))
        if path == "/api/v1/query_range":
            node = parse(get("query"))
            start, end, step = parse_time(get("start"), now - 3_600_000), parse_time(get("end"), now), parse_step(get("step"), 15_000)
            return self._query(lambda: self.engine().range(node, start, end, step))
        if path == "/api/v1/series":
            start, end = parse_time(get("start"), now - 3_600_000), parse_time(get("end"), now)
            return [_label_map(r["labels"]) for r in self.engine().series(parameters.get("match[]", []), start, end).collect()]
        if path == "/api/v1/labels":
            return [r["name"] for r in self.engine().label_names().collect()]
        if path.startswith("/api/v1/label/") and path.endswith("/values"):
            name = unquote(path[len("/api/v1/label/") : -len("/values")])
            return [r["value"] for r in self.engine().label_values(name).collect()]
        if path == "/api/v1/functions":
            return Engine.functions()
        if path == "/api/v1/status":
            return self.store.stats() | self.counts
        return None

    def _query(self, run) -> dict:
        self.counts["queriesRun"] += 1
        try:
            result = run()
            return {"resultType": result.type, "result": self._values(result), "stats": result.stats}
        except Exception:
            self.counts["queryErrors"] += 1
            raise

    def _values(self, result: Result):
        rows = result.collect()
        if result.type == "string":
            return rows[0]
        if result.type == "scalar":
            return number(rows[0]["v"])
        if result.type == "instant vector":
            return [{"labels": _label_map(r["labels"]), "t": r["ts"], "v": number(r["v"])} for r in rows]
        out: list[dict] = []
        for r in rows:  # in the order of labels
            labels = _label_map(r["labels"])
            if not out or out[-1]["labels"] != labels:
                out.append({"labels": labels, "samples": []})
            out[-1]["samples"].append({"t": r["t"] if "t" in r else r["ts"], "v": number(r["v"])})
        return out


def serve(api: Api, port: int = 9090, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that isn't running yet; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(min(int(self.headers.get("Content-Length") or 0), MOST_BYTES + 1))
            parameters = parse_qs(url.query, keep_blank_values=True)
            if "form-urlencoded" in (self.headers.get("Content-Type") or ""):
                for k, v in parse_qs(body.decode(), keep_blank_values=True).items():
                    parameters.setdefault(k, []).extend(v)
            status, envelope = api.request(self.command, url.path, parameters, body)
            raw = json.dumps(envelope).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _run

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


__all__ = ["Api", "number", "parse_step", "parse_time", "serve"]
