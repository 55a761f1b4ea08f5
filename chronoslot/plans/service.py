"""A JSON-RPC service over standard input and output: questions about traces as tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buffers, counters, lifecycle, report
from ..operators.state import events_in_range, state_at
from ..sources import trace_format
from .trace import Trace

PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD = -32700, -32600, -32601
#: Rows that one answer shows at most; an answer says when there are more.
MAX_ROWS = 1000


def parse_range(text: str) -> tuple[int, int]:
    """``START:END``."""
    a, colon, b = text.partition(":")
    if not colon or not a.strip().isdigit() or not b.strip().isdigit():
        raise ValueError(f"a range is START:END, not {text!r}")
    return int(a), int(b)


def _range(args: dict) -> tuple[int, int]:
    return parse_range(args["range"]) if "range" in args else (int(args["start_cycle"]), int(args["end_cycle"]))


def _counters(t: Trace, a: dict) -> DataFrame:
    if "range" in a or "start_cycle" in a:
        start, end = _range(a)
        df = counters.series(t, start, end) if a.get("series") else counters.range_summary(t, start, end)
    else:
        df = counters.latest(t)
    return counters.named(df, a["name"]) if a.get("name") else df


TOOLS: dict[str, tuple[str, dict[str, str], Callable[[Trace, dict], DataFrame]]] = {
    "file_info": ("Header, properties and schema of a trace.", {}, lambda t, a: report.file_info(t)),
    "state_at_cycle": ("Valid slots of a storage at a cycle.", {"storage": "string", "cycle": "integer"}, lambda t, a: state_at(t, t.schema.storage(a["storage"]), int(a["cycle"]) * t.period_ps)),
    "trace_instruction": ("Stages of one entity.", {"entity_id": "integer"}, lambda t, a: lifecycle.timeline(t, int(a["entity_id"]))),
    "counter_values": ("Counter totals, range summaries or series.", {"name": "string", "range": "string", "series": "boolean"}, _counters),
    "buffer_occupancy": ("Occupancy of buffers at a cycle.", {"cycle": "integer", "name": "string"}, lambda t, a: buffers.all_buffers(t, int(a["cycle"]), a.get("name"))),
    "buffer_contents": ("Occupied slots of a buffer with their entities.", {"name": "string", "cycle": "integer"}, lambda t, a: buffers.buffer_state(t, t.schema.storage(a["name"]), int(a["cycle"]))),
    "analyze_performance": ("Throughput, flush rate, stage latency, counters and buffers of a window.", {"range": "string"}, lambda t, a: report.performance(t, *_range(a))),
    "events": ("Events between two cycles.", {"range": "string"}, lambda t, a: events_in_range(t, *(c * t.period_ps for c in _range(a))).drop("trace_id")),
}


class Service:
    """Answers one request at a time. Errors of tools are results that say so; errors of the protocol are errors."""

    def __init__(self, spark: SparkSession, opener: Callable[[SparkSession, str], Trace] = trace_format.load):
        self.spark, self.opener, self.open = spark, opener, {}

    def trace(self, path: str) -> Trace:
        if path not in self.open:
            self.open[path] = self.opener(self.spark, path)
        return self.open[path]

    def call(self, name: str, args: dict) -> list[dict]:
        if name not in TOOLS:
            raise LookupError(f"no tool {name!r}")
        df = TOOLS[name][2](self.trace(args["path"]), args)
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).take(MAX_ROWS + 1)]
        return rows[:MAX_ROWS] + ([{"more": True}] if len(rows) > MAX_ROWS else [])

    def handle(self, line: str) -> dict | None:
        try:
            req = json.loads(line)
        except ValueError as e:
            return self._error(None, PARSE_ERROR, str(e))
        if not isinstance(req, dict) or "method" not in req:
            return self._error(req.get("id") if isinstance(req, dict) else None, INVALID_REQUEST, "no method")
        method, ident, params = req["method"], req.get("id"), req.get("params") or {}
        if method == "initialize":
            return self._result(ident, {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "chronoslot", "version": "0.1"}})
        if method.startswith("notifications/"):
            return None
        if method == "tools/list":
            return self._result(ident, {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}, **{k: {"type": v} for k, v in p.items()}}, "required": ["path"]}} for n, (d, p, _) in TOOLS.items()]})
        if method == "tools/call":
            try:
                text, failed = json.dumps(self.call(params.get("name", ""), params.get("arguments") or {})), False
            except Exception as e:  # a tool's failure is its answer
                text, failed = f"{type(e).__name__}: {e}", True
            return self._result(ident, {"content": [{"type": "text", "text": text}], "isError": failed})
        return self._error(ident, UNKNOWN_METHOD, f"unknown method {method}")

    @staticmethod
    def _result(ident: Any, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "result": result}

    @staticmethod
    def _error(ident: Any, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}

    def serve(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(line)) is not None:
                print(json.dumps(answer), file=out, flush=True)
