"""JSON-RPC 2.0 over standard input and output, a message a line: initialize, tools/list, tools/call.

    python -m factloom.mcp ROOT [--read-only] [--spill-dir DIR]
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from .commands import COMMANDS, call_tool
from .kernel import Kernel

PROTOCOL = "2025-06-18"
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602


def _error(id, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id, "error": {"code": code, "message": message}}


def handle(kernel: Kernel, request) -> dict | None:
    """The response to one request; none to a notification."""
    silent = not isinstance(request, dict) or "id" not in request
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return _error(request.get("id"), INVALID_REQUEST, "invalid request") if isinstance(request, dict) and not silent else None if isinstance(request, dict) else _error(None, INVALID_REQUEST, "invalid request")
    id, method = request.get("id"), request["method"]
    if method in ("notifications/initialized", "notifications/cancelled"):
        return None
    result = None
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "factloom", "version": "0.1.0"}}
    elif method == "tools/list":
        result = {"tools": [{"name": c.name, "description": c.says, "inputSchema": c.input_schema()} for c in COMMANDS.values()]}
    elif method == "tools/call":
        params = request.get("params")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str):
            return None if silent else _error(id, INVALID_PARAMS, "tools/call needs a name")
        text, failed = call_tool(kernel, params["name"], params.get("arguments") or {})
        result = {"content": [{"type": "text", "text": text}], "isError": failed}
    elif not silent:
        return _error(id, METHOD_NOT_FOUND, f"method not found: {method}")
    return None if silent else {"jsonrpc": "2.0", "id": id, "result": result}


def serve(kernel: Kernel, source: TextIO, sink: TextIO) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            response = handle(kernel, json.loads(line))
        except json.JSONDecodeError as error:
            response = _error(None, PARSE_ERROR, f"parse error: {error}")
        if response is not None:
            sink.write(json.dumps(response, ensure_ascii=False) + "\n")
            sink.flush()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="factloom.mcp")
    parser.add_argument("root")
    parser.add_argument("--read-only", action="store_true")
    parser.add_argument("--spill-dir")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with Kernel(spark, args.root, args.read_only, args.spill_dir) as kernel:
        serve(kernel, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
