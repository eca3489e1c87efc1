"""The manifest of a store: what counts. It needs no Spark, and nothing but the standard library, so that any worker can read it.

manifest.json holds the state at some version; manifest.log has a line a commit behind it: a checksum and what the commit adds. A line that is
cut short or damaged, and whatever follows it, never happened. Folding writes the state anew and empties the log; lines of versions that the state has are skipped.
"""

from __future__ import annotations

import json
import os
import posixpath
import zlib
from pathlib import Path

FORMAT = 2
FILE, LOG = "manifest.json", "manifest.log"


def sync(path: Path) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def empty(tables: list[str]) -> dict:
    return {"format": FORMAT, "version": 0, "next": {"assertion": 1, "entity": 1, "predicate": 1, "seq": 1}, "files": {t: [] for t in tables}, "replaced": []}


def apply(state: dict, change: dict) -> None:
    """Adds a commit to a state."""
    for table, entries in change["files"].items():
        state["files"][table] += entries
    state["next"] |= change["next"]
    state["version"] = change["version"]


def line(change: dict) -> bytes:
    body = json.dumps(change).encode()
    return f"{zlib.crc32(body):08x} ".encode() + body + b"\n"


def read(root: Path) -> tuple[dict, int]:
    """The state with the log's commits, and how many lines of the log count. The log is read first: if a writer folds it meanwhile, the state holds what it held."""
    try:
        log = (root / LOG).read_bytes()
    except FileNotFoundError:
        log = b""
    state, lines = json.loads((root / FILE).read_text()), 0
    if state.get("format") != FORMAT:
        raise ValueError(f"a store of format {state.get('format')}; this is format {FORMAT}")
    for text in log.splitlines(keepends=True):
        if not text.endswith(b"\n") or text[8:9] != b" " or f"{zlib.crc32(text[9:-1]):08x}".encode() != text[:8]:
            break
        change = json.loads(text[9:])
        lines += 1
        if change["version"] > state["version"]:
            apply(state, change)
    return state, lines


def fold(root: Path, state: dict) -> None:
    """Writes a state and empties the log."""
    aside = root / f"{FILE}.new"
    with aside.open("w") as out:
        out.write(json.dumps(state))
        out.flush()
        os.fsync(out.fileno())
    os.replace(aside, root / FILE)
    sync(root)
    (root / LOG).unlink(missing_ok=True)


def pending(root: Path, file: str) -> Path:
    return root / posixpath.dirname(file) / f"_pending-{posixpath.basename(file)}"


def archived(root: Path, file: str) -> Path:
    return root / posixpath.dirname(file) / "archive" / posixpath.basename(file)


def place(root: Path, file: str) -> Path:
    """Where a listed file lies: under its name, in the archive, or still under its hidden name."""
    places = [root / file, archived(root, file), pending(root, file)]
    return next((p for p in places if p.exists()), places[0])
