"""A store's log as a streaming source: offsets are identifiers, so each record comes once, whichever file it lies in by then.

Batches, bulk loads, archived batches and snapshots alike are read by the manifest; a record that moved between files is told by its
identifier. This module is sent to Python workers by value; it reads Parquet by pyarrow.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Piece(InputPartition):
    """Records (start, end] of one file."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class LogReader(DataSourceStreamReader):
    def __init__(self, root: str, after: int, columns: list[str], listing):
        self.root, self.after, self.columns, self.listing = Path(root), after, columns, listing

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        return {"id": max(self.after, self.listing(self.root)["next"]["assertion"] - 1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for entry in self.listing(self.root)["files"]["log"]:
            if entry["last"] <= start["id"] or entry["first"] > end["id"]:
                continue
            places = [self.root / entry["file"], self.root / "log" / "archive" / Path(entry["file"]).name, self.root / "log" / f"_pending-{Path(entry['file']).name}"]
            place = next((p for p in places if p.exists()), places[0])
            parts = sorted(place.glob("*.parquet")) if place.is_dir() else [place]
            out += [Piece(str(p), start["id"], end["id"]) for p in parts]
        return out

    def read(self, piece: Piece):
        import pyarrow.dataset as ds

        id = ds.field("id")
        found = ds.dataset(piece.file, format="parquet").scanner(columns=self.columns, filter=(id > piece.start) & (id <= piece.end), batch_size=65_536)
        yield from (b for b in found.to_batches() if b.num_rows)


class LogSource(DataSource):
    """Options: root, after (the identifier behind which the feed begins)."""

    @classmethod
    def name(cls) -> str:
        return "factloom-log"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> LogReader:
        import json
        import zlib

        def listing(root: Path) -> dict:
            """The manifest, as sources/manifest.py reads it; written out here, for workers that have this module alone."""
            try:
                log = (root / "manifest.log").read_bytes()
            except FileNotFoundError:
                log = b""
            state = json.loads((root / "manifest.json").read_text())
            for text in log.splitlines(keepends=True):
                if not text.endswith(b"\n") or f"{zlib.crc32(text[9:-1]):08x} ".encode() != text[:9]:
                    break
                change = json.loads(text[9:])
                if change["version"] > state["version"]:
                    for table, entries in change["files"].items():
                        state["files"][table] += entries
                    state["next"] |= change["next"]
                    state["version"] = change["version"]
            return state

        return LogReader(self.options["root"], int(self.options.get("after", "0")), [f.name for f in schema.fields], listing)
