"""The store: append-only tables of committed batches below a root folder, with one writer.

Every commit writes a Parquet file under a hidden name, adds a line to the manifest's log, which lists the files that count, and gives the file its
name. A batch is there as a whole once the line is; a crash before that leaves a hidden file that nothing lists, and
burns no identifier; after a crash behind it the next writer finishes the renaming. Reads go through Spark, over exactly the
listed files, which a reader pins when it opens.

A snapshot rewrites the log as one data set that is dealt by subject, with the closers of each record beside it, so that reads of statuses need no
join; batches that come later lie behind it.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import Tables
from ..plans.status import crowded_links, settle
from ..schema import CROWDED, LOG, MAX_BATCH, SETTLED, TABLES, EngineError
from . import manifest as listing

#: Commits in the manifest's log before it is folded.
FOLD = 256
#: Records of a part of a snapshot, about.
PART_ROWS = 4_000_000
#: Filters by which single records, values and names are found without reading whole data sets.
FILTERS = {"log": ["id"], "entities": ["id", "value.text"], "predicates": ["name"], "provenance": ["assertion_id"], "payloads": ["id"]}
_ARROW = {
    "log": pa.schema([("id", pa.int64()), ("subject", pa.int64()), ("predicate", pa.int64()), ("object", pa.int64()), ("valid_from", pa.int64()), ("valid_to", pa.int64()), ("observed_at", pa.int64()), ("confidence", pa.float64()), ("appended_status", pa.int8()), ("supersedes_id", pa.int64()), ("retracts_id", pa.int64())]),
    "entities": pa.schema([("id", pa.int64()), ("value", pa.struct([("kind", pa.int8()), ("text", pa.string()), ("i64", pa.int64()), ("f64", pa.float64()), ("b", pa.bool_()), ("ts", pa.int64())]))]),
    "predicates": pa.schema([("id", pa.int64()), ("name", pa.string())]),
    "payloads": pa.schema([("id", pa.int64()), ("content", pa.binary())]),
    "merges": pa.schema([("seq", pa.int64()), ("absorbed", pa.int64()), ("surviving", pa.int64()), ("merged_at", pa.int64())]),
    "provenance": pa.schema([("seq", pa.int64()), ("assertion_id", pa.int64()), ("source", pa.int64()), ("recorded_at", pa.int64()), ("method", pa.string())]),
}


class Store:
    """root: a folder that the driver writes and all executors read."""

    def __init__(self, spark: SparkSession, root: str | Path, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, Path(root), read_only
        self._lock = None
        self._held: tuple[dict[str, list[dict]], dict[str, int]] | None = None
        if read_only:
            if not (self.root / listing.FILE).exists():
                raise EngineError(f"no store at {self.root}")
        else:
            self.root.mkdir(parents=True, exist_ok=True)
            self._lock = open(self.root / "LOCK", "w")  # noqa: SIM115
            try:
                fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as error:
                self._lock.close()
                raise EngineError(f"{self.root} is open for writing elsewhere; a store has one writer") from error
        if (self.root / listing.FILE).exists():
            try:
                self.manifest, self._lines = listing.read(self.root)
            except ValueError as error:
                self.close()
                raise EngineError(str(error)) from error
        else:
            self.manifest, self._lines = listing.empty(list(TABLES)), 0
            listing.fold(self.root, self.manifest)
        if not read_only:
            if (self.root / listing.LOG).exists():  # a line that was cut short goes
                self._fold()
            self._settle(e for entries in self.manifest["files"].values() for e in entries[-1:])

    def close(self) -> None:
        if self._lock is not None:
            self._lock.close()
            self._lock = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def require_writable(self, what: str) -> None:
        if self.read_only:
            raise EngineError(f"{what} needs a writer; this store was opened for reading")

    def _fold(self) -> None:
        listing.fold(self.root, self.manifest)
        self._lines = 0

    def _commit(self, files: dict[str, list[dict]], advance: dict[str, int]) -> None:
        """Lists files and advances counters, all or nothing; costs a line, however many commits there were."""
        change = {"version": self.manifest["version"] + 1, "files": files, "next": {c: self.next(c) + by for c, by in advance.items()}}
        log = self.root / listing.LOG
        new = not log.exists()
        with log.open("ab") as out:
            out.write(listing.line(change))
            out.flush()
            os.fsync(out.fileno())
        if new:
            listing.sync(self.root)
        listing.apply(self.manifest, change)
        self._lines += 1
        if self._lines >= FOLD:
            self._fold()

    def next(self, counter: str) -> int:
        return self.manifest["next"][counter] + (self._held[1].get(counter, 0) if self._held else 0)

    @contextmanager
    def together(self) -> Iterator[None]:
        """What is appended in the block becomes one commit at its end, all or nothing; identifiers are given at once, reads see nothing of it before. Rows wait in memory."""
        self.require_writable("together")
        if self._held is not None:
            raise EngineError("together doesn't nest")
        self._held = {}, {}
        try:
            yield
            batches, advance = self._held
        finally:
            self._held = None
        if batches or advance:
            self.append(batches, **advance)

    def held(self, table: str) -> list[dict]:
        """A table's rows that wait for the end of together()."""
        return self._held[0].get(table, []) if self._held else []

    def append(self, batches: dict[str, Iterable[dict]], **advance: int) -> None:
        """Rows of one or several tables and the counters' advance, all or nothing."""
        if self._held is not None:
            rows, by = self._held
            for table, some in batches.items():
                rows.setdefault(table, []).extend(some)
            for counter, n in advance.items():
                by[counter] = by.get(counter, 0) + n
            return
        version, files = self.manifest["version"] + 1, {}
        for table, rows in batches.items():
            rows = list(rows)
            if not rows:
                continue
            folder = self.root / table
            folder.mkdir(exist_ok=True)
            entry = {"file": f"{table}/batch-{version:09d}.parquet", "rows": len(rows)}
            if table == "log":
                entry |= {"first": rows[0]["id"], "last": rows[-1]["id"], "links": sum(1 for r in rows if r["supersedes_id"] or r["retracts_id"])}
            hidden = listing.pending(self.root, entry["file"])
            pq.write_table(pa.Table.from_pylist(rows, schema=_ARROW[table]), hidden)
            listing.sync(hidden)
            listing.sync(folder)
            files[table] = [entry]
        self._commit(files, advance)
        self._settle(e for entries in files.values() for e in entries)

    def _settle(self, entries: Iterable[dict]) -> None:
        """Gives committed files their names."""
        for entry in entries:
            hidden = listing.pending(self.root, entry["file"])
            if not (self.root / entry["file"]).exists() and hidden.exists():
                os.replace(hidden, self.root / entry["file"])
                listing.sync(hidden.parent)

    def _spark_write(self, rows: DataFrame, table: str, file: str) -> None:
        if self._held is not None:
            raise EngineError("loads and snapshots don't go together with other commits")
        options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in FILTERS.get(table, [])}
        rows.write.options(**options).mode("overwrite").parquet(f"file://{(self.root / file).resolve()}")

    def load_log(self, rows: DataFrame) -> int:
        """Bulk load of a log whose identifiers continue this one's without gaps; returns how many rows. Spark writes the files, sorted by identifier."""
        self.require_writable("load_log")
        first, version = self.next("assertion"), self.manifest["version"] + 1
        file = f"log/load-{version:09d}"
        self._spark_write(rows.select(*LOG.names).repartitionByRange("id").sortWithinPartitions("id"), "log", file)
        wrote = self.spark.read.schema(LOG).parquet(self._uri(file))
        found = wrote.agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids"), F.count_if(F.expr("supersedes_id <> 0 or retracts_id <> 0")).alias("links")
        ).first()
        if found.n and (found.low, found.high, found.ids) == (first, first + found.n - 1, found.n):
            self._commit({"log": [{"file": file, "rows": found.n, "first": first, "last": found.high, "links": found.links}]}, {"assertion": found.n})
            return found.n
        shutil.rmtree(self.root / file)
        if found.n:
            raise EngineError("identifiers of a bulk load must continue the log's without gaps")
        return 0

    def load(self, table: str, rows: DataFrame, by: str = "id", counter: str | None = None) -> int:
        """Bulk load of another table, sorted by a column, whose numbers lie beyond the counter's; returns how many rows."""
        self.require_writable("load")
        file = f"{table}/load-{self.manifest['version'] + 1:09d}"
        columns = TABLES[table].names
        self._spark_write(rows.select(*columns).repartitionByRange(by).sortWithinPartitions(by), table, file)
        number = columns[0]
        found = self.spark.read.schema(TABLES[table]).parquet(self._uri(file)).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).first()
        if counter is not None and found.n and found.low < self.next(counter):
            shutil.rmtree(self.root / file)
            raise EngineError(f"numbers of a bulk load must lie beyond those of {table}")
        if not found.n:
            shutil.rmtree(self.root / file)
            return 0
        self._commit({table: [{"file": file, "rows": found.n}]}, {counter: found.high + 1 - self.next(counter)} if counter is not None else {})
        return found.n

    def load_together(self, tables: dict[str, tuple[DataFrame, int]], **advance: int) -> None:
        """Bulk load of several tables by id in one commit; each comes with the number of its rows, which continue the counters' numbers without gaps."""
        version, files = self.manifest["version"] + 1, {}
        for table, (rows, n) in tables.items():
            if not n:
                continue
            file = f"{table}/load-{version:09d}"
            self._spark_write(rows.repartitionByRange("id").sortWithinPartitions("id"), table, file)
            found = self.spark.read.schema(TABLES[table]).parquet(self._uri(file)).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("ids")).first()
            first = self.next({"log": "assertion", "entities": "entity", "predicates": "predicate"}[table])
            if (found.n, found.ids, found.low, found.high) != (n, n, first, first + n - 1):
                for made in (file, *(e["file"] for entries in files.values() for e in entries)):
                    shutil.rmtree(self.root / made)
                raise EngineError(f"numbers of a bulk load must continue those of {table} without gaps")
            files[table] = [{"file": file, "rows": n} | ({"first": first, "last": first + n - 1, "links": 0} if table == "log" else {})]
        self._commit(files, advance)

    def write_snapshot(self) -> None:
        """Rewrites the log, appended statuses as they are, as one settled data set by subject; replaced batches stay on disk, listed in the manifest."""
        self.require_writable("write_snapshot")
        last = self.next("assertion") - 1
        if not last or (len(self.manifest["files"]["log"]) == 1 and "settled" in self.manifest["files"]["log"][0]):
            return
        version = self.manifest["version"] + 1
        file, beside = f"settled/data-{version:09d}", f"settled/crowded-{version:09d}"
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-last // PART_ROWS))
        log = self.table("log")
        self._spark_write(settle(log).repartitionByRange(parts, "subject", "id").sortWithinPartitions("subject", "id"), "log", file)
        crowded = 0
        settled = self.spark.read.schema(SETTLED).parquet(self._uri(file))
        if not settled.where("crowded").isEmpty():
            self._spark_write(crowded_links(log, settled).repartitionByRange("target", "id"), "crowded", beside)
            crowded = self.spark.read.schema(CROWDED).parquet(self._uri(beside)).count()
        state = json.loads(json.dumps(self.manifest))
        state["version"] = version
        state["replaced"].append({"files": state["files"]["log"], "by": file})
        state["files"]["log"] = [{"file": file, "rows": last, "first": 1, "last": last, "settled": True, "crowded": beside if crowded else None}]
        self.manifest = state
        self._fold()

    def archive_segments_before(self, id: int) -> None:
        """Moves log batches that lie below id, the last one and a snapshot excepted, to log/archive; they are read from there."""
        self.require_writable("archive_segments_before")
        for entry in self.manifest["files"]["log"][:-1]:
            source = self.root / entry["file"]
            if entry["last"] < id and source.exists() and "settled" not in entry:
                target = listing.archived(self.root, entry["file"])
                target.parent.mkdir(exist_ok=True)
                os.replace(source, target)
                listing.sync(target.parent)

    def _uri(self, file: str) -> str:
        return f"file://{listing.place(self.root, file).resolve()}"

    def table(self, name: str, files: list[dict] | None = None) -> DataFrame:
        """Exactly the listed files, hot or archived."""
        listed = self.manifest["files"][name] if files is None else files
        if not listed:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(self._uri(e["file"]) for e in listed))

    def log_tail(self, after: int) -> DataFrame:
        """Records after an identifier; batches that lie below aren't opened."""
        files = [e for e in self.manifest["files"]["log"] if e["last"] > after]
        return self.table("log", files).where(F.col("id") > F.lit(after))

    def tables(self) -> Tables:
        """What is committed now."""
        merges = self.table("merges") if self.manifest["files"]["merges"] else None
        files, known = self.manifest["files"]["log"], {"last_id": self.next("assertion") - 1}
        if files and "settled" in files[0]:
            known["settled"] = self.spark.read.schema(SETTLED).parquet(self._uri(files[0]["file"]))
            if files[0]["crowded"]:
                known["crowded"] = self.spark.read.schema(CROWDED).parquet(self._uri(files[0]["crowded"]))
            if files[1:]:
                known |= {"tail": self.table("log", files[1:]), "tail_links": sum(e["links"] for e in files[1:])}
        return Tables(self.table("log"), self.table("entities"), self.table("predicates"), merges, self.table("provenance"), self.table("payloads"), **known)

    def payload_ids(self) -> DataFrame:
        return self.table("payloads").select("id").orderBy("id")


def check_batch(size: int) -> None:
    if size > MAX_BATCH:
        raise EngineError(f"a batch holds {MAX_BATCH} entries at most")
