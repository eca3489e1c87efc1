"""The engine over a store: commits, interning, provenance, merges, and every read, answered as plain values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import FIELDS, Value
from .operators import conflicts, describe, graph, reads
from .plans.compile import QueryResult, Tables, run_aggregate, run_query, shown
from .plans.ir import AggregateQuery, Query
from .schema import ACTIVE, HYPOTHESIS, MAX_BATCH, MAX_READ_ROWS, RETRACTION, VALUE_DDL, BudgetExceeded, EngineError
from .sinks import spill
from .sources.named import load_by_name
from .sources.store import Store, check_batch


@dataclass(frozen=True)
class Pending:
    subject: int
    predicate: int
    object: int
    valid_from: int
    valid_to: int
    observed_at: int
    confidence: float


@dataclass(frozen=True)
class PendingNamed:
    subject_name: str
    predicate_name: str
    object: Value
    valid_from: int
    valid_to: int
    observed_at: int
    confidence: float


@dataclass(frozen=True)
class Provenance:
    assertion_id: int
    source: int
    recorded_at: int
    method: str


class Kernel:
    """All public operations. Reads see what is committed when they start; the clock is never read."""

    def __init__(self, spark: SparkSession, root: str | Path, read_only: bool = False, spill_directory: str | Path | None = None):
        self.spark, self.store = spark, Store(spark, root, read_only)
        self.spill_directory = None if spill_directory is None else Path(spill_directory)

    @classmethod
    def over(cls, store: Store) -> Kernel:
        """The operations of a store that is open already."""
        kernel = cls.__new__(cls)
        kernel.spark, kernel.store, kernel.spill_directory = store.spark, store, None
        return kernel

    def close(self) -> None:
        self.store.close()

    def __enter__(self) -> Kernel:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def tables(self) -> Tables:
        return self.store.tables()

    # ---- commits

    def _rows(self, pending: Sequence[Pending], status: int = ACTIVE, supersedes: int = 0, retracts: int = 0) -> list[dict]:
        first = self.store.next("assertion")
        return [
            {
                "id": first + i, "subject": p.subject, "predicate": p.predicate, "object": p.object, "valid_from": p.valid_from, "valid_to": p.valid_to,
                "observed_at": p.observed_at, "confidence": float(p.confidence), "appended_status": status, "supersedes_id": supersedes, "retracts_id": retracts,
            }
            for i, p in enumerate(pending)
        ]

    def _known(self, id: int, what: str) -> None:
        if not 0 < id < self.store.next("assertion"):
            raise EngineError(f"{what} of a record that isn't there")

    def commit(self, subject: int, predicate: int, object: int, valid_from: int, valid_to: int, observed_at: int, confidence: float) -> int:
        self.store.require_writable("commit")
        return self.commit_batch([Pending(subject, predicate, object, valid_from, valid_to, observed_at, confidence)])[0]

    def commit_batch(self, entries: Sequence[Pending]) -> list[int]:
        self.store.require_writable("commit_batch")
        check_batch(len(entries))
        rows = self._rows(entries)
        if rows:
            self.store.append({"log": rows}, assertion=len(rows))
        return [r["id"] for r in rows]

    def commit_by_name(self, subject_name: str, predicate_name: str, object: Value, valid_from: int, valid_to: int, observed_at: int, confidence: float) -> int:
        self.store.require_writable("commit_by_name")
        return self.commit_batch_by_name([PendingNamed(subject_name, predicate_name, object, valid_from, valid_to, observed_at, confidence)])[0]

    def commit_batch_by_name(self, entries: Sequence[PendingNamed]) -> list[int]:
        self.store.require_writable("commit_batch_by_name")
        check_batch(len(entries))
        if not entries:
            return []
        values = [v for e in entries for v in (Value("text", e.subject_name), e.object)]
        entity, new_entities = self._interned(values)
        predicate, new_predicates = self._interned_predicates([e.predicate_name for e in entries])
        pending = [Pending(entity[2 * i], predicate[i], entity[2 * i + 1], e.valid_from, e.valid_to, e.observed_at, e.confidence) for i, e in enumerate(entries)]
        rows = self._rows(pending)
        self.store.append({"entities": new_entities, "predicates": new_predicates, "log": rows}, entity=len(new_entities), predicate=len(new_predicates), assertion=len(rows))
        return [r["id"] for r in rows]

    def load_by_name(self, rows: DataFrame, order: str) -> int:
        """commit_batch_by_name for a whole table, in the order of one of its columns and in one commit; values are numbered by Spark. Returns how many rows."""
        return load_by_name(self.store, rows, order)

    def together(self):
        """A block whose commits become one at its end, all or nothing."""
        return self.store.together()

    def commit_retraction(self, *fields, retracts_id: int) -> int:
        self.store.require_writable("commit_retraction")
        self._known(retracts_id, "retraction")
        rows = self._rows([Pending(*fields)], RETRACTION, retracts=retracts_id)
        self.store.append({"log": rows}, assertion=1)
        return rows[0]["id"]

    def commit_superseding(self, *fields, supersedes_id: int) -> int:
        self.store.require_writable("commit_superseding")
        self._known(supersedes_id, "superseding")
        rows = self._rows([Pending(*fields)], supersedes=supersedes_id)
        self.store.append({"log": rows}, assertion=1)
        return rows[0]["id"]

    def commit_hypothesis(self, *fields, source: int, recorded_at: int, method: str) -> int:
        """A hypothesis and its provenance, both or neither."""
        self.store.require_writable("commit_hypothesis")
        rows = self._rows([Pending(*fields)], HYPOTHESIS)
        self.store.append({"log": rows, "provenance": self._records([Provenance(rows[0]["id"], source, recorded_at, method)])}, assertion=1, seq=1)
        return rows[0]["id"]

    # ---- interning

    def _interned(self, values: Sequence[Value]) -> tuple[list[int], list[dict]]:
        """Identifiers of values, and the rows to append for new ones, numbered as first seen. One join looks all of them up."""
        asked = list(dict.fromkeys(v for v in values if not v.is_nan))
        known: dict[Value, int] = {}
        if asked and self.store.manifest["files"]["entities"]:
            rows = [tuple(v.fields()[f] for f in ("kind", *FIELDS)) for v in asked]
            wanted = self.spark.createDataFrame(rows, VALUE_DDL)
            held = self.store.table("entities").select("id", "value.*")
            same = F.lit(True)
            for f in ("kind", *FIELDS):
                same = same & wanted[f].eqNullSafe(held[f])
            for r in held.join(F.broadcast(wanted), same, "left_semi").collect():  # at most two values an entry of a batch
                known[Value.from_row(r)] = r["id"]
        if waiting := self.store.held("entities"):
            wanted_values = set(asked)
            for r in waiting:
                if (v := Value.from_row(r["value"])) in wanted_values:
                    known.setdefault(v, r["id"])
        out, new, first = [], [], self.store.next("entity")
        for v in values:
            id = None if v.is_nan else known.get(v)
            if id is None:
                id = first + len(new)
                new.append({"id": id, "value": v.fields()})
                if not v.is_nan:
                    known[v] = id
            out.append(id)
        return out, new

    def _interned_predicates(self, names: Sequence[str]) -> tuple[list[int], list[dict]]:
        known: dict[str, int] = {}
        if self.store.manifest["files"]["predicates"]:
            wanted = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name STRING")
            known = {r["name"]: r["id"] for r in self.store.table("predicates").join(F.broadcast(wanted), "name", "left_semi").collect()}
        for r in self.store.held("predicates"):
            known.setdefault(r["name"], r["id"])
        new: list[dict] = []
        for name in names:
            if name not in known:
                known[name] = self.store.next("predicate") + len(new)
                new.append({"id": known[name], "name": name})
        return [known[n] for n in names], new

    def intern_value(self, value: Value) -> int:
        self.store.require_writable("intern_value")
        ids, new = self._interned([value])
        if new:
            self.store.append({"entities": new}, entity=1)
        return ids[0]

    def intern_entity(self, name: str) -> int:
        self.store.require_writable("intern_entity")
        return self.intern_value(Value("text", name))

    def intern_predicate(self, name: str) -> int:
        self.store.require_writable("intern_predicate")
        ids, new = self._interned_predicates([name])
        if new:
            self.store.append({"predicates": new}, predicate=1)
        return ids[0]

    def intern_document(self, content: bytes) -> int:
        """Always a new identifier, from the entities' numbers."""
        self.store.require_writable("intern_document")
        id = self.store.next("entity")
        self.store.append({"payloads": [{"id": id, "content": content}]}, entity=1)
        return id

    # ---- provenance, merges, maintenance

    def _records(self, records: Sequence[Provenance]) -> list[dict]:
        first = self.store.next("seq")
        return [{"seq": first + i, "assertion_id": r.assertion_id, "source": r.source, "recorded_at": r.recorded_at, "method": r.method} for i, r in enumerate(records)]

    def record_provenance(self, assertion_id: int, source: int, recorded_at: int, method: str) -> None:
        self.store.require_writable("record_provenance")
        self.record_provenance_batch([Provenance(assertion_id, source, recorded_at, method)])

    def record_provenance_batch(self, records: Sequence[Provenance]) -> None:
        self.store.require_writable("record_provenance_batch")
        check_batch(len(records))
        for r in records:
            self._known(r.assertion_id, "provenance")
        if records:
            self.store.append({"provenance": self._records(records)}, seq=len(records))

    def merge_entities(self, keep: int, absorb: int, merged_at: int) -> None:
        self.store.require_writable("merge_entities")
        self.store.append({"merges": [{"seq": self.store.next("seq"), "absorbed": absorb, "surviving": keep, "merged_at": merged_at}]}, seq=1)

    def write_snapshot(self) -> None:
        self.store.write_snapshot()

    def archive_segments_before(self, assertion_id: int) -> None:
        self.store.archive_segments_before(assertion_id)

    # ---- reads

    @staticmethod
    def _list(frame: DataFrame) -> list[dict]:
        """All rows as values; more than MAX_READ_ROWS are an error, never a part."""
        found = frame.limit(MAX_READ_ROWS + 1).collect()
        if len(found) > MAX_READ_ROWS:
            raise BudgetExceeded("max_read_rows", MAX_READ_ROWS, len(found))
        return [r.asDict() for r in found]

    @staticmethod
    def _one(frame: DataFrame, column: str):
        row = frame.first()
        return None if row is None else row[column]

    def get(self, id: int) -> dict | None:
        found = self._list(reads.get(self.tables, id))
        return found[0] if found else None

    def assertions_for_subject(self, subject: int, limit: int = 0) -> list[dict]:
        return self._list(reads.assertions_for_subject(self.tables, subject, limit))

    def current(self, subject: int) -> list[dict]:
        return self._list(reads.current(self.tables, subject).orderBy("id"))

    def current_by_name(self, subject_name: str) -> list[dict]:
        return self._list(reads.current_by_name(self.tables, subject_name).orderBy("id"))

    def current_by_object(self, object: int) -> list[dict]:
        return self._list(reads.current_by_object(self.tables, object).orderBy("id"))

    def current_by_predicate(self, predicate: int) -> list[dict]:
        return self._list(reads.current_by_predicate(self.tables, predicate).orderBy("id"))

    def hypotheses_for(self, subject: int) -> list[dict]:
        return self._list(reads.hypotheses_for(self.tables, subject).orderBy("id"))

    def valid_at(self, subject: int, valid_time: int) -> list[dict]:
        return self._list(reads.valid_at(self.tables, subject, valid_time).orderBy("id"))

    def known_at(self, subject: int, observed_time: int) -> list[dict]:
        return self._list(reads.known_at(self.tables, subject, observed_time).orderBy("id"))

    def valid_at_known_at(self, subject: int, valid_time: int, observed_time: int) -> list[dict]:
        return self._list(reads.valid_at_known_at(self.tables, subject, valid_time, observed_time).orderBy("id"))

    def valid_time_timeline(self, subject: int, predicate: int) -> list[dict]:
        return self._list(reads.valid_time_timeline(self.tables, subject, predicate))

    def observed_time_timeline(self, subject: int, predicate: int) -> list[dict]:
        return self._list(reads.observed_time_timeline(self.tables, subject, predicate))

    def commit_history(self, subject: int, predicate: int, limit: int = 0) -> list[dict]:
        return self._list(reads.commit_history(self.tables, subject, predicate, limit))

    def changes_since(self, observed_since: int, limit: int = 0, newest_first: bool = False) -> list[dict]:
        return self._list(reads.changes_since(self.tables, observed_since, limit, newest_first))

    def explain(self, id: int) -> list[dict]:
        return graph.explain(self.tables, id) if 0 < id < self.store.next("assertion") else []

    def find_conflicts(self, subject: int, predicate: int) -> list[tuple[dict, dict]]:
        tables = self.tables
        pairs = [(r["a_id"], r["b_id"]) for r in self._list(conflicts.find_conflicts(tables, subject, predicate).select("a_id", "b_id").orderBy("a_id", "b_id"))]
        rows = {r["id"]: r for r in self._list(shown(reads.rows(tables, (F.col("subject") == F.lit(tables.resolve(subject))) & (F.col("predicate") == F.lit(predicate)))))} if pairs else {}
        return [(rows[a], rows[b]) for a, b in pairs]

    def find_entity(self, name: str) -> int | None:
        return self.find_value(Value("text", name))

    def find_value(self, value: Value) -> int | None:
        return self._one(reads.find_value(self.tables, value), "id")

    def find_predicate(self, name: str) -> int | None:
        return self._one(reads.find_predicate(self.tables, name), "id")

    def entity_value(self, id: int) -> Value | None:
        return Value.from_row(self._one(reads.entity_value(self.tables, id), "value"))

    def entity_name(self, id: int) -> str | None:
        value = self.entity_value(id)
        return value.value if value is not None and value.kind == "text" else None

    def predicate_name(self, id: int) -> str | None:
        return self._one(reads.predicate_name(self.tables, id), "name")

    def document_content(self, id: int) -> bytes | None:
        found = self._one(reads.document_content(self.tables, id), "content")
        return None if found is None else bytes(found)

    def provenance_for(self, assertion_id: int) -> dict | None:
        found = self._list(reads.last_provenance(self.tables).where(F.col("assertion_id") == F.lit(assertion_id)))
        return found[0] if found else None

    def _answers(self, ids: Sequence[int], found: DataFrame, key: str, make) -> list:
        if len(ids) > MAX_BATCH:
            raise EngineError(f"a batch holds {MAX_BATCH} entries at most")
        if not ids:
            return []
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos INT, id BIGINT")
        return [make(r) for r in reads.answers(asked, found, key).collect()]

    def entity_name_batch(self, ids: Sequence[int]) -> list[str | None]:
        return self._answers(ids, reads.entity_names(self.tables), "entity", lambda r: r["name"])

    def entity_value_batch(self, ids: Sequence[int]) -> list[Value | None]:
        return self._answers(ids, self.tables.entities.withColumnRenamed("id", "entity"), "entity", lambda r: Value.from_row(r["value"]))

    def predicate_name_batch(self, ids: Sequence[int]) -> list[str | None]:
        return self._answers(ids, self.tables.predicates.withColumnRenamed("id", "predicate"), "predicate", lambda r: r["name"])

    def provenance_for_batch(self, assertion_ids: Sequence[int]) -> list[dict | None]:
        def make(r):
            return None if r["method"] is None else {"assertion_id": r["id"], "source": r["source"], "recorded_at": r["recorded_at"], "method": r["method"]}

        return self._answers(assertion_ids, reads.last_provenance(self.tables), "assertion_id", make)

    def neighbors(self, subject: int, max_hops: int = 1) -> list[int]:
        return [r["entity"] for r in self._list(graph.neighbors(self.tables, subject, max_hops).orderBy("hops", "entity"))]

    def co_occurring_predicates(self, subject: int) -> list[int]:
        return [r["predicate"] for r in self._list(graph.co_occurring_predicates(self.tables, subject).orderBy("predicate"))]

    def resolve_entity(self, id: int) -> int:
        return self.tables.resolve(id)

    def query(self, query: Query) -> QueryResult:
        return run_query(query, self.tables)

    def aggregate(self, query: AggregateQuery) -> list[dict]:
        return run_aggregate(query, self.tables)

    def explain_query(self, query: Query) -> dict:
        return describe.explain_query(query, self.tables)

    def spill_query(self, query: Query, directory: str | Path | None = None, token: str = "", columns: str = "parquet") -> dict:
        where = directory or self.spill_directory
        if where is None:
            raise EngineError("no spill directory is configured")
        return spill.spill(query, self.tables, where, token, columns)

    def describe_predicates(self) -> list[dict]:
        return self._list(describe.describe_predicates(self.tables).orderBy("id"))

    def describe_corpus(self) -> dict:
        found = describe.describe_corpus(self.tables).first().asDict()
        names = ("Active", "Superseded", "Retracted", "Retraction", "Hypothesis")
        counts = {n: found.pop(n.lower()) for n in names}
        return found | {"status_counts": counts, "entity_count": self.store.next("entity") - 1, "predicate_count": self.store.next("predicate") - 1}
