"""Every public operation as a named command with typed arguments: one table drives dispatch, argument checks and tool schemas."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass

from .functions.values import KINDS, Value
from .kernel import Kernel, Pending, PendingNamed, Provenance
from .plans import ir
from .plans.compile import QueryResult
from .schema import STATUS_NAMES, EngineError

_INTEGER, _NUMBER, _STRING, _BOOLEAN = ({"type": t} for t in ("integer", "number", "string", "boolean"))
_VALUE = {"type": "object", "properties": {"kind": {"type": "string", "enum": list(KINDS)}, "value": {}}, "required": ["kind", "value"]}
_TIMES = (("valid_from", "time"), ("valid_to", "time"), ("observed_at", "time"), ("confidence", "double"))
_FACT = (("subject", "id"), ("predicate", "id"), ("object", "id"), *_TIMES)
_NAMED = (("subject_name", "string"), ("predicate_name", "string"), ("object", "value"), *_TIMES)
_RECORD = (("assertion_id", "id"), ("source", "id"), ("recorded_at", "time"), ("method", "string"))


def _integer(x) -> int:
    if not isinstance(x, int) or isinstance(x, bool) or not -(1 << 63) <= x < 1 << 63:
        raise EngineError(f"expected an integer, got {x!r}")
    return x


def _id(x) -> int:
    if _integer(x) < 0:
        raise EngineError(f"expected an identifier, got {x!r}")
    return x


def _double(x) -> float:
    if not isinstance(x, (int, float)) or isinstance(x, bool):
        raise EngineError(f"expected a number, got {x!r}")
    return float(x)


def _typed(kind: type, what: str) -> Callable:
    def parse(x):
        if not isinstance(x, kind):
            raise EngineError(f"expected {what}, got {x!r}")
        return x

    return parse


def _bytes(x) -> bytes:
    try:
        return base64.b64decode(_typed(str, "a string")(x), validate=True)
    except ValueError as error:
        raise EngineError("content isn't base64") from error


def _entries(fields: tuple, make: type) -> Callable:
    def parse(x):
        if not isinstance(x, list):
            raise EngineError("entries are an array")
        return [make(**_arguments(e, fields)) for e in x]

    return parse


def _ids(x) -> list[int]:
    if not isinstance(x, list):
        raise EngineError("ids are an array")
    return [_id(i) for i in x]


def _object(fields) -> dict:
    return {"type": "object", "properties": {n: _TYPES[t.rstrip("?")][0] for n, t in fields}, "required": [n for n, t in fields if not t.endswith("?")]}


_TYPES: dict[str, tuple[dict, Callable]] = {
    "id": (_INTEGER, _id),
    "time": (_INTEGER, _integer),
    "size": (_INTEGER, _id),
    "double": (_NUMBER, _double),
    "string": (_STRING, _typed(str, "a string")),
    "bool": (_BOOLEAN, _typed(bool, "a boolean")),
    "bytes": (_STRING | {"contentEncoding": "base64"}, _bytes),
    "value": (_VALUE, lambda x: Value.from_json(x)),
    "ids": ({"type": "array", "items": _INTEGER}, _ids),
}


def _arguments(args: dict, fields) -> dict:
    if not isinstance(args, dict):
        raise EngineError("arguments must be an object")
    out = {}
    for name, kind in fields:
        if args.get(name) is None:
            if kind.endswith("?"):
                continue
            raise EngineError(f"missing argument: {name}")
        out[name] = _TYPES[kind.rstrip("?")][1](args[name])
    return out


_TYPES["entries"] = ({"type": "array", "items": _object(_FACT)}, _entries(_FACT, Pending))
_TYPES["named"] = ({"type": "array", "items": _object(_NAMED)}, _entries(_NAMED, PendingNamed))
_TYPES["records"] = ({"type": "array", "items": _object(_RECORD)}, _entries(_RECORD, Provenance))

_FILTER = {"type": "object", "properties": {"kind": {"type": "string", "enum": ["comparison", "and", "or", "not"]}, "field": {"type": "string", "enum": list(ir.FILTER_FIELDS)}, "op": {"type": "string", "enum": list(ir.OPS)}, "value": _VALUE, "children": {"type": "array"}}, "required": ["kind"]}
_SELECTION = {
    "ir_version": _INTEGER, "subject": _INTEGER, "predicate": _INTEGER, "object": _INTEGER, "valid_at": _INTEGER, "observed_from": _INTEGER, "observed_to": _INTEGER,
    "open_ended_only": _BOOLEAN, "statuses": {"type": "array", "items": {"type": "string", "enum": list(STATUS_NAMES)}}, "filter": _FILTER,
    "max_rows_examined": _INTEGER, "as_of_commit": _INTEGER, "as_of_observed": _INTEGER,
}
_PAGING = {"resolve_names": _BOOLEAN, "order": {"type": "string", "enum": list(ir.ORDERS)}, "newest_first": _BOOLEAN, "limit": _INTEGER, "offset": _INTEGER, "cursor": _STRING}
_AGGREGATE = {
    "aggregations": {"type": "array", "items": {"type": "object", "properties": {"function": {"type": "string", "enum": list(ir.FUNCTIONS)}, "target": {"type": "string", "enum": list(ir.TARGETS)}}, "required": ["function"]}},
    "group_by": {"type": "array", "items": {"type": "object", "properties": {"field": {"type": "string", "enum": list(ir.GROUP_FIELDS)}, "bucket_width": _INTEGER}, "required": ["field"]}},
    "max_groups": _INTEGER,
}


@dataclass(frozen=True)
class Command:
    name: str
    says: str
    fields: tuple = ()
    mutates: bool = False
    schema: dict | None = None
    run: Callable | None = None

    def input_schema(self) -> dict:
        return self.schema or _object(self.fields)

    def execute(self, kernel: Kernel, args: dict):
        if self.run is not None:
            return self.run(kernel, args)
        given = _arguments(args, self.fields)
        facts = {n for n, _ in _FACT}
        if {n for n, _ in self.fields} > facts:  # a fact and something about it
            return getattr(kernel, self.name)(*(given[n] for n, _ in _FACT), **{n: given[n] for n, _ in self.fields if n not in facts})
        return getattr(kernel, self.name)(**given)


def _query_schema(*more: dict, required: tuple = ()) -> dict:
    properties = {}
    for part in more:
        properties |= part
    return {"type": "object", "properties": properties, "required": list(required)}


def _spill(kernel: Kernel, args: dict):
    return kernel.spill_query(ir.Query.from_json(args), token=_TYPES["string"][1](args.get("token") or ""))


_SUBJECT, _PREDICATE, _LIMIT = ("subject", "id"), ("predicate", "id"), ("limit", "size?")
COMMANDS = {
    c.name: c
    for c in (
        Command("commit", "Commits an active assertion.", _FACT, True),
        Command("commit_by_name", "Commits an active assertion by names and a value, which are interned as needed.", _NAMED, True),
        Command("commit_batch", "Commits up to 10,000 active assertions at once, all or none; ids in the order given.", (("entries", "entries"),), True),
        Command("commit_batch_by_name", "As commit_batch, by names and values.", (("entries", "named"),), True),
        Command("commit_retraction", "Commits a record that retracts another.", (*_FACT, ("retracts_id", "id")), True),
        Command("commit_superseding", "Commits a record that replaces another.", (*_FACT, ("supersedes_id", "id")), True),
        Command("write_snapshot", "Rewrites the log as one sorted data set.", (), True),
        Command("intern_entity", "The id of a name, new if need be.", (("name", "string"),), True),
        Command("intern_value", "The id of a value, new if need be.", (("value", "value"),), True),
        Command("intern_predicate", "The id of a predicate's name, new if need be.", (("name", "string"),), True),
        Command("intern_document", "Stores bytes under a new id.", (("content", "bytes"),), True),
        Command("record_provenance", "Records where an assertion comes from.", _RECORD, True),
        Command("record_provenance_batch", "Records up to 10,000 sources at once; one unknown assertion rejects all.", (("records", "records"),), True),
        Command("commit_hypothesis", "Commits a hypothesis with its source.", (*_FACT, ("source", "id"), ("recorded_at", "time"), ("method", "string")), True),
        Command("merge_entities", "Redirects reads of one entity to another.", (("keep", "id"), ("absorb", "id"), ("merged_at", "time")), True),
        Command("archive_segments_before", "Moves batches below an id to the archive; reads don't change.", (("assertion_id", "id"),), True),
        Command("get", "One assertion by id.", (("id", "id"),)),
        Command("assertions_for_subject", "All assertions of a subject, any status, in commit order.", (_SUBJECT, _LIMIT)),
        Command("current", "Active open-ended assertions of a subject.", (_SUBJECT,)),
        Command("current_by_name", "As current, by the subject's name; none if it isn't interned.", (("subject_name", "string"),)),
        Command("current_by_object", "Active open-ended assertions about an object.", (("object", "id"),)),
        Command("current_by_predicate", "Active open-ended assertions of a predicate.", (_PREDICATE,)),
        Command("valid_at", "Active assertions valid at a time.", (_SUBJECT, ("valid_time", "time"))),
        Command("known_at", "Assertions observed by a time and active now.", (_SUBJECT, ("observed_time", "time"))),
        Command("valid_at_known_at", "Both cut-offs.", (_SUBJECT, ("valid_time", "time"), ("observed_time", "time"))),
        Command("valid_time_timeline", "Active assertions of subject and predicate by valid_from.", (_SUBJECT, _PREDICATE)),
        Command("observed_time_timeline", "Active assertions of subject and predicate by observed_at.", (_SUBJECT, _PREDICATE)),
        Command("commit_history", "All assertions of subject and predicate in commit order.", (_SUBJECT, _PREDICATE, _LIMIT)),
        Command("changes_since", "Everything observed at a time or later.", (("observed_since", "time"), _LIMIT, ("newest_first", "bool?"))),
        Command("explain", "The chain of corrections from an assertion to its root.", (("id", "id"),)),
        Command("find_conflicts", "Active assertions of subject and predicate that overlap and differ in the object.", (_SUBJECT, _PREDICATE)),
        Command("find_entity", "The id of a name, if interned.", (("name", "string"),)),
        Command("find_value", "The id of a value, if interned.", (("value", "value"),)),
        Command("find_predicate", "The id of a predicate's name, if interned.", (("name", "string"),)),
        Command("entity_name", "The name behind an id.", (("id", "id"),)),
        Command("entity_value", "The value behind an id.", (("id", "id"),)),
        Command("predicate_name", "The predicate behind an id.", (("id", "id"),)),
        Command("document_content", "Stored bytes, as base64.", (("id", "id"),)),
        Command("provenance_for", "The source recorded last for an assertion.", (("assertion_id", "id"),)),
        Command("entity_name_batch", "Names of up to 10,000 ids, in the order asked.", (("ids", "ids"),)),
        Command("entity_value_batch", "Values of up to 10,000 ids, in the order asked.", (("ids", "ids"),)),
        Command("predicate_name_batch", "Predicates of up to 10,000 ids, in the order asked.", (("ids", "ids"),)),
        Command("provenance_for_batch", "Sources of up to 10,000 assertions, in the order asked.", (("assertion_ids", "ids"),)),
        Command("query", "A shaped read: selectors, filter, order and paging.", schema=_query_schema(_SELECTION, _PAGING), run=lambda k, a: k.query(ir.Query.from_json(a))),
        Command("query_spill", "Writes a query's whole result as columns.", schema=_query_schema(_SELECTION, _PAGING, {"token": _STRING}), run=_spill),
        Command("explain_query", "What a query would examine, and why.", schema=_query_schema(_SELECTION, _PAGING), run=lambda k, a: k.explain_query(ir.Query.from_json(a))),
        Command("aggregate", "Aggregates of matching assertions, by group.", schema=_query_schema({"aggregations": _AGGREGATE["aggregations"]}, _SELECTION, _AGGREGATE, required=("aggregations",)), run=lambda k, a: {"groups": k.aggregate(ir.AggregateQuery.from_json(a))}),
        Command("describe_predicates", "Predicates with their current rows."),
        Command("describe_corpus", "Counts and spans of the store."),
        Command("hypotheses_for", "Hypotheses about a subject.", (_SUBJECT,)),
        Command("neighbors", "Entities within some hops over current assertions.", (_SUBJECT, ("max_hops", "size"))),
        Command("co_occurring_predicates", "Predicates of a subject's current assertions.", (_SUBJECT,)),
        Command("resolve_entity", "The entity that reads of an id go to.", (("id", "id"),)),
    )
}


def to_json(result):
    """Results as JSON values."""
    if isinstance(result, Value):
        return result.to_json()
    if isinstance(result, bytes):
        return base64.b64encode(result).decode()
    if isinstance(result, QueryResult):
        out = {"assertions": to_json(result.assertions), "truncated": result.truncated}
        if result.next_cursor:
            out["next_cursor"] = result.next_cursor
        if result.names:
            out["names"] = to_json(result.names)
        return out
    if isinstance(result, tuple):
        return {"a": to_json(result[0]), "b": to_json(result[1])}
    if isinstance(result, list):
        return [to_json(x) for x in result]
    if isinstance(result, dict):
        return {k: to_json(v) for k, v in result.items()}
    return result


def execute(kernel: Kernel, name: str, args: dict | None = None):
    if name not in COMMANDS:
        raise EngineError(f"no such tool: {name}")
    return COMMANDS[name].execute(kernel, args or {})


def call_tool(kernel: Kernel, name: str, args: dict | None = None) -> tuple[str, bool]:
    """(text, is_error): a tool's failure is an answer, never an exception."""
    try:
        return json.dumps(to_json(execute(kernel, name, args)), ensure_ascii=False), False
    except Exception as error:
        return f"error: {error}", True
