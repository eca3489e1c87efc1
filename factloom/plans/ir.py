"""The query IR: filters, queries and aggregate queries as frozen values, their validation and JSON."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from ..functions.values import Value
from ..schema import IR_VERSION, MAX_FILTER_DEPTH, MAX_GROUP_FIELDS, MAX_OFFSET, STATUS_NAMES, EngineError
from .cursor import Cursor

#: Filter fields and the kind their operand must have (None: any).
FILTER_FIELDS = {
    "subject": "int64", "predicate": "int64", "object": "int64", "object_value": None, "confidence": "double",
    "valid_from": "timestamp", "valid_to": "timestamp", "observed_at": "timestamp", "status": "text",
}
OPS = ("eq", "ne", "lt", "lte", "gt", "gte")
ORDERS = ("id", "valid_from", "observed_at")
FUNCTIONS = ("count", "count_distinct", "sum", "min", "max", "avg")
TARGETS = ("object_value", "confidence", "valid_from", "valid_to", "observed_at", "subject", "predicate", "object")
GROUP_FIELDS = ("subject", "predicate", "object", "status", "valid_from_bucket", "observed_at_bucket")


@dataclass(frozen=True)
class Filter:
    """A comparison, or and/or/not over children."""

    kind: str
    field: str | None = None
    op: str | None = None
    value: Value | None = None
    children: tuple[Filter, ...] = ()

    @staticmethod
    def compare(field: str, op: str, value: Value) -> Filter:
        return Filter("comparison", field, op, value)

    @staticmethod
    def all_of(*children: Filter) -> Filter:
        return Filter("and", children=children)

    @staticmethod
    def any_of(*children: Filter) -> Filter:
        return Filter("or", children=children)

    @staticmethod
    def negate(child: Filter) -> Filter:
        return Filter("not", children=(child,))

    def validate(self, depth: int = 1) -> None:
        if depth > MAX_FILTER_DEPTH:
            raise EngineError(f"a filter may be nested {MAX_FILTER_DEPTH} levels deep")
        if self.kind == "comparison":
            if self.field not in FILTER_FIELDS:
                raise EngineError(f"no such field to filter by: {self.field}")
            if self.op not in OPS:
                raise EngineError(f"unknown comparison: {self.op}")
            if self.value is None:
                raise EngineError("a comparison needs a value")
            want = FILTER_FIELDS[self.field]
            if want is not None and self.value.kind != want:
                raise EngineError(f"filter on {self.field} has an operand of the wrong kind")
            if self.field == "status" and self.value.value not in STATUS_NAMES:
                raise EngineError(f"unknown status name in filter: {self.value.value}")
        elif self.kind in ("and", "or"):
            if not self.children:
                raise EngineError("'and' and 'or' take one child or more")
        elif self.kind == "not":
            if len(self.children) != 1:
                raise EngineError("'not' takes a single child")
        else:
            raise EngineError(f"no such kind of filter: {self.kind}")
        for child in self.children:
            child.validate(depth + 1)

    def names(self, field: str) -> bool:
        return self.field == field or any(c.names(field) for c in self.children)

    def to_json(self) -> dict:
        if self.kind == "comparison":
            return {"kind": self.kind, "field": self.field, "op": self.op, "value": self.value.to_json()}
        return {"kind": self.kind, "children": [c.to_json() for c in self.children]}

    @staticmethod
    def from_json(node, depth: int = 1) -> Filter:
        if depth > MAX_FILTER_DEPTH:
            raise EngineError(f"a filter may be nested {MAX_FILTER_DEPTH} levels deep")
        if not isinstance(node, dict) or "kind" not in node:
            raise EngineError("a filter is an object with a kind")
        try:
            if node["kind"] == "comparison":
                out = Filter.compare(node["field"], node["op"], Value.from_json(node["value"]))
            else:
                if not isinstance(node.get("children"), list):
                    raise EngineError("a filter's children are an array")
                out = Filter(node["kind"], children=tuple(Filter.from_json(c, depth + 1) for c in node["children"]))
        except KeyError as missing:
            raise EngineError(f"filter lacks {missing}") from missing
        out.validate(depth)
        return out


_TESTS = ("force_scan", "force_row_scan")


@dataclass(frozen=True)
class Query:
    """A shaped read; every part is optional."""

    ir_version: int = IR_VERSION
    subject: int | None = None
    predicate: int | None = None
    object: int | None = None
    valid_at: int | None = None
    observed_from: int | None = None
    observed_to: int | None = None
    open_ended_only: bool = False
    statuses: tuple[str, ...] = ()
    filter: Filter | None = None
    resolve_names: bool = False
    order: str = "id"
    newest_first: bool = False
    limit: int = 0
    offset: int = 0
    cursor: str = ""
    max_rows_examined: int = 0
    as_of_commit: int | None = None
    as_of_observed: int | None = None
    # for tests only, and no part of the JSON: what explain_query may not choose; rows never depend on them
    force_scan: bool = False
    force_row_scan: bool = False

    def validate(self) -> None:
        if self.ir_version != IR_VERSION:
            raise EngineError(f"this engine reads IR version {IR_VERSION} alone")
        if self.order not in ORDERS:
            raise EngineError(f"no such order: {self.order}")
        for name in self.statuses:
            if name not in STATUS_NAMES:
                raise EngineError(f"unknown status: {name}")
        if min(self.limit, self.offset, self.max_rows_examined) < 0:
            raise EngineError("limit, offset and max_rows_examined are never negative")
        if self.offset > MAX_OFFSET:
            raise EngineError(f"an offset is {MAX_OFFSET} at most; a cursor goes further")
        if self.filter is not None:
            self.filter.validate()
        if self.as_of_commit is not None and self.as_of_observed is not None:
            raise EngineError("as_of_commit and as_of_observed exclude each other")
        self.decoded_cursor()

    def decoded_cursor(self) -> Cursor | None:
        if not self.cursor:
            return None
        if self.offset:
            raise EngineError("a cursor and an offset exclude each other")
        cursor = Cursor.decode(self.cursor)
        if (cursor.order, cursor.newest_first) != (self.order, self.newest_first):
            raise EngineError("the cursor belongs to another ordering")
        return cursor

    @property
    def is_as_of(self) -> bool:
        return self.as_of_commit is not None or self.as_of_observed is not None

    @property
    def is_current_shaped(self) -> bool:
        return set(self.statuses) == {"Active"} and self.open_ended_only

    def to_json(self) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) not in (None, "", ()) and f.name not in _TESTS}
        if self.filter is not None:
            out["filter"] = self.filter.to_json()
        if self.statuses:
            out["statuses"] = list(self.statuses)
        return out

    @staticmethod
    def from_json(args: dict) -> Query:
        given = {f.name: args[f.name] for f in fields(Query) if args.get(f.name) is not None and f.name not in _TESTS}
        for name in given.keys() - {"statuses", "filter", "order", "cursor", "open_ended_only", "resolve_names", "newest_first"}:
            if not isinstance(given[name], int) or isinstance(given[name], bool):
                raise EngineError(f"{name} must be an integer")
        for name in given.keys() & {"open_ended_only", "resolve_names", "newest_first"}:
            if not isinstance(given[name], bool):
                raise EngineError(f"{name} must be a boolean")
        if "statuses" in given:
            if not isinstance(given["statuses"], (list, tuple)):
                raise EngineError("statuses are an array")
            given["statuses"] = tuple(given["statuses"])
        if "filter" in given:
            given["filter"] = Filter.from_json(given["filter"])
        return Query(**given)


@dataclass(frozen=True)
class Aggregation:
    function: str
    target: str = "object_value"


@dataclass(frozen=True)
class GroupBy:
    field: str
    bucket_width: int = 0


@dataclass(frozen=True)
class AggregateQuery:
    selection: Query = field(default_factory=Query)
    aggregations: tuple[Aggregation, ...] = ()
    group_by: tuple[GroupBy, ...] = ()
    max_groups: int = 0

    def validate(self) -> None:
        s = self.selection
        if s.ir_version != IR_VERSION:
            raise EngineError(f"this engine reads IR version {IR_VERSION} alone")
        if not self.aggregations:
            raise EngineError("an aggregate without aggregations")
        if len(self.group_by) > MAX_GROUP_FIELDS:
            raise EngineError(f"grouping takes {MAX_GROUP_FIELDS} fields at most")
        for a in self.aggregations:
            if a.function not in FUNCTIONS:
                raise EngineError(f"no such aggregation: {a.function}")
            if a.target not in TARGETS:
                raise EngineError(f"nothing to aggregate is called {a.target}")
        for g in self.group_by:
            if g.field not in GROUP_FIELDS:
                raise EngineError(f"no such field to group by: {g.field}")
            if g.field.endswith("_bucket") and g.bucket_width <= 0:
                raise EngineError("buckets need a bucket_width above zero")
        if s.limit or s.offset or s.cursor or s.newest_first or s.resolve_names or s.order != "id":
            raise EngineError("an aggregate's selection takes no limit, offset, cursor, ordering or resolve_names")
        s.validate()

    @staticmethod
    def from_json(args: dict) -> AggregateQuery:
        if not isinstance(args.get("aggregations"), list):
            raise EngineError("aggregations are an array")
        if not isinstance(args.get("group_by") or [], list):
            raise EngineError("group_by is an array")
        aggregations = []
        for a in args["aggregations"]:
            if a.get("function") != "count" and not a.get("target"):
                raise EngineError("an aggregation needs a target")
            aggregations.append(Aggregation(a.get("function"), a.get("target") or "object_value"))
        groups = tuple(GroupBy(g.get("field"), g.get("bucket_width") or 0) for g in args.get("group_by") or [])
        return AggregateQuery(Query.from_json(args), tuple(aggregations), groups, args.get("max_groups") or 0)
