"""Queries and aggregate queries as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bucket, covers, status_name
from ..functions.values import Value, field, literal, numeric
from ..operators.merges import few_redirects, follow, resolve
from ..schema import ASSERTION, MAX_GROUPS, MAX_RESULT_ROWS, STATUS_NAMES, BudgetExceeded
from .cursor import Cursor
from .ir import AggregateQuery, Filter, GroupBy, Query
from .status import in_scope, statuses


@dataclass(frozen=True)
class Tables:
    """The tables that reads need. resolve maps an identifier through entity merges.

    settled: the part of log that a snapshot holds, with statuses; crowded: links that didn't fit into it; tail: the records behind it, None if there are none, of which
    tail_links close another. Without settled, statuses come from the whole log. last_id: the last record's identifier, if the store knows it.
    """

    log: DataFrame
    entities: DataFrame
    predicates: DataFrame
    merges: DataFrame | None = None
    provenance: DataFrame | None = None
    payloads: DataFrame | None = None
    settled: DataFrame | None = None
    crowded: DataFrame | None = None
    tail: DataFrame | None = None
    tail_links: int = 0
    last_id: int | None = None

    @cached_property
    def redirects(self) -> dict[int, int] | None:
        """All redirects, if they are few."""
        return {} if self.merges is None else few_redirects(self.merges)

    def resolve(self, entity: int | None) -> int | None:
        if entity is None or self.redirects == {}:
            return entity
        return resolve(self.merges, entity) if self.redirects is None else follow(self.redirects, entity)


_COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}


def _leaf(f: Filter) -> Column:
    if f.field == "object_value":
        # two-valued logic: no value, or one of another kind, makes every comparison false, so that not() of it is true
        held = F.coalesce(F.col("object_value")["kind"] == F.lit(f.value.code), F.lit(False))
        return held & F.coalesce(getattr(field(F.col("object_value"), f.value.code), _COMPARE[f.op])(literal(f.value)), F.lit(False))
    column = status_name(F.col("status_code")) if f.field == "status" else F.col(f.field)
    return getattr(column, _COMPARE[f.op])(literal(f.value))


def condition(f: Filter) -> Column:
    if f.kind == "comparison":
        return _leaf(f)
    parts = [condition(c) for c in f.children]
    if f.kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if f.kind == "and" else out | p
    return out


def _and(parts: list[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def selectors(query: Query, tables: Tables) -> Column | None:
    """Conditions on stored columns; they reach the scan. Arguments are resolved through merges, stored identifiers aren't."""
    parts = []
    if query.subject is not None:
        parts.append(F.col("subject") == F.lit(tables.resolve(query.subject)))
    if query.predicate is not None:
        parts.append(F.col("predicate") == F.lit(query.predicate))
    if query.object is not None:
        parts.append(F.col("object") == F.lit(tables.resolve(query.object)))
    if query.valid_at is not None:
        parts.append(covers(F.col("valid_from"), F.col("valid_to"), F.lit(query.valid_at)))
    if query.observed_from is not None:
        parts.append(F.col("observed_at") >= F.lit(query.observed_from))
    if query.observed_to is not None:
        parts.append(F.col("observed_at") <= F.lit(query.observed_to))
    if query.open_ended_only:
        parts.append(F.col("valid_to") == 0)
    return _and(parts)


def with_object_value(rows: DataFrame, tables: Tables) -> DataFrame:
    values = tables.entities.select(F.col("id").alias("__entity"), F.col("value").alias("object_value"))
    return rows.join(values, F.col("object") == F.col("__entity"), "left").drop("__entity")


def select_rows(query: Query, tables: Tables, value: bool = False) -> DataFrame:
    """All matching rows, unordered. value: keep object_value."""
    rows = statuses(tables, query.as_of_commit, query.as_of_observed, selectors(query, tables))
    if query.statuses:
        rows = rows.where(F.col("status_code").isin([STATUS_NAMES.index(s) for s in query.statuses]))
    needs = query.filter is not None and query.filter.names("object_value")
    if needs or value:
        rows = with_object_value(rows, tables)
    if query.filter is not None:
        rows = rows.where(condition(query.filter))
    return rows.drop("object_value") if needs and not value else rows


def shown(rows: DataFrame, *more: str) -> DataFrame:
    """The eleven fields in their order, status by name."""
    return rows.withColumn("status", status_name(F.col("status_code"))).select(*ASSERTION, *more)


def ordering(query: Query) -> list[Column]:
    keys = ["id"] if query.order == "id" else [query.order, "id"]
    return [F.col(k).desc() if query.newest_first else F.col(k).asc() for k in keys]


def after(cursor: Cursor) -> Column:
    key, at = F.col(cursor.order), F.lit(cursor.key)
    if cursor.order == "id":
        return F.col("id") < cursor.id if cursor.newest_first else F.col("id") > cursor.id
    if cursor.newest_first:
        return (key < at) | ((key == at) & (F.col("id") < cursor.id))
    return (key > at) | ((key == at) & (F.col("id") > cursor.id))


def check_budget(query: Query, tables: Tables) -> None:
    """Rows examined: those that subject and observed-time selectors leave of the visible log if a subject is named, else the visible log."""
    if not query.max_rows_examined:
        return
    rows = tables.log
    scope = in_scope(query.as_of_commit, query.as_of_observed)
    if scope is not None:
        rows = rows.where(scope)
    if query.subject is not None:
        rows = rows.where(F.col("subject") == F.lit(tables.resolve(query.subject)))
        if query.observed_to is not None:
            rows = rows.where(F.col("observed_at") <= F.lit(query.observed_to))
    n = rows.limit(query.max_rows_examined + 1).count()
    if n > query.max_rows_examined:
        raise BudgetExceeded("max_rows_examined", query.max_rows_examined, n)


def page_size(query: Query) -> int:
    return MAX_RESULT_ROWS if query.limit == 0 else min(query.limit, MAX_RESULT_ROWS)


def page(query: Query, tables: Tables, more: int = 0) -> DataFrame:
    """One page of a query, in order, with `more` rows beyond it."""
    query.validate()
    rows = select_rows(query, tables)
    cursor = query.decoded_cursor()
    if cursor is not None:
        rows = rows.where(after(cursor))
    rows = rows.orderBy(*ordering(query))
    if query.offset:
        rows = rows.offset(query.offset)
    return shown(rows.limit(page_size(query) + more))


def with_names(rows: DataFrame, tables: Tables) -> DataFrame:
    """subject_name (text values only), predicate_name and object_value beside the rows given; join after the limit."""
    subjects = tables.entities.where(F.col("value")["kind"] == 0).select(F.col("id").alias("__s"), F.col("value")["text"].alias("subject_name"))
    predicates = tables.predicates.select(F.col("id").alias("__p"), F.col("name").alias("predicate_name"))
    rows = rows.join(subjects, F.col("subject") == F.col("__s"), "left").drop("__s").join(predicates, F.col("predicate") == F.col("__p"), "left").drop("__p")
    return with_object_value(rows, tables)


@dataclass(frozen=True)
class QueryResult:
    assertions: list[dict]
    truncated: bool
    next_cursor: str = ""
    names: list[dict] | None = None


def run_query(query: Query, tables: Tables) -> QueryResult:
    query.validate()
    check_budget(query, tables)
    size = page_size(query)
    frame = page(query, tables, more=1)
    if query.resolve_names:
        frame = with_names(frame, tables).orderBy(*ordering(query))
    found = frame.collect()
    rows, truncated = found[:size], len(found) > size
    cursor = ""
    if truncated and rows:
        cursor = Cursor(query.order, query.newest_first, rows[-1][query.order], rows[-1]["id"]).encode()
    names = None
    if query.resolve_names:
        names = [{"subject_name": r["subject_name"], "predicate_name": r["predicate_name"], "object_value": Value.from_row(r["object_value"])} for r in rows]
    return QueryResult([{c: r[c] for c in ASSERTION} for r in rows], truncated, cursor, names)


def group_key(g: GroupBy) -> Column:
    if g.field == "status":
        return status_name(F.col("status_code"))
    if g.field.endswith("_bucket"):
        return bucket(F.col(g.field.removesuffix("_bucket")), g.bucket_width)
    return F.col(g.field)


def _aggregate(function: str, target: str) -> Column:
    if function == "count":
        return F.count(F.lit(1))
    if function == "count_distinct":
        # interning maps values to identifiers one to one, so where a value exists the identifier stands for it
        return F.count_distinct(F.when(F.col("object_value").isNotNull(), F.col("object")) if target == "object_value" else F.col(target))
    number = numeric(F.col("object_value")) if target == "object_value" else F.col(target).cast("double")
    return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[function](number)


def aggregate(query: AggregateQuery, tables: Tables) -> DataFrame:
    """key_0.., row_count, value_0.. in key order; no group without rows, the global one included."""
    query.validate()
    value = any(a.target == "object_value" and a.function != "count" for a in query.aggregations)
    rows = select_rows(query.selection, tables, value)
    keys = [group_key(g).alias(f"key_{i}") for i, g in enumerate(query.group_by)]
    cells = [_aggregate(a.function, a.target).alias(f"value_{i}") for i, a in enumerate(query.aggregations)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *cells)
    if not keys:
        return out.where("row_count > 0")
    return out.orderBy(*(f"key_{i}" for i in range(len(keys))))


def run_aggregate(query: AggregateQuery, tables: Tables) -> list[dict]:
    """[{key, row_count, values}]; more groups than allowed is an error, never a part."""
    query.validate()
    check_budget(query.selection, tables)
    most = MAX_GROUPS if query.max_groups == 0 else min(query.max_groups, MAX_GROUPS)
    found = aggregate(query, tables).limit(most + 1).collect()
    if len(found) > most:
        raise BudgetExceeded("max_groups", most, most + 1)
    kinds = ["text" if g.field == "status" else "timestamp" if g.field.endswith("_bucket") else "int64" for g in query.group_by]
    return [
        {"key": [Value(k, r[f"key_{i}"]) for i, k in enumerate(kinds)], "row_count": r["row_count"], "values": [r[f"value_{i}"] for i in range(len(query.aggregations))]}
        for r in found
    ]
