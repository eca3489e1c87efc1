"""The engine's semantics row by row in plain Python, and a seeded corpus: what the plans are held against."""

from __future__ import annotations

import random

from factloom.functions.values import Value, text
from factloom.plans.ir import AggregateQuery, Aggregation, Filter, GroupBy, Query
from factloom.schema import STATUS_NAMES

TIMES = [0, 1000, 2000, 3000, 4000, 5000]
OBJECTS = {101: text("Acme"), 102: text("Beta"), 103: Value("int64", 42), 104: Value("int64", 7), 105: Value("double", 2.5), 106: Value("bool", True)}
PREDICATES = {1: "works_at", 2: "lives_in", 3: "score"}
SUBJECTS = {i: text(f"subject-{i}") for i in range(1, 13)}
MERGED = {123456: 3}


def corpus(seed: int, n: int) -> list[dict]:
    """A log with hypotheses, corrections (records that were closed already among their targets), closed intervals and backdating."""
    rng, rows = random.Random(seed), []
    for id in range(1, n + 1):
        row = {
            "id": id, "subject": rng.choice([*SUBJECTS, 123456]), "predicate": rng.choice([*PREDICATES]), "object": rng.choice([*OBJECTS, 999999]),
            "valid_from": rng.choice(TIMES), "valid_to": 0 if rng.random() < 0.5 else rng.choice(TIMES), "observed_at": rng.choice(TIMES) - rng.choice([0, 0, 500]),
            "confidence": rng.randrange(101) / 100, "appended_status": 4 if rng.random() < 1 / 7 else 0, "supersedes_id": 0, "retracts_id": 0,
        }
        if rows and rng.random() < 0.25:
            target = rng.randrange(1, id)
            if rng.random() < 0.5:
                row["supersedes_id"] = target
            else:
                row["retracts_id"], row["appended_status"] = target, 3
        rows.append(row)
    return rows


def statuses(log: list[dict], as_of_commit=None, as_of_observed=None) -> list[dict]:
    seen = [r for r in log if (as_of_commit is None or r["id"] <= as_of_commit) and (as_of_observed is None or r["observed_at"] <= as_of_observed)]
    code = {r["id"]: r["appended_status"] for r in seen}
    order = sorted(seen, key=lambda r: (r["observed_at"], r["id"])) if as_of_observed is not None else sorted(seen, key=lambda r: r["id"])
    for r in order:
        for link, closed in (("supersedes_id", 1), ("retracts_id", 2)):
            if r[link] in code:
                code[r[link]] = closed
    return [{**{k: v for k, v in r.items() if k != "appended_status"}, "status": STATUS_NAMES[code[r["id"]]]} for r in seen]


def _compare(op: str, a, b) -> bool:
    return {"eq": a == b, "ne": a != b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[op]


def matches(f: Filter, row: dict) -> bool:
    if f.kind == "and":
        return all(matches(c, row) for c in f.children)
    if f.kind == "or":
        return any(matches(c, row) for c in f.children)
    if f.kind == "not":
        return not matches(f.children[0], row)
    if f.field == "object_value":
        value = OBJECTS.get(row["object"])
        return value is not None and value.kind == f.value.kind and _compare(f.op, value.value, f.value.value)
    return _compare(f.op, row[f.field], f.value.value)


def selected(log: list[dict], q: Query) -> list[dict]:
    resolve = lambda x: MERGED.get(x, x)
    out = []
    for r in statuses(log, q.as_of_commit, q.as_of_observed):
        if q.subject is not None and r["subject"] != resolve(q.subject) or q.predicate is not None and r["predicate"] != q.predicate or q.object is not None and r["object"] != resolve(q.object):
            continue
        if q.valid_at is not None and not (r["valid_from"] <= q.valid_at and (r["valid_to"] == 0 or q.valid_at < r["valid_to"])):
            continue
        if q.observed_from is not None and r["observed_at"] < q.observed_from or q.observed_to is not None and r["observed_at"] > q.observed_to:
            continue
        if q.open_ended_only and r["valid_to"] != 0 or q.statuses and r["status"] not in q.statuses or q.filter is not None and not matches(q.filter, r):
            continue
        out.append(r)
    return sorted(out, key=lambda r: (r[q.order], r["id"]), reverse=q.newest_first)


def aggregated(log: list[dict], q: AggregateQuery) -> list[tuple]:
    def key(r: dict) -> tuple:
        out = []
        for g in q.group_by:
            out.append((r[t := g.field.removesuffix("_bucket")] // g.bucket_width * g.bucket_width) if g.field.endswith("_bucket") else r[t := g.field])
        return tuple(out)

    def number(r: dict, target: str):
        if target != "object_value":
            return float(r[target])
        v = OBJECTS.get(r["object"])
        return float(v.value) if v is not None and v.kind in ("int64", "double", "timestamp") else None

    groups: dict[tuple, list[dict]] = {}
    for r in selected(log, q.selection):
        groups.setdefault(key(r), []).append(r)
    out = []
    for k, rows in sorted(groups.items()):
        cells = []
        for a in q.aggregations:
            numbers = [x for x in (number(r, a.target) for r in rows) if x is not None]
            if a.function == "count":
                cells.append(len(rows))
            elif a.function == "count_distinct":
                cells.append(len({r["object"] for r in rows if r["object"] in OBJECTS} if a.target == "object_value" else {r[a.target] for r in rows}))
            elif not numbers:
                cells.append(None)
            else:
                cells.append({"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x)}[a.function](numbers))
        out.append((k, len(rows), cells))
    return out


def random_filter(rng: random.Random, depth: int = 1) -> Filter:
    if depth < 4 and rng.random() < 0.4:
        kind = rng.choice(["and", "or", "not"])
        return Filter(kind, children=tuple(random_filter(rng, depth + 1) for _ in range(1 if kind == "not" else rng.randrange(1, 4))))
    op = rng.choice(["eq", "ne", "lt", "lte", "gt", "gte"])
    name = rng.choice(["subject", "predicate", "object", "object_value", "object_value", "confidence", "valid_from", "valid_to", "observed_at", "status"])
    if name == "object_value":
        return Filter.compare(name, op, rng.choice([*OBJECTS.values(), Value("int64", 10), text("Az"), Value("timestamp", 42), Value("double", 42.0)]))
    if name == "confidence":
        return Filter.compare(name, op, Value("double", rng.randrange(101) / 100))
    if name == "status":
        return Filter.compare(name, op, text(rng.choice(STATUS_NAMES)))
    if name in ("subject", "predicate", "object"):
        return Filter.compare(name, op, Value("int64", rng.choice({"subject": [*SUBJECTS, 123456], "predicate": [*PREDICATES], "object": [*OBJECTS, 999999]}[name])))
    return Filter.compare(name, op, Value("timestamp", rng.choice(TIMES)))


def random_query(rng: random.Random, n: int, paging: bool = True) -> Query:
    maybe = lambda p, f: f() if rng.random() < p else None
    given = {
        "subject": maybe(0.3, lambda: rng.choice([*SUBJECTS, 123456])), "predicate": maybe(0.25, lambda: rng.choice([*PREDICATES])), "object": maybe(0.2, lambda: rng.choice([*OBJECTS, 999999])),
        "valid_at": maybe(0.25, lambda: rng.choice(TIMES)), "observed_from": maybe(0.2, lambda: rng.choice(TIMES)), "observed_to": maybe(0.2, lambda: rng.choice(TIMES)),
        "open_ended_only": rng.random() < 0.2, "statuses": tuple(rng.sample(STATUS_NAMES, rng.randrange(1, 4))) if rng.random() < 0.4 else (), "filter": maybe(0.5, lambda: random_filter(rng)),
    }
    way = rng.random()
    if way < 0.25:
        given["as_of_commit"] = rng.randrange(n + 3)
    elif way < 0.5:
        given["as_of_observed"] = rng.choice(TIMES)
    if paging:
        given |= {"order": rng.choice(["id", "valid_from", "observed_at"]), "newest_first": rng.random() < 0.5, "limit": rng.choice([0, 3, 10]), "offset": rng.choice([0, 0, 2])}
    return Query(**given)


def random_aggregate(rng: random.Random, n: int) -> AggregateQuery:
    targets = ["object_value", "confidence", "valid_from", "valid_to", "observed_at", "subject", "predicate", "object"]
    functions = tuple(Aggregation(rng.choice(["count", "count_distinct", "sum", "min", "max", "avg"]), rng.choice(targets)) for _ in range(rng.randrange(1, 4)))
    groups = tuple(GroupBy(g, 700 if g.endswith("_bucket") else 0) for g in rng.sample(["subject", "predicate", "object", "status", "valid_from_bucket", "observed_at_bucket"], rng.randrange(3)))
    return AggregateQuery(random_query(rng, n, paging=False), functions, groups)
