"""Plans against the brute force of brute.py, and fixed scripts."""

import random

import pytest
from brute import MERGED, OBJECTS, PREDICATES, SUBJECTS, aggregated, corpus, random_aggregate, random_query, selected, statuses

from factloom.functions.values import Value, text
from factloom.operators import conflicts
from factloom.plans.compile import Tables, run_aggregate, run_query
from factloom.plans.cursor import Cursor
from factloom.plans.ir import AggregateQuery, Aggregation, Filter, GroupBy, Query
from factloom.plans.status import with_status
from factloom.schema import ENTITIES, LOG, MERGES, PREDICATES as PREDICATE_SCHEMA, BudgetExceeded, EngineError

N = 160


def tables_of(spark, rows):
    entities = spark.createDataFrame([(i, tuple(v.fields().values())) for i, v in {**SUBJECTS, **OBJECTS}.items()], ENTITIES)
    predicates = spark.createDataFrame(list(PREDICATES.items()), PREDICATE_SCHEMA)
    merges = spark.createDataFrame([(i, a, s, 1) for i, (a, s) in enumerate(MERGED.items())], MERGES)
    log = spark.createDataFrame([tuple(r[c] for c in LOG.names) for r in rows], LOG)
    return Tables(log.coalesce(1), entities.coalesce(1).cache(), predicates, merges.coalesce(1).cache())


@pytest.fixture(scope="module")
def script():
    return corpus(20_260, N)


@pytest.fixture(scope="module")
def tables(spark, script):
    out = tables_of(spark, script)
    return Tables(out.log.cache(), out.entities, out.predicates, out.merges)


def test_random_queries(tables, script):
    rng, found = random.Random(5), 0
    for _ in range(60):
        q = random_query(rng, N)
        want = selected(script, q)
        size = q.limit or 10_000
        got = run_query(q, tables)
        assert got.assertions == want[q.offset : q.offset + size], q
        assert got.truncated == (len(want) > q.offset + size)
        found += bool(got.assertions)
        if q.order and got.truncated and not q.offset:
            second = run_query(Query(**{**q.__dict__, "cursor": got.next_cursor}), tables)
            assert second.assertions == want[size : 2 * size]
    assert found > 12


def test_random_aggregates(tables, script):
    rng = random.Random(6)
    for _ in range(40):
        q = random_aggregate(rng, N)
        got = [(tuple(k.value for k in g["key"]), g["row_count"], g["values"]) for g in run_aggregate(q, tables)]
        want = aggregated(script, q)
        assert [g[:2] for g in got] == [w[:2] for w in want], q
        for g, w in zip(got, want):
            assert g[2] == pytest.approx(w[2]), q


def test_as_of_commit_is_a_replay(spark, tables, script):
    for n in (0, 1, 2, 5, 17, 80, N, N + 5):
        now = {r["id"]: r["status_code"] for r in with_status(tables_of(spark, script[:n]).log).collect()} if n else {}
        assert {r["id"]: r["status_code"] for r in with_status(tables.log, as_of_commit=n).collect()} == now


def test_double_closing(spark):
    base = {"subject": 1, "predicate": 1, "object": 101, "valid_from": 0, "valid_to": 0, "confidence": 1.0, "appended_status": 0, "supersedes_id": 0, "retracts_id": 0}
    rows = [{**base, "id": 1, "observed_at": 100}, {**base, "id": 2, "observed_at": 200, "supersedes_id": 1}, {**base, "id": 3, "observed_at": 150, "retracts_id": 1, "appended_status": 3}]
    log = tables_of(spark, rows).log
    status = lambda **k: {r["id"]: r["status_code"] for r in with_status(log, **k).collect()}
    assert status()[1] == 2 and status(as_of_commit=2)[1] == 1 and status(as_of_commit=1)[1] == 0
    assert status(as_of_observed=160) == {1: 2, 3: 3} and status(as_of_observed=200)[1] == 1 and status(as_of_observed=100) == {1: 0}


def test_statuses_of_brute_force_agree(tables, script):
    got = {r["id"]: r["status_code"] for r in with_status(tables.log, as_of_observed=2500).collect()}
    assert len(got) == len(statuses(script, as_of_observed=2500))


@pytest.mark.parametrize(
    "query",
    [
        Query(ir_version=2), Query(as_of_commit=1, as_of_observed=1), Query(cursor="x"), Query(cursor="flc2:id:asc:1:1"), Query(cursor="flc1:id:asc:1:0"), Query(cursor="flc1:id:asc:1:1", offset=1),
        Query(cursor="flc1:id:desc:1:1"), Query(filter=Filter("and")), Query(filter=Filter("not", children=(Filter.compare("subject", "eq", Value("int64", 1)),) * 2)),
        Query(filter=Filter.compare("confidence", "eq", Value("int64", 1))), Query(filter=Filter.compare("status", "eq", text("Gone"))), Query(statuses=("Gone",)), Query(limit=-1),
    ],
)
def test_rejected_queries(tables, query):
    with pytest.raises(EngineError):
        run_query(query, tables)


def test_depth():
    f = Filter.compare("subject", "eq", Value("int64", 1))
    for _ in range(7):
        f = Filter.negate(f)
    Query(filter=f).validate()
    with pytest.raises(EngineError):
        Query(filter=Filter.negate(f)).validate()


@pytest.mark.parametrize(
    "query",
    [
        AggregateQuery(), AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("subject"),) * 5), AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("valid_from_bucket"),)),
        AggregateQuery(Query(limit=1), (Aggregation("count"),)), AggregateQuery(Query(resolve_names=True), (Aggregation("count"),)), AggregateQuery(aggregations=(Aggregation("median"),)),
    ],
)
def test_rejected_aggregates(tables, query):
    with pytest.raises(EngineError):
        run_aggregate(query, tables)


def test_budgets(tables):
    with pytest.raises(BudgetExceeded, match="max_rows_examined: 6 is more than 5"):
        run_query(Query(max_rows_examined=5), tables)
    with pytest.raises(BudgetExceeded, match="5 is more than 4"):
        run_aggregate(AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("subject"),), max_groups=4), tables)


def test_names(tables, script):
    got = run_query(Query(limit=30, resolve_names=True), tables)
    for row, name in zip(got.assertions, got.names):
        assert name["subject_name"] == (SUBJECTS[row["subject"]].value if row["subject"] in SUBJECTS else None)
        assert name["predicate_name"] == PREDICATES[row["predicate"]] and name["object_value"] == OBJECTS.get(row["object"])


def test_json_round_trip():
    q = Query(subject=3, statuses=("Active",), filter=Filter.any_of(Filter.compare("object_value", "gt", Value("double", 1.5)), Filter.negate(Filter.compare("status", "eq", text("Active")))), limit=4, order="valid_from")
    assert Query.from_json(q.to_json()) == q
    c = Cursor("valid_from", True, -5, 9)
    assert Cursor.decode(c.encode()) == c


def test_selectors_reach_the_scan(spark, tmp_path, tables):
    tables.log.write.parquet(str(tmp_path / "log"))
    stored = Tables(spark.read.schema(LOG).parquet(str(tmp_path / "log")), tables.entities, tables.predicates)
    from factloom.plans.compile import page

    plan = page(Query(subject=3, observed_to=4000), stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject,3)" in plan and "LessThanOrEqual(observed_at,4000)" in plan


@pytest.mark.parametrize("together", [5, 5_000])
def test_conflicts_of_large_groups(spark, tables, script, together):
    """The same pairs, however many slices a group is cut into; each once."""
    now = [r for r in statuses(script) if r["status"] == 0 or r["status"] == "Active"]
    overlap = lambda a, b: (b["valid_to"] == 0 or a["valid_from"] < b["valid_to"]) and (a["valid_to"] == 0 or b["valid_from"] < a["valid_to"])
    want = sorted(
        (a["id"], b["id"]) for a in now for b in now
        if a["id"] < b["id"] and a["subject"] == b["subject"] and a["predicate"] == b["predicate"] and a["object"] != b["object"] and overlap(a, b)
    )
    got = sorted((r["a_id"], r["b_id"]) for r in conflicts.conflicts(tables, together=together).collect())
    assert got == want and want
