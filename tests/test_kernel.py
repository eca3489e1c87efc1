"""The store, every command, the tool surface, spills and the change feed."""

import io
import json
import os

import numpy as np
import pytest
from brute import corpus
from pyspark.sql import functions as F

from factloom import mcp
from factloom.commands import COMMANDS, call_tool, execute
from factloom.functions.values import Value, text
from factloom.operators import describe, graph, merges, reads
from factloom.kernel import Kernel, Pending, PendingNamed, Provenance
from factloom.plans.ir import Query
from factloom.plans.status import statuses
from factloom.plans.compile import Tables
from factloom.schema import LOG, MERGES, BudgetExceeded, EngineError
from factloom.sinks import spill
from factloom.sources import manifest
from factloom.sources.store import FOLD, Store
from factloom.streaming.changes import changes, follow


@pytest.fixture
def kernel(spark, tmp_path):
    with Kernel(spark, tmp_path / "root", spill_directory=tmp_path / "spills") as k:
        yield k


def fact(s, p, o, vf=0, vt=0, obs=100, conf=0.9):
    return Pending(s, p, o, vf, vt, obs, conf)


def ids(rows):
    return [r["id"] for r in rows]


def test_script(kernel):
    """Commits, corrections and a hypothesis; every read of the same facts."""
    alice, bob, acme, beta = (kernel.intern_entity(n) for n in ("Alice", "Bob", "Acme", "Beta"))
    works, lives = kernel.intern_predicate("works_at"), kernel.intern_predicate("lives_in")
    assert (alice, bob, acme, beta, works, lives) == (1, 2, 3, 4, 1, 2) and kernel.intern_entity("Alice") == 1
    assert kernel.commit_batch([fact(1, 1, 3, 2020, 2023, 10), fact(1, 1, 4, 2023, 0, 20), fact(1, 2, 3, 2020, 0, 10, 0.8), fact(2, 1, 3, 2023, 0, 30, 0.7)]) == [1, 2, 3, 4]
    assert kernel.commit_superseding(2, 1, 4, 2023, 0, 40, 0.9, supersedes_id=4) == 5
    assert kernel.commit_hypothesis(1, 2, 4, 2024, 0, 50, 0.5, source=2, recorded_at=55, method="guess") == 6
    assert kernel.commit(2, 2, 3, 2020, 0, 20, 0.6) == 7
    assert kernel.commit_retraction(2, 2, 3, 2020, 0, 60, 1.0, retracts_id=7) == 8
    with pytest.raises(EngineError, match="retraction of a record"):
        kernel.commit_retraction(2, 2, 3, 2020, 0, 60, 1.0, retracts_id=99)
    with pytest.raises(EngineError, match="superseding of a record"):
        kernel.commit_superseding(2, 2, 3, 2020, 0, 60, 1.0, supersedes_id=0)
    assert kernel.store.next("assertion") == 9
    assert [kernel.get(i)["status"] for i in range(1, 9)] == ["Active", "Active", "Active", "Superseded", "Active", "Hypothesis", "Retracted", "Retraction"]
    assert kernel.get(0) is None and kernel.get(9) is None
    assert ids(kernel.current(1)) == [2, 3] and ids(kernel.current_by_name("Bob")) == [5] and kernel.current_by_name("Nobody") == []
    assert ids(kernel.current_by_object(3)) == [3] and ids(kernel.current_by_predicate(1)) == [2, 5] and ids(kernel.hypotheses_for(1)) == [6]
    assert ids(kernel.valid_at(1, 2022)) == [1, 3] and ids(kernel.known_at(1, 10)) == [1, 3] and ids(kernel.valid_at_known_at(1, 2023, 15)) == [3]
    assert ids(kernel.valid_time_timeline(1, 1)) == [1, 2] and ids(kernel.observed_time_timeline(1, 1)) == [1, 2]
    assert ids(kernel.commit_history(2, 2)) == [7, 8] and ids(kernel.commit_history(2, 2, 1)) == [7] and ids(kernel.assertions_for_subject(2, 2)) == [4, 5]
    assert ids(kernel.changes_since(40)) == [5, 6, 8] and ids(kernel.changes_since(0, 2, True)) == [8, 6]
    assert ids(kernel.explain(5)) == [5, 4] and ids(kernel.explain(8)) == [8, 7] and kernel.explain(77) == []
    assert kernel.provenance_for(6) == {"assertion_id": 6, "source": 2, "recorded_at": 55, "method": "guess"} and kernel.provenance_for(1) is None
    kernel.record_provenance_batch([Provenance(1, 4, 1, "a"), Provenance(1, 3, 2, "b")])
    assert kernel.provenance_for(1)["method"] == "b"
    with pytest.raises(EngineError, match="provenance of a record"):
        kernel.record_provenance_batch([Provenance(2, 1, 1, "x"), Provenance(99, 1, 1, "x")])
    assert [p and p["method"] for p in kernel.provenance_for_batch([1, 2, 6, 1])] == ["b", None, "guess", "b"]
    assert kernel.neighbors(1, 1) == [3, 4] and kernel.neighbors(1, 2) == [3, 4, 2] and kernel.neighbors(1, 0) == [] and kernel.co_occurring_predicates(1) == [1, 2]
    kernel.merge_entities(1, 777, 5)
    kernel.merge_entities(777, 778, 6)
    assert kernel.resolve_entity(778) == 1 and ids(kernel.current(778)) == [2, 3] and kernel.neighbors(778, 1) == [3, 4]
    kernel.merge_entities(900, 901, 1)
    kernel.merge_entities(901, 900, 2)
    assert kernel.resolve_entity(900) == 900
    assert kernel.entity_name_batch([1, 99, 1]) == ["Alice", None, "Alice"] and kernel.entity_name_batch([]) == [] and kernel.predicate_name_batch([2, 3]) == ["lives_in", None]
    assert kernel.describe_predicates() == [{"id": 1, "name": "works_at", "current_rows": 2}, {"id": 2, "name": "lives_in", "current_rows": 1}]
    corpus = kernel.describe_corpus()
    assert corpus["assertion_count"] == 8 and corpus["status_counts"] == {"Active": 4, "Superseded": 1, "Retracted": 1, "Retraction": 1, "Hypothesis": 1} and corpus["entity_count"] == 4
    plan = kernel.explain_query(Query(subject=1, statuses=("Active",), open_ended_only=True, predicate=1))
    assert plan["chosen"] == "columnar_scan" and [c["source"] for c in plan["considered"]] == ["subject_index", "observed_time_index", "object_current_index", "predicate_current_index", "columnar_scan", "row_scan"]
    why = {c["source"]: c.get("rejected_because") for c in kernel.explain_query(Query(predicate=1, as_of_commit=3, force_row_scan=True))["considered"]}
    reasons = describe.REASONS
    assert why == {"subject_index": reasons["subject"], "object_current_index": reasons["object"], "predicate_current_index": reasons["as_of"], "columnar_scan": reasons["force_row_scan"], "row_scan": None}
    before = ids(kernel.query(Query()).assertions)
    kernel.archive_segments_before(5)
    assert (kernel.store.root / "log" / "archive").exists() and ids(kernel.query(Query()).assertions) == before
    kernel.write_snapshot()
    kernel.commit(1, 1, 3, 1, 0, 1, 1.0)
    assert ids(kernel.query(Query()).assertions) == [*before, 9] and kernel.get(4)["status"] == "Superseded"
    assert ids(r.asDict() for r in kernel.store.log_tail(7).orderBy("id").collect()) == [8, 9]


def test_conflicts(kernel):
    kernel.commit_batch([fact(1, 1, 3, 2023, 0), fact(1, 1, 4, 2024, 0), fact(1, 1, 3, 2025, 0), fact(1, 1, 5, 2020, 2023), fact(1, 1, 6, 9, 9)])
    assert [(a["id"], b["id"]) for a, b in kernel.find_conflicts(1, 1)] == [(1, 2), (2, 3)]
    assert kernel.find_conflicts(1, 2) == []


def test_interning(kernel):
    values = [text("42"), Value("int64", 42), Value("double", 42.0), Value("timestamp", 42), Value("bool", True), Value("double", -0.0), Value("double", 0.0)]
    got = [kernel.intern_value(v) for v in values]
    assert got == [1, 2, 3, 4, 5, 6, 6] and [kernel.intern_value(v) for v in values] == got
    assert kernel.intern_value(Value("double", float("nan"))) == 7 and kernel.intern_value(Value("double", float("nan"))) == 8 and kernel.find_value(Value("double", float("nan"))) is None
    assert kernel.intern_document(b"\0x") == 9 and kernel.intern_document(b"\0x") == 10 and kernel.document_content(9) == b"\0x" and kernel.document_content(1) is None
    assert kernel.commit_batch_by_name([PendingNamed("A", "p", text("B"), 0, 0, 1, 1.0), PendingNamed("B", "q", Value("int64", 42), 0, 0, 1, 1.0), PendingNamed("A", "p", text("C"), 0, 0, 1, 1.0)]) == [1, 2, 3]
    rows = kernel.query(Query(resolve_names=True))
    assert [(r["subject"], r["predicate"], r["object"]) for r in rows.assertions] == [(11, 1, 12), (12, 2, 2), (11, 1, 13)]
    assert [n["subject_name"] for n in rows.names] == ["A", "B", "A"] and kernel.find_entity("C") == 13 and kernel.find_predicate("q") == 2 and kernel.find_entity("D") is None
    assert kernel.entity_value_batch([2, 9, 12]) == [Value("int64", 42), None, text("B")] and kernel.entity_name(2) is None


def test_batches(kernel):
    assert kernel.commit_batch([]) == [] and kernel.store.manifest["version"] == 0
    with pytest.raises(EngineError, match="entries at most"):
        kernel.commit_batch_by_name([PendingNamed("A", "p", text("B"), 0, 0, 1, 1.0)] * 10_001)
    assert kernel.store.next("entity") == 1


def test_store(spark, tmp_path):
    with pytest.raises(EngineError):
        Store(spark, tmp_path / "none", read_only=True)
    with Kernel(spark, tmp_path / "s") as k:
        k.commit_batch([fact(1, 1, 2), fact(1, 1, 3)])
        with pytest.raises(EngineError, match="one writer"):
            Store(spark, tmp_path / "s")
        with Kernel(spark, tmp_path / "s", read_only=True) as reader:
            k.commit(1, 1, 4, 0, 0, 1, 1.0)
            assert len(reader.query(Query()).assertions) == 2  # pinned when opened
            before = sorted(os.walk(tmp_path / "s"))
            with pytest.raises(EngineError, match="commit needs a writer"):
                reader.commit(1, 1, 4, 0, 0, 1, 1.0)
            assert sorted(os.walk(tmp_path / "s")) == before
        (k.store.root / "log" / "batch-000000099.parquet").write_bytes(b"torn")  # a crash before the manifest
        assert len(k.query(Query()).assertions) == 3
        with pytest.raises(EngineError, match="without gaps"):
            k.store.load_log(k.store.table("log"))
        more = k.store.table("log").selectExpr("id + 3 as id", *[c for c in k.store.table("log").columns if c != "id"])
        assert k.store.load_log(more) == 3 and ids(k.query(Query()).assertions) == [1, 2, 3, 4, 5, 6]
    with Kernel(spark, tmp_path / "s") as k:
        assert k.commit(1, 1, 4, 0, 0, 1, 1.0) == 7
    last = tmp_path / "s" / k.store.manifest["files"]["log"][-1]["file"]
    last.rename(last.with_name(f"_pending-{last.name}"))  # a crash behind the manifest
    with Kernel(spark, tmp_path / "s") as k:
        assert last.exists() and len(k.query(Query()).assertions) == 7
        k.commit(1, 1, 4, 0, 0, 1, 1.0)
        log = tmp_path / "s" / "manifest.log"
        whole = log.read_bytes()
        log.write_bytes(whole + whole[:20])  # a crash within a line of the manifest's log
        with Kernel(spark, tmp_path / "s", read_only=True) as reader:
            assert len(reader.query(Query()).assertions) == 8
    with Kernel(spark, tmp_path / "s") as k:
        assert not (tmp_path / "s" / "manifest.log").exists() and k.commit(1, 1, 4, 0, 0, 1, 1.0) == 9


def test_commits_cost_a_line(spark, tmp_path):
    """The manifest's log grows by a line a commit and is folded now and then."""
    with Store(spark, tmp_path / "m") as store:
        row = dict(zip(LOG.names, (0, 1, 1, 2, 0, 0, 1, 1.0, 0, 0, 0)))
        sizes = []
        for i in range(1, FOLD + 10):
            store.append({"log": [row | {"id": i}]}, assertion=1)
            sizes.append((tmp_path / "m" / "manifest.log").stat().st_size if (tmp_path / "m" / "manifest.log").exists() else 0)
        steps = np.diff(sizes[: FOLD - 1])
        assert steps.max() < 1.2 * steps.min() and sizes[FOLD - 1] == 0 and manifest.read(tmp_path / "m")[0] == store.manifest


def test_snapshots_settle(spark, tmp_path):
    """Reads over a snapshot and what was committed behind it give what reads over the plain log give, now and as of any point; a record that many close included."""
    rows = corpus(11, 240) + [
        {"id": 241 + i, "subject": 1, "predicate": 1, "object": 101, "valid_from": 0, "valid_to": 0, "observed_at": 100 * (i * 7 % 23), "confidence": 0.5, "appended_status": 3 * (i % 2), "supersedes_id": 5 * (1 - i % 2), "retracts_id": 5 * (i % 2)}
        for i in range(40)
    ]
    with Store(spark, tmp_path / "s") as store:
        for i in range(0, 200, 50):
            store.append({"log": rows[i : i + 50]}, assertion=50)
        for upto in (200, 270, 280):
            held = store.next("assertion") - 1
            if held < upto:
                store.append({"log": rows[held:upto]}, assertion=upto - held)
            if upto < 280:
                store.write_snapshot()
            tables = store.tables()
            plain = Tables(tables.log, tables.entities, tables.predicates)
            assert (tables.settled is not None) and (tables.crowded is not None) == (upto > 260) and (tables.tail is not None) == (upto == 280)
            for scope in ({}, {"as_of_commit": 120}, {"as_of_commit": 265}, {"as_of_commit": 275}, {"as_of_observed": 900}, {"as_of_observed": 2100}, {"as_of_observed": -600}, {"rows": F.col("subject") == 1}):
                got, want = ({tuple(r) for r in statuses(t, **scope).collect()} for t in (tables, plain))
                assert got == want, (upto, scope)
        plan = reads.valid_at(tables, 5, 1000)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "EqualTo(subject,5)" in plan
        assert "EqualTo(id,7)" in reads.get(tables, 7)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 100_000])
def test_merge_cycles(spark, few):
    """Redirects into cycles of one, two and three, tails before them, chains that end, and a later redirect that replaces an earlier one."""
    pairs = [(10, 11), (11, 10), (9, 10), (8, 9), (20, 21), (21, 22), (22, 20), (19, 22), (18, 19), (30, 31), (31, 32), (40, 40), (41, 40), (50, 51), (50, 32)] + [(100 + i, 101 + i) for i in range(70)]
    found = spark.createDataFrame([(i, a, s, 1) for i, (a, s) in enumerate(pairs)], MERGES)
    got = {r["absorbed"]: r["surviving"] for r in merges.resolve_all(found, few).collect()}
    assert got == {e: merges.follow(dict(pairs), e) for e, _ in pairs}
    if few:
        assert [merges.resolve(found, e) for e in (8, 11, 18, 30, 41, 50, 7)] == [10, 11, 22, 32, 40, 32, 7]
    assert [got[e] for e in (8, 9, 10, 11, 18, 19, 20, 21, 22, 30, 40, 41, 50, 100)] == [10, 10, 10, 11, 22, 22, 20, 21, 22, 32, 40, 40, 32, 170]


def test_neighbours_behind_cycles(kernel):
    kernel.commit_batch([fact(1, 1, 9), fact(10, 1, 5), fact(11, 1, 6)])
    kernel.merge_entities(11, 10, 1)
    kernel.merge_entities(10, 11, 2)
    kernel.merge_entities(10, 9, 3)
    assert kernel.resolve_entity(9) == 10 and kernel.neighbors(1, 2) == [9, 5]
    kernel.commit_batch([fact(5, 1, 30 + i) for i in range(6)])
    for few in (0, 1, 4, 1000):
        found = graph.neighbors(kernel.tables, 1, 3, few)
        assert {r["entity"]: r["hops"] for r in found.collect()} == {9: 1, 5: 2, 10: 3} | {30 + i: 3 for i in range(6)}, few


def test_long_chains(kernel):
    """A chain of more links than are read one by one, and beside it another that shares its root."""
    kernel.commit(1, 1, 3, 0, 0, 1, 1.0)
    for i in range(1, 13):
        kernel.commit_superseding(1, 1, 3, 0, 0, 1, 1.0, supersedes_id=i)
    kernel.commit_superseding(1, 1, 3, 0, 0, 1, 1.0, supersedes_id=2)
    assert ids(kernel.explain(13)) == list(range(13, 0, -1)) and ids(kernel.explain(14)) == [14, 2, 1]


def test_spill(kernel, tmp_path):
    for v in (text("t"), Value("int64", -42), Value("double", 2.5), Value("bool", True), Value("timestamp", 1719792000)):
        kernel.commit_by_name("S", "p", v, 0, 0, 1, 0.5)
    kernel.commit_retraction(1, 1, 2, 0, 0, 9, 1.0, retracts_id=2)
    made = kernel.spill_query(Query(order="id", newest_first=True), columns="raw")
    raw = spill.read_raw(made["directory"])
    column = tmp_path / "spills" / "result-1" / "object.col"
    data = column.read_bytes()
    column.write_bytes(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(EngineError, match="damaged"):
        spill.read_raw(made["directory"])
    column.write_bytes(data)
    assert made["token"] == "result-1" and made["rows"] == 6 and raw["id"].tolist() == [6, 5, 4, 3, 2, 1] and raw["status"].tolist() == [3, 0, 0, 0, 2, 0] and raw["confidence"].dtype == np.float64
    names = json.loads((tmp_path / "spills" / "result-1" / "dictionary.json").read_text())
    assert len(names["entities"]) == 6 and names["predicates"] == {"1": "p"} and names["entities"]["3"] == {"kind": "int64", "value": -42}
    made = kernel.spill_query(Query(limit=2, offset=1), token="mine")
    assert kernel.spark.read.parquet(f"{made['directory']}/rows.parquet").count() == 2 and kernel.spill_query(Query())["token"] == "result-2"
    for token in ("mine", "a/b", "..", "."):
        with pytest.raises(EngineError):
            kernel.spill_query(Query(), token=token)
    spill.drop_spill(tmp_path / "spills", "mine")
    assert not (tmp_path / "spills" / "mine").exists()


def test_commands(kernel):
    assert len(COMMANDS) == 53 and sum(c.mutates for c in COMMANDS.values()) == 16
    assert execute(kernel, "intern_entity", {"name": "Alice"}) == 1
    entry = {"subject_name": "Alice", "predicate_name": "works_at", "object": {"kind": "text", "value": "Acme"}, "valid_from": 5, "valid_to": 0, "observed_at": 6, "confidence": 1}
    assert json.loads(call_tool(kernel, "commit_batch_by_name", {"entries": [entry]})[0]) == [1]
    assert json.loads(call_tool(kernel, "commit_superseding", {"subject": 1, "predicate": 1, "object": 2, "valid_from": 5, "valid_to": 0, "observed_at": 7, "confidence": 0.5, "supersedes_id": 1})[0]) == 2
    out = json.loads(call_tool(kernel, "query", {"filter": {"kind": "comparison", "field": "object_value", "op": "eq", "value": {"kind": "text", "value": "Acme"}}, "resolve_names": True, "limit": 1})[0])
    assert out["truncated"] and out["assertions"][0]["status"] == "Superseded" and out["names"][0]["object_value"] == {"kind": "text", "value": "Acme"}
    again = json.loads(call_tool(kernel, "query", {"limit": 1, "cursor": out["next_cursor"]})[0])
    assert ids(again["assertions"]) == [2] and "next_cursor" not in again
    assert json.loads(call_tool(kernel, "aggregate", {"aggregations": [{"function": "count"}], "group_by": [{"field": "status"}]})[0])["groups"][0]["key"] == [{"kind": "text", "value": "Active"}]
    assert call_tool(kernel, "nothing") == ("error: no such tool: nothing", True)
    assert call_tool(kernel, "commit", {"subject": 1})[1] and call_tool(kernel, "get", {"id": "1"})[1] and call_tool(kernel, "query", {"max_rows_examined": 1}) == ("error: max_rows_examined: 2 is more than 1", True)
    assert json.loads(call_tool(kernel, "intern_document", {"content": "AAE="})[0]) == 3 and call_tool(kernel, "document_content", {"id": 3}) == ('"AAE="', False)
    assert json.loads(call_tool(kernel, "neighbors", {"subject": 1, "max_hops": 1})[0]) == [2]


def test_mcp(kernel):
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "intern_entity", "arguments": {"name": "Älice"}}}, {"jsonrpc": "2.0", "id": 4, "method": "nope"}, {"jsonrpc": "2.0", "id": 5},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call"},
    ]
    sink = io.StringIO()
    mcp.serve(kernel, io.StringIO("\n".join([*map(json.dumps, lines), "{"]) + "\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, 6, None] and len(got[1]["result"]["tools"]) == 53
    assert got[2]["result"] == {"content": [{"type": "text", "text": "1"}], "isError": False}
    assert [g["error"]["code"] for g in got[3:]] == [-32601, -32600, -32602, -32700]


def test_change_feed(kernel, tmp_path):
    """Each record once, in whichever way it got into the store and wherever it lies by then."""
    seen: list[int] = []
    each = lambda df, _: seen.extend(sorted(r["id"] for r in df.collect()))
    kernel.commit_batch([fact(1, 1, 2, obs=5), fact(1, 1, 3, obs=500)])
    run = lambda: follow(changes(kernel.spark, kernel.store.root, 100), each, str(tmp_path / "cp")).awaitTermination()
    run()
    assert seen == [2]
    kernel.commit_batch([fact(2, 1, 3, obs=200)])
    run()
    assert seen == [2, 3]
    log = kernel.store.table("log")
    kernel.store.load_log(log.selectExpr("id + 3 as id", *log.columns[1:]))
    kernel.commit_batch([fact(2, 1, 3, obs=200), fact(2, 1, 3, obs=5)])
    kernel.archive_segments_before(4)
    run()
    assert seen == [2, 3, 5, 6, 7]
    kernel.write_snapshot()
    run()
    kernel.commit(2, 1, 3, 0, 0, 300, 1.0)
    run()
    assert seen == [2, 3, 5, 6, 7, 9]
    seen.clear()
    follow(changes(kernel.spark, kernel.store.root), each, str(tmp_path / "again")).awaitTermination()
    assert seen == list(range(1, 10))


def test_bounds(kernel, monkeypatch):
    with pytest.raises(EngineError, match="a cursor goes further"):
        kernel.query(Query(offset=1 << 31))
    kernel.commit_batch([fact(1, 1, 3)] * 6)
    monkeypatch.setattr("factloom.kernel.MAX_READ_ROWS", 5)
    with pytest.raises(BudgetExceeded, match="max_read_rows"):
        kernel.current_by_predicate(1)
