"""Registered queries over stores that events went into by other ways than one load, and over answers that are no plans: pages, budgets, reports and spills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Value, text
from ..operators import describe, graph, reads
from ..schema import BudgetExceeded, EngineError
from ..sinks.spill import drop_spill, read_raw, spill
from ..sources import adapter, scripted
from ..streaming.changes import changes
from . import compile as plan
from .ir import AggregateQuery, Aggregation, Filter, GroupBy, Query
from .queries import _ROW, ORACLE_SQL, QUERIES, parts
from .status import statuses


def put(name: str, sql: str, recursive: bool = False, **options) -> Callable:
    """Registers a callable of (spark, sf_dir) and its SQL over the log's parts."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{parts(**options)}\n{sql}"
        return f

    return add


def _codes(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.col("status_code").cast("int").alias("status_code"))


# ---- the store's own ways
_CODES = "SELECT id, CAST(code AS INTEGER) AS status_code FROM l"
_OBSERVED = {"scope": "observed_at <= 1704500000", "last": "{'o': observed_at, 'i': id}"}
put("archived_log_read", "SELECT * FROM log")(lambda spark, sf: scripted.opened(spark, sf, scripted.archived).tables().log)
put("archived_status", _CODES)(lambda spark, sf: _codes(statuses(scripted.opened(spark, sf, scripted.archived).tables())))
put("snapshot_log_read", "SELECT * FROM log")(lambda spark, sf: scripted.opened(spark, sf, scripted.snapshot_and_tail).tables().log)
put("snapshot_tail_status", _CODES)(lambda spark, sf: _codes(statuses(scripted.opened(spark, sf, scripted.snapshot_and_tail).tables())))
put("snapshot_tail_as_of_observed", _CODES, **_OBSERVED)(lambda spark, sf: _codes(statuses(scripted.opened(spark, sf, scripted.snapshot_and_tail).tables(), as_of_observed=1_704_500_000)))
_NEAR_END = "id <= (SELECT max(n) + 1 FROM e) * 19 // 20"


@put("snapshot_tail_as_of_commit", _CODES, scope=_NEAR_END)
def _(spark: SparkSession, sf: str) -> DataFrame:
    tables = scripted.opened(spark, sf, scripted.snapshot_and_tail).tables()
    return _codes(statuses(tables, as_of_commit=tables.last_id * 19 // 20))


@put("log_tail_of_files", "SELECT * FROM log WHERE id > (SELECT max(n) + 1 FROM e) * 13 // 20")
def _(spark: SparkSession, sf: str) -> DataFrame:
    store = scripted.opened(spark, sf, scripted.archived)
    return store.log_tail((store.next("assertion") - 1) * 13 // 20)


@put("change_feed", "SELECT * FROM log WHERE observed_at >= 1704300000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Loads, archived ones and batches alike, by the stream, from its beginning."""
    store, made = scripted.opened(spark, sf, scripted.archived), f"file://{adapter.folder(spark, 'feed')}"
    stream = changes(spark, store.root, 1_704_300_000)
    stream.writeStream.format("parquet").option("path", f"{made}/rows").option("checkpointLocation", f"{made}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{made}/rows")


put("payload_list", "SELECT n + 1000000000000 AS id FROM e WHERE n % 7 = 0")(lambda spark, sf: adapter.tables(spark, sf).payloads.select("id"))
put("document_content", "SELECT coalesce(props, '') AS content FROM events WHERE event_id = 14")(
    lambda spark, sf: reads.document_content(adapter.tables(spark, sf), adapter.DOCUMENT + 14).select(F.decode("content", "utf-8").alias("content"))
)

# ---- commits by name; identifiers go by the order in which names and values were first seen
_NAMED = """, ev AS (SELECT row_number() OVER (ORDER BY n) AS id, 'user-' || (subject - 1) AS s, event_type AS p, n % 2 = 1 AS whole, k, start, (n % 101) / 100.0::DOUBLE AS confidence FROM e WHERE event_type IS NOT NULL),
      seen AS (SELECT 2 * id AS pos, 's' || s AS v FROM ev UNION ALL SELECT 2 * id + 1, CASE WHEN whole THEN 'i' || k ELSE 'spage-' || k END FROM ev),
      value_ids AS (SELECT v, row_number() OVER (ORDER BY min(pos)) AS id FROM seen GROUP BY v),
      predicate_ids AS (SELECT p, row_number() OVER (ORDER BY min(id)) AS id FROM ev GROUP BY p),
      turns AS (SELECT id AS mark, id // 499 % 4 AS turn, row_number() OVER (ORDER BY id) AS i FROM ev WHERE id % 499 = 3),
      named AS (SELECT ev.id, a.id AS subject, q.id AS predicate, b.id AS object, ev.start AS valid_from, 0 AS valid_to, ev.start AS observed_at, ev.confidence, 0 AS appended_status, 0 AS supersedes_id, 0 AS retracts_id
                FROM ev JOIN value_ids a ON a.v = 's' || ev.s JOIN value_ids b ON b.v = CASE WHEN whole THEN 'i' || k ELSE 'spage-' || k END JOIN predicate_ids q ON q.p = ev.p
                UNION ALL
                SELECT (SELECT max(id) FROM ev) + i, 1, 1, 2, mark, 0, mark, 0.5, CASE turn WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 0 END, CASE turn WHEN 0 THEN mark ELSE 0 END, CASE turn WHEN 1 THEN mark ELSE 0 END FROM turns)"""


def _committed(spark: SparkSession, sf: str):
    return scripted.opened(spark, sf, scripted.committed)


put("commits_log", f"{_NAMED} SELECT CAST(id AS BIGINT) AS id, subject, predicate, object, valid_from, valid_to, observed_at, confidence, appended_status, supersedes_id, retracts_id FROM named")(
    lambda spark, sf: _committed(spark, sf).tables().log
)
put(
    "commits_status",
    f"""{_NAMED} SELECT x.id, CAST(CASE WHEN EXISTS (SELECT 1 FROM named y WHERE y.supersedes_id = x.id) THEN 1 WHEN EXISTS (SELECT 1 FROM named y WHERE y.retracts_id = x.id) THEN 2 ELSE appended_status END AS INTEGER) AS status_code
        FROM named x""",
)(lambda spark, sf: _codes(statuses(_committed(spark, sf).tables())))
put("commits_interned_values", f"{_NAMED} SELECT id, v FROM value_ids")(
    lambda spark, sf: _committed(spark, sf).tables().entities.select("id", F.when(F.col("value.kind") == 0, F.concat(F.lit("s"), "value.text")).otherwise(F.concat(F.lit("i"), F.col("value.i64").cast("string"))).alias("v"))
)
put("commits_interned_predicates", f"{_NAMED} SELECT id, p AS name FROM predicate_ids")(lambda spark, sf: _committed(spark, sf).tables().predicates)
put(
    "commits_provenance",
    f"""{_NAMED}, given AS (SELECT (SELECT max(id) FROM ev) + i AS assertion_id, mark AS source, mark + 1 AS recorded_at, 'script' AS method, 0 AS o FROM turns WHERE turn = 2
                     UNION ALL SELECT mark, mark + 1, mark + 3, 'batch', 1 FROM turns WHERE mark <> 1
                     UNION ALL SELECT 1, max(mark), max(mark), 'first', 2 FROM turns HAVING max(mark) IS NOT NULL)
        SELECT assertion_id, source, recorded_at, method FROM given""",
)(lambda spark, sf: reads.last_provenance(_committed(spark, sf).tables()))
put("commits_documents", f"{_NAMED} SELECT 'document ' || mark AS content FROM turns")(lambda spark, sf: _committed(spark, sf).tables().payloads.select(F.decode("content", "utf-8").alias("content")))
put("commits_merges", f"{_NAMED} SELECT 1000000 + mark AS absorbed, 1 AS surviving FROM turns")(lambda spark, sf: _committed(spark, sf).tables().merges.select("absorbed", "surviving"))

# ---- single records, selectors and scans
put("query_object", f"SELECT {_ROW} FROM l WHERE object = 1000000005 ORDER BY id LIMIT 10000")(lambda spark, sf: plan.page(Query(object=adapter.PAGE + 5), adapter.tables(spark, sf)))
put("query_force_scan", f"SELECT {_ROW} FROM l WHERE subject = 5 ORDER BY id LIMIT 10000")(lambda spark, sf: plan.page(Query(subject=5, force_scan=True, force_row_scan=True), adapter.tables(spark, sf)))


@put(
    "explain",
    """, up AS (SELECT (SELECT max(id) FROM links) AS id, 0 AS pos UNION ALL SELECT k.target, up.pos + 1 FROM up JOIN links k ON k.id = up.id)
       SELECT up.pos, l.id, l.status FROM up JOIN l ON l.id = up.id""",
    recursive=True,
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The chain of the last correction."""
    tables = adapter.tables(spark, sf)
    last = tables.log.where("supersedes_id <> 0 or retracts_id <> 0").agg(F.max("id").alias("id")).first().id
    return spark.createDataFrame([(i, r["id"], r["status"]) for i, r in enumerate(graph.explain(tables, last))], "pos INT, id BIGINT, status STRING")


@put(
    "explain_query",
    """, rep AS (SELECT count(*) FILTER (subject = 5) AS s, count(*) FILTER (subject = 5 AND observed_at <= 1704500000) AS o, count(*) FILTER (predicate = 2 AND code = 0 AND valid_to = 0) AS p, count(*) AS n FROM l),
       x AS (SELECT 'subject_index' AS source, s AS rows, 50 + 5.15 * s AS cost FROM rep UNION ALL SELECT 'observed_time_index', o, 50 + 5.15 * o FROM rep UNION ALL SELECT 'object_current_index', NULL, NULL
             UNION ALL SELECT 'predicate_current_index', p, 50 + 5.15 * p FROM rep UNION ALL SELECT 'columnar_scan', n, 0.91 * n FROM rep UNION ALL SELECT 'row_scan', n, 1.54 * n FROM rep)
       SELECT source, CAST(rows AS BIGINT) AS rows, round(CAST(cost AS DOUBLE), 4) AS cost, coalesce(cost = (SELECT min(cost) FROM x), false) AS chosen FROM x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    report = describe.explain_query(Query(subject=5, predicate=2, observed_to=1_704_500_000, statuses=("Active",), open_ended_only=True), adapter.tables(spark, sf))
    rows = [(c["source"], c.get("rows"), None if c.get("cost") is None else round(c["cost"], 4), c["source"] == report["chosen"]) for c in report["considered"]]
    return spark.createDataFrame(rows, "source STRING, rows BIGINT, cost DOUBLE, chosen BOOLEAN")


# ---- pages, budgets and what is refused
@put(
    "query_pages",
    """, p AS (SELECT id, observed_at, row_number() OVER (ORDER BY observed_at DESC, id DESC) - 1 AS i FROM l WHERE predicate = 2)
       SELECT CAST(i // 150 AS INTEGER) AS page, CAST(count(*) AS INTEGER) AS n, min(id) AS low, max(id) AS high, max(i) < (SELECT max(i) FROM p) AS truncated FROM p WHERE i < 600 GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The first four pages by cursor."""
    tables, out, cursor = adapter.tables(spark, sf), [], ""
    for page in range(4):
        found = plan.run_query(Query(predicate=2, order="observed_at", newest_first=True, limit=150, cursor=cursor), tables)
        ids = [r["id"] for r in found.assertions]
        out += [(page, len(ids), min(ids), max(ids), found.truncated)] if ids else []
        cursor = found.next_cursor
        if not cursor:
            break
    return spark.createDataFrame(out, "page INT, n INT, low BIGINT, high BIGINT, truncated BOOLEAN")


@put(
    "budgets",
    """SELECT 'rows within' AS name, 0 AS reached UNION ALL SELECT 'rows beyond', 8 UNION ALL SELECT 'subject within', 0 UNION ALL SELECT 'subject beyond', CAST(least(2, (SELECT count(*) FROM l WHERE subject = 5)) AS INTEGER)
       UNION ALL SELECT 'groups within', 0 UNION ALL SELECT 'groups beyond', 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How far each request got beyond its budget; 0 for those that stayed within."""
    tables, out = adapter.tables(spark, sf), []
    groups = lambda most: lambda: plan.run_aggregate(AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("status"),) if most > 4 else (GroupBy("subject"),), max_groups=most), tables)
    query = lambda **k: lambda: plan.run_query(Query(limit=1, **k), tables)
    cases = {
        "rows within": query(max_rows_examined=tables.last_id), "rows beyond": query(max_rows_examined=7), "subject within": query(max_rows_examined=tables.last_id, subject=5),
        "subject beyond": query(max_rows_examined=1, subject=5), "groups within": groups(5), "groups beyond": groups(4),
    }
    for name, run in cases.items():
        try:
            run()
            out.append((name, 0))
        except BudgetExceeded as error:
            out.append((name, error.reached))
    return spark.createDataFrame(out, "name STRING, reached INT")


_BAD = {
    "both as-of points": Query(as_of_commit=1, as_of_observed=1), "another version": Query(ir_version=2), "no cursor": Query(cursor="x"), "a cursor of another order": Query(cursor="flc1:id:desc:1:1"),
    "a cursor and an offset": Query(cursor="flc1:id:asc:1:1", offset=1), "an empty and": Query(filter=Filter("and")), "confidence as an integer": Query(filter=Filter.compare("confidence", "eq", Value("int64", 1))),
    "an unknown status": Query(filter=Filter.compare("status", "eq", text("Gone"))), "no aggregation": AggregateQuery(), "five fields": AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("subject"),) * 5),
    "a bucket without width": AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("valid_from_bucket"),)), "a limited selection": AggregateQuery(Query(limit=1), (Aggregation("count"),)),
}
_GOOD = {"a query": Query(), "four fields": AggregateQuery(aggregations=(Aggregation("count"),), group_by=(GroupBy("subject"),) * 4)}


@put("refused_requests", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n in _BAD).lower()})" for n in [*_BAD, *_GOOD]) + ") t(name, refused)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = []
    for name, request in (_BAD | _GOOD).items():
        try:
            request.validate()
            out.append((name, False))
        except EngineError:
            out.append((name, True))
    return spark.createDataFrame(out, "name STRING, refused BOOLEAN")


# ---- spills
@put("spill_query", "SELECT id, subject, predicate, object, valid_from, valid_to, observed_at, confidence, CAST(code AS TINYINT) AS status, supersedes_id, retracts_id FROM l WHERE code = 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    made = spill(Query(statuses=("Retracted",), order="observed_at"), adapter.tables(spark, sf), adapter.folder(spark, "spill"))
    return spark.read.parquet(f"file://{made['directory']}/rows.parquet")


@put("spill_raw_columns", "SELECT 'id' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS DOUBLE) AS total FROM l WHERE code = 2 UNION ALL SELECT 'observed_at', count(*), CAST(sum(observed_at) AS DOUBLE) FROM l WHERE code = 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a raw spill, which is dropped then."""
    directory = adapter.folder(spark, "spill")
    made = spill(Query(statuses=("Retracted",)), adapter.tables(spark, sf), directory, columns="raw")
    columns = read_raw(made["directory"])
    drop_spill(directory, made["token"])
    return spark.createDataFrame([(c, len(columns[c]), float(columns[c].sum())) for c in ("id", "observed_at")], "name STRING, n BIGINT, total DOUBLE")
