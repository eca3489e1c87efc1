"""Registered queries of the assertion engine over the driver's events, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import FIELDS, Value, text
from ..operators import conflicts, describe, graph, merges, reads
from ..sources import adapter
from ..streaming.changes import counts_by_bucket
from . import compile as plan
from .compile import Tables
from .ir import AggregateQuery, Aggregation, Filter, GroupBy, Query
from .status import statuses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_PARTS = """
e AS (SELECT event_id AS n, user_id + 1 AS subject, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
             coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS start FROM events),
predicates AS (SELECT row_number() OVER (ORDER BY event_type) AS id, event_type AS name
               FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
o AS (SELECT e.*, p.id AS predicate,
             CASE event_type WHEN 'purchase' THEN 4000000000 + cents WHEN 'error' THEN 2000000000 + k WHEN 'signup' THEN 3000000000 + k % 2 ELSE 1000000000 + k END AS object,
             lag(n, 1) OVER w + 1 AS one, lag(n, 2) OVER w + 1 AS two
      FROM e JOIN predicates p ON p.name = e.event_type WINDOW w AS (PARTITION BY e.subject, p.id ORDER BY n)),
s AS (SELECT *, coalesce(CASE WHEN n % 5 = 2 THEN one WHEN n % 23 = 7 THEN two END, 0) AS supersedes_id FROM o),
r AS (SELECT *, CASE WHEN supersedes_id = 0 AND n % 17 = 4 THEN coalesce(one, 0) ELSE 0 END AS retracts_id FROM s),
log AS (SELECT n + 1 AS id, subject, predicate, object, start AS valid_from, CASE WHEN n % 3 = 0 THEN start + 86400 ELSE 0 END AS valid_to,
               start + n % 7 * 3600 - CASE WHEN n % 11 = 3 THEN 200000 ELSE 0 END AS observed_at, (n % 101) / 100.0::DOUBLE AS confidence,
               CAST(CASE WHEN retracts_id <> 0 THEN 3 WHEN n % 19 = 5 THEN 4 ELSE 0 END AS TINYINT) AS appended_status, supersedes_id, retracts_id FROM r),
entities AS (SELECT DISTINCT subject AS id, 0 AS kind, 'user-' || (subject - 1) AS text, NULL::BIGINT AS i64, NULL::DOUBLE AS f64, NULL::BOOLEAN AS b FROM e
             UNION ALL
             SELECT object, CASE WHEN object >= 4000000000 THEN 2 WHEN object >= 3000000000 THEN 3 WHEN object >= 2000000000 THEN 1 ELSE 0 END,
                    CASE WHEN object < 2000000000 THEN 'page-' || (object - 1000000000) END,
                    CASE WHEN object >= 2000000000 AND object < 3000000000 THEN object - 2000000000 END,
                    CASE WHEN object >= 4000000000 THEN (object - 4000000000) / 100.0::DOUBLE END,
                    CASE WHEN object >= 3000000000 AND object < 4000000000 THEN object = 3000000001 END
             FROM (SELECT DISTINCT object FROM o) WHERE NOT (object < 2000000000 AND (object - 1000000000) % 13 = 0)),
merges AS (SELECT CAST(seq AS BIGINT) AS seq, CAST(absorbed AS BIGINT) AS absorbed, CAST(surviving AS BIGINT) AS surviving, CAST(merged_at AS BIGINT) AS merged_at
           FROM (VALUES (1, 100001, 100000, 10), (2, 100000, 1, 20), (3, 100002, 7, 30), (4, 100002, 2, 40), (5, 200001, 200002, 50), (6, 200002, 200001, 60), (7, 200003, 200001, 70),
                       (8, 300001, 300002, 80), (9, 300002, 300003, 90), (10, 300003, 300001, 100), (11, 300004, 300002, 110), (12, 1000000006, 1000000007, 120), (13, 1000000007, 1000000006, 130),
                       (14, 1000000008, 1000000006, 140), (15, 1000000009, 9, 150), (16, 1000000010, 1000000009, 160)) t(seq, absorbed, surviving, merged_at)),
resolved AS (SELECT CAST(absorbed AS BIGINT) AS absorbed, CAST(surviving AS BIGINT) AS surviving
             FROM (VALUES (100001, 1), (100000, 1), (100002, 2), (200001, 200001), (200002, 200002), (200003, 200001), (300001, 300001), (300002, 300002), (300003, 300003), (300004, 300002),
                          (1000000006, 1000000006), (1000000007, 1000000007), (1000000008, 1000000006), (1000000009, 9), (1000000010, 9)) t(absorbed, surviving)),
provenance AS (SELECT n * 2 + turn + 1 AS seq, n + 1 AS assertion_id, n % 10 + turn * 100 + 1 AS source, n * 10 + turn AS recorded_at,
                      CASE WHEN turn = 0 THEN 'import' ELSE 'review' END AS method
               FROM e, (VALUES (0), (1)) t(turn) WHERE n % 3 = 0 AND (turn = 0 OR n % 9 = 0)),
links AS (SELECT id, observed_at, CASE WHEN supersedes_id <> 0 THEN supersedes_id ELSE retracts_id END AS target,
                 CASE WHEN supersedes_id <> 0 THEN 1 ELSE 2 END AS code FROM log WHERE supersedes_id <> 0 OR retracts_id <> 0)"""


def _statuses(scope: str = "true", last: str = "id") -> str:
    return f"""
c AS (SELECT target, arg_max(code, {last}) AS code FROM links WHERE {scope} GROUP BY target),
l AS (SELECT log.*, coalesce(c.code, appended_status) AS code,
             ['Active', 'Superseded', 'Retracted', 'Retraction', 'Hypothesis'][coalesce(c.code, appended_status) + 1] AS status
      FROM log LEFT JOIN c ON c.target = log.id WHERE {scope.replace('id <=', 'log.id <=')}),
v AS (SELECT l.*, x.kind, x.text, x.i64, x.f64, x.b, CASE x.kind WHEN 1 THEN CAST(x.i64 AS DOUBLE) WHEN 2 THEN x.f64 END AS num FROM l LEFT JOIN entities x ON x.id = l.object)"""


_ROW = "id, subject, predicate, object, valid_from, valid_to, observed_at, confidence, status, supersedes_id, retracts_id"
_NOW = "code = 0 AND valid_to = 0"


def parts(scope: str = "true", last: str = "id") -> str:
    """What the SQL twins build on: the log of events, its catalogs, and statuses in scope."""
    return f"{_PARTS.strip()},{_statuses(scope, last)}"


def register(name: str, sql: str, scope: str = "true", last: str = "id", recursive: bool = False) -> Callable:
    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(adapter.tables(spark, sf_dir))
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{parts(scope, last)}\n{sql}"
        return f

    return put


def _rows(name: str, where: str, f: Callable[[Tables], DataFrame], tail: str = "", **options) -> None:
    register(name, f"SELECT {_ROW} FROM l WHERE {where} {tail}", **options)(f)


def _query(name: str, query: Query | Callable[[Tables], Query], where: str, tail: str = "", source: str = "l", **options) -> None:
    register(name, f"SELECT {_ROW} FROM {source} WHERE {where} {tail}", **options)(lambda t: plan.page(query(t) if callable(query) else query, t))


#: Reads as of a commit look back to two fifths of the log.
_CUT = "id <= (SELECT max(n) + 1 FROM e) * 2 // 5"


def _cut(t: Tables) -> int:
    return t.last_id * 2 // 5


# ---- sources and statuses
register("log_full_read", "SELECT * FROM log")(lambda t: t.log)
register("log_tail_read", "SELECT * FROM log WHERE id > (SELECT max(n) + 1 FROM e) * 9 // 10")(lambda t: t.log.where(F.col("id") > t.last_id * 9 // 10))
register("status_now", "SELECT id, CAST(code AS INTEGER) AS status_code FROM l")(lambda t: statuses(t).select("id", F.col("status_code").cast("int").alias("status_code")))
register("as_of_commit_status", "SELECT id, CAST(code AS INTEGER) AS status_code FROM l", scope=_CUT)(lambda t: statuses(t, as_of_commit=_cut(t)).select("id", F.col("status_code").cast("int").alias("status_code")))
register("as_of_observed_status", "SELECT id, CAST(code AS INTEGER) AS status_code FROM l", scope="observed_at <= 1704500000", last="{'o': observed_at, 'i': id}")(
    lambda t: statuses(t, as_of_observed=1_704_500_000).select("id", F.col("status_code").cast("int").alias("status_code"))
)


def _values(value, prefix: str = "") -> list:
    return [value["kind"].cast("int").alias(f"{prefix}kind"), *(value[f].alias(f"{prefix}{f}") for f in FIELDS[:4])]


register("entity_catalog_read", "SELECT id, kind, text, i64, f64, b FROM entities")(lambda t: t.entities.select("id", *_values(F.col("value"))))
register("predicate_catalog_read", "SELECT id, name FROM predicates")(lambda t: t.predicates)
register("provenance_log_read", "SELECT assertion_id, arg_max(source, seq) AS source, arg_max(recorded_at, seq) AS recorded_at, arg_max(method, seq) AS method FROM provenance GROUP BY assertion_id")(reads.last_provenance)
register("merge_log_read", "SELECT absorbed, arg_max(surviving, seq) AS surviving FROM merges GROUP BY absorbed")(lambda t: merges.redirects(t.merges))

# ---- fixed-shape reads
_rows("get", "id = 1234", lambda t: reads.get(t, 1234))
_rows("assertions_for_subject", "subject = 5", lambda t: reads.assertions_for_subject(t, 5))
_rows("assertions_for_subject_limited", "subject = 5", lambda t: reads.assertions_for_subject(t, 5, 7), "ORDER BY id LIMIT 7")
_rows("current", f"subject = 5 AND {_NOW}", lambda t: reads.current(t, 5))
_rows("current_all_subjects", _NOW, lambda t: plan.shown(reads.rows(t, F.col("valid_to") == 0).where("status_code = 0")))
_rows("current_by_name", f"subject = 5 AND {_NOW}", lambda t: reads.current_by_name(t, "user-4"))
_rows("current_by_object", f"object = 1000000005 AND {_NOW}", lambda t: reads.current_by_object(t, adapter.PAGE + 5))
_rows("current_by_predicate", f"predicate = 5 AND {_NOW}", lambda t: reads.current_by_predicate(t, 5))
_rows("hypotheses_for", "subject = 5 AND code = 4", lambda t: reads.hypotheses_for(t, 5))
_rows("valid_at", "subject = 5 AND code = 0 AND valid_from <= 1704600000 AND (valid_to = 0 OR valid_to > 1704600000)", lambda t: reads.valid_at(t, 5, 1_704_600_000))
_rows("known_at", "subject = 5 AND code = 0 AND observed_at <= 1704500000", lambda t: reads.known_at(t, 5, 1_704_500_000))
_rows(
    "valid_at_known_at", "subject = 5 AND code = 0 AND valid_from <= 1704600000 AND (valid_to = 0 OR valid_to > 1704600000) AND observed_at <= 1704500000",
    lambda t: reads.valid_at_known_at(t, 5, 1_704_600_000, 1_704_500_000),
)
_rows("valid_time_timeline", "subject = 5 AND predicate = 2 AND code = 0", lambda t: reads.valid_time_timeline(t, 5, 2))
_rows("observed_time_timeline", "subject = 5 AND predicate = 2 AND code = 0", lambda t: reads.observed_time_timeline(t, 5, 2))
_rows("commit_history", "subject = 5 AND predicate = 2", lambda t: reads.commit_history(t, 5, 2))
_rows("changes_since", "observed_at >= 1704500000", lambda t: reads.changes_since(t, 1_704_500_000))
_rows("changes_since_newest", "observed_at >= 1704500000", lambda t: reads.changes_since(t, 1_704_500_000, 25, True), "ORDER BY observed_at DESC, id DESC LIMIT 25")
register(
    "explain_chains",
    """, up AS (SELECT id, id AS root, 0 AS depth FROM log UNION ALL SELECT up.id, k.target, up.depth + 1 FROM up JOIN links k ON k.id = up.root)
       SELECT id, arg_max(root, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id""",
    recursive=True,
)(graph.chains)
register(
    "find_conflicts",
    """SELECT a.subject, a.predicate, a.id AS a_id, b.id AS b_id FROM l a JOIN l b ON a.subject = b.subject AND a.predicate = b.predicate AND a.id < b.id AND a.object <> b.object
       WHERE a.code = 0 AND b.code = 0 AND (b.valid_to = 0 OR a.valid_from < b.valid_to) AND (a.valid_to = 0 OR b.valid_from < a.valid_to)""",
)(lambda t: conflicts.conflicts(t).select("subject", "predicate", "a_id", "b_id"))
register("find_entity", "SELECT id FROM entities WHERE kind = 0 AND text = 'page-5'")(lambda t: reads.find_value(t, text("page-5")))
register("find_value", "SELECT id FROM entities WHERE kind = 1 AND i64 = 42")(lambda t: reads.find_value(t, Value("int64", 42)))
register("find_predicate", "SELECT id FROM predicates WHERE name = 'purchase'")(lambda t: reads.find_predicate(t, "purchase"))
register("entity_name", "SELECT id AS entity, text AS name FROM entities WHERE kind = 0")(reads.entity_names)
register("entity_value", "SELECT kind, text, i64, f64, b FROM entities WHERE id = 3000000001")(lambda t: reads.entity_value(t, adapter.FLAG + 1).select(*_values(F.col("value"))))
register("predicate_name", "SELECT name FROM predicates WHERE id = 3")(lambda t: reads.predicate_name(t, 3))
register("provenance_for", "SELECT assertion_id, arg_max(source, seq) AS source, arg_max(recorded_at, seq) AS recorded_at, arg_max(method, seq) AS method FROM provenance WHERE assertion_id = 10 GROUP BY assertion_id")(
    lambda t: reads.last_provenance(t).where("assertion_id = 10")
)
_ASKED = "(VALUES (0, 5), (1, 1000000005), (2, 5), (3, 1000000000), (4, 3000000001), (5, 999), (6, 2000000042)) a(pos, id)"
_IDS = [5, 1_000_000_005, 5, 1_000_000_000, 3_000_000_001, 999, 2_000_000_042]


def _asked(t: Tables, ids: list[int]) -> DataFrame:
    return t.log.sparkSession.createDataFrame(list(enumerate(ids)), "pos INT, id BIGINT")


register("entity_name_batch", f"SELECT a.pos, CAST(a.id AS BIGINT) AS id, x.text AS name FROM {_ASKED} LEFT JOIN entities x ON x.id = a.id AND x.kind = 0")(lambda t: reads.answers(_asked(t, _IDS), reads.entity_names(t), "entity"))
register("entity_value_batch", f"SELECT a.pos, CAST(a.id AS BIGINT) AS id, x.kind, x.text, x.i64, x.f64, x.b FROM {_ASKED} LEFT JOIN entities x ON x.id = a.id")(
    lambda t: reads.answers(_asked(t, _IDS), t.entities.withColumnRenamed("id", "entity"), "entity").select("pos", "id", *_values(F.col("value")))
)
register("predicate_name_batch", "SELECT a.pos, CAST(a.id AS BIGINT) AS id, p.name FROM (VALUES (0, 3), (1, 9), (2, 1), (3, 3)) a(pos, id) LEFT JOIN predicates p ON p.id = a.id")(
    lambda t: reads.answers(_asked(t, [3, 9, 1, 3]), t.predicates.withColumnRenamed("id", "predicate"), "predicate")
)
register(
    "provenance_for_batch",
    """SELECT a.pos, CAST(a.id AS BIGINT) AS id, p.source, p.recorded_at, p.method FROM (VALUES (0, 10), (1, 2), (2, 4), (3, 10)) a(pos, id)
       LEFT JOIN (SELECT assertion_id, arg_max(source, seq) AS source, arg_max(recorded_at, seq) AS recorded_at, arg_max(method, seq) AS method FROM provenance GROUP BY assertion_id) p ON p.assertion_id = a.id""",
)(lambda t: reads.answers(_asked(t, [10, 2, 4, 10]), reads.last_provenance(t), "assertion_id"))
register(
    "neighbors",
    f""", g AS (SELECT DISTINCT subject AS a, object AS b FROM l WHERE {_NOW}),
       h1 AS (SELECT b AS entity FROM g WHERE a = 5 UNION SELECT a FROM g WHERE b = 5),
       h2 AS (SELECT g.b AS entity FROM h1 LEFT JOIN resolved x ON x.absorbed = h1.entity JOIN g ON g.a = coalesce(x.surviving, h1.entity) UNION SELECT g.a FROM g JOIN h1 ON g.b = h1.entity)
       SELECT entity, 1 AS hops FROM h1 WHERE entity <> 5 UNION ALL SELECT entity, 2 FROM h2 WHERE entity <> 5 AND entity NOT IN (SELECT entity FROM h1)""",
)(lambda t: graph.neighbors(t, 5, 2))
register("co_occurring_predicates", f"SELECT DISTINCT predicate FROM l WHERE subject = 5 AND {_NOW}")(lambda t: graph.co_occurring_predicates(t, 5))
register("resolve_entity", "SELECT absorbed, surviving FROM resolved")(lambda t: merges.resolve_all(t.merges))
register("describe_predicates", f"SELECT p.id, p.name, count(l.id) AS current_rows FROM predicates p LEFT JOIN l ON l.predicate = p.id AND {_NOW} GROUP BY p.id, p.name")(describe.describe_predicates)
register(
    "describe_corpus",
    f"""SELECT count(*) AS assertion_count, count(DISTINCT subject) AS distinct_subjects, count(DISTINCT CASE WHEN {_NOW} THEN object END) AS distinct_current_objects,
               CAST(sum(CAST(code = 0 AS INT)) AS BIGINT) AS active, CAST(sum(CAST(code = 1 AS INT)) AS BIGINT) AS superseded, CAST(sum(CAST(code = 2 AS INT)) AS BIGINT) AS retracted,
               CAST(sum(CAST(code = 3 AS INT)) AS BIGINT) AS retraction, CAST(sum(CAST(code = 4 AS INT)) AS BIGINT) AS hypothesis,
               min(observed_at) AS min_observed_at, max(observed_at) AS max_observed_at, min(valid_from) AS min_valid_from, max(valid_from) AS max_valid_from FROM l""",
)(describe.describe_corpus)

# ---- the query IR
_query("query_valid_at", Query(valid_at=1_704_600_000, statuses=("Active",)), "code = 0 AND valid_from <= 1704600000 AND (valid_to = 0 OR valid_to > 1704600000)", "ORDER BY id LIMIT 10000")
_query("query_observed_window", Query(observed_from=1_704_400_000, observed_to=1_704_500_000), "observed_at BETWEEN 1704400000 AND 1704500000", "ORDER BY id LIMIT 10000")
_query("query_open_ended", Query(open_ended_only=True, statuses=("Active", "Hypothesis")), "valid_to = 0 AND code IN (0, 4)", "ORDER BY id LIMIT 10000")
_query("query_order_limit", Query(order="observed_at", newest_first=True, limit=50), "true", "ORDER BY observed_at DESC, id DESC LIMIT 50")
_query("query_offset", Query(order="valid_from", limit=40, offset=33, predicate=2), "predicate = 2", "ORDER BY valid_from, id LIMIT 40 OFFSET 33")
_query("query_cursor", Query(order="observed_at", limit=40, cursor="flc1:observed_at:asc:1704400000:777"), "observed_at > 1704400000 OR (observed_at = 1704400000 AND id > 777)", "ORDER BY observed_at, id LIMIT 40")
_query("query_merged_subject", Query(subject=100_001), "subject = 1", "ORDER BY id LIMIT 10000")
_query("query_as_of_commit", lambda t: Query(as_of_commit=_cut(t), statuses=("Superseded", "Retracted")), "code IN (1, 2)", "ORDER BY id LIMIT 10000", scope=_CUT)
_query("query_as_of_observed", Query(as_of_observed=1_704_500_000, statuses=("Active",), subject=5), "code = 0 AND subject = 5", "ORDER BY id LIMIT 10000", scope="observed_at <= 1704500000", last="{'o': observed_at, 'i': id}")
_query("query_filter_confidence", Query(filter=Filter.compare("confidence", "gte", Value("double", 0.9))), "confidence >= 0.9", "ORDER BY id LIMIT 10000")
_query("query_filter_status_name", Query(filter=Filter.compare("status", "gt", text("Hypothesis"))), "status > 'Hypothesis'", "ORDER BY id LIMIT 10000")
_query("query_filter_object_text", Query(filter=Filter.compare("object_value", "lt", text("page-3"))), "coalesce(kind = 0 AND text < 'page-3', false)", "ORDER BY id LIMIT 10000", source="v")
_query("query_filter_object_double", Query(filter=Filter.compare("object_value", "gt", Value("double", 100.0))), "coalesce(kind = 2 AND f64 > 100, false)", "ORDER BY id LIMIT 10000", source="v")
_query(
    "query_filter_not_object", Query(filter=Filter.negate(Filter.compare("object_value", "ne", Value("int64", 42)))), "NOT coalesce(kind = 1 AND i64 <> 42, false)", "ORDER BY id LIMIT 10000", source="v"
)
_query(
    "query_filter_tree",
    Query(filter=Filter.any_of(Filter.all_of(Filter.compare("subject", "lt", Value("int64", 20)), Filter.compare("valid_to", "eq", Value("timestamp", 0))), Filter.negate(Filter.compare("predicate", "ne", Value("int64", 4))))),
    "(subject < 20 AND valid_to = 0) OR NOT predicate <> 4", "ORDER BY id LIMIT 10000",
)
register(
    "query_resolve_names",
    f"""SELECT p.*, s.text AS subject_name, pr.name AS predicate_name, x.kind, x.text, x.i64, x.f64, x.b
        FROM (SELECT {_ROW} FROM l ORDER BY id DESC LIMIT 200) p LEFT JOIN entities s ON s.id = p.subject AND s.kind = 0
        LEFT JOIN predicates pr ON pr.id = p.predicate LEFT JOIN entities x ON x.id = p.object""",
)(lambda t: (lambda d: d.select(*[c for c in d.columns if c != "object_value"], *_values(F.col("object_value"))))(plan.with_names(plan.page(Query(newest_first=True, limit=200), t), t)))

# ---- aggregates
_ALL = tuple(Aggregation(f) for f in ("count", "count_distinct", "sum", "min", "max", "avg"))
_CELLS = "count(*) AS row_count, count(*) AS value_0, count(DISTINCT CASE WHEN kind IS NOT NULL THEN object END) AS value_1, round(sum(num), 4) AS value_2, min(num) AS value_3, max(num) AS value_4, round(avg(num), 4) AS value_5"


def _rounded(query: AggregateQuery | Callable[[Tables], AggregateQuery], *sums: int) -> Callable[[Tables], DataFrame]:
    return lambda t: plan.aggregate(query(t) if callable(query) else query, t).withColumns({f"value_{i}": F.round(f"value_{i}", 4) for i in sums})


def _aggregates(name: str, query: AggregateQuery | Callable[[Tables], AggregateQuery], sql: str, *sums: int, **options) -> None:
    register(name, sql, **options)(_rounded(query, *sums))


_aggregates("aggregate_global", AggregateQuery(Query(statuses=("Active",)), _ALL), f"SELECT {_CELLS} FROM v WHERE code = 0", 2, 5)
_aggregates("aggregate_by_predicate", AggregateQuery(Query(), _ALL, (GroupBy("predicate"),)), f"SELECT predicate AS key_0, {_CELLS} FROM v GROUP BY predicate", 2, 5)
_aggregates("aggregate_by_subject", AggregateQuery(Query(), (Aggregation("count"), Aggregation("avg", "confidence")), (GroupBy("subject"),)), "SELECT subject AS key_0, count(*) AS row_count, count(*) AS value_0, round(avg(confidence), 4) AS value_1 FROM l GROUP BY subject", 1)
_aggregates("aggregate_by_status", AggregateQuery(Query(), (Aggregation("count_distinct", "subject"),), (GroupBy("status"),)), "SELECT status AS key_0, count(*) AS row_count, count(DISTINCT subject) AS value_0 FROM l GROUP BY status")
_aggregates("aggregate_by_object", AggregateQuery(Query(predicate=5, statuses=("Active",)), (Aggregation("count"),), (GroupBy("object"),)), "SELECT object AS key_0, count(*) AS row_count, count(*) AS value_0 FROM l WHERE predicate = 5 AND code = 0 GROUP BY object")
_aggregates(
    "aggregate_buckets",
    AggregateQuery(Query(), (Aggregation("count"), Aggregation("min", "valid_from"), Aggregation("max", "valid_to")), (GroupBy("observed_at_bucket", 86_400), GroupBy("predicate"))),
    """SELECT observed_at - ((observed_at % 86400) + 86400) % 86400 AS key_0, predicate AS key_1, count(*) AS row_count, count(*) AS value_0,
              CAST(min(valid_from) AS DOUBLE) AS value_1, CAST(max(valid_to) AS DOUBLE) AS value_2 FROM l GROUP BY 1, 2""",
)
_aggregates(
    "aggregate_valid_buckets", AggregateQuery(Query(open_ended_only=True), (Aggregation("count"), Aggregation("count_distinct", "object")), (GroupBy("valid_from_bucket", 604_800), GroupBy("status"))),
    "SELECT valid_from - ((valid_from % 604800) + 604800) % 604800 AS key_0, status AS key_1, count(*) AS row_count, count(*) AS value_0, count(DISTINCT object) AS value_1 FROM l WHERE valid_to = 0 GROUP BY 1, 2",
)
_aggregates("aggregate_as_of_commit", lambda t: AggregateQuery(Query(as_of_commit=_cut(t)), (Aggregation("count"),), (GroupBy("status"),)), "SELECT status AS key_0, count(*) AS row_count, count(*) AS value_0 FROM l GROUP BY status", scope=_CUT)
_aggregates("aggregate_no_rows", AggregateQuery(Query(subject=987_654_321), (Aggregation("count"),)), "SELECT count(*) AS row_count, count(*) AS value_0 FROM l WHERE subject = 987654321 HAVING count(*) > 0")
_aggregates(
    "aggregate_filtered", AggregateQuery(Query(filter=Filter.compare("object_value", "gte", Value("double", 50.0))), (Aggregation("sum"), Aggregation("count")), (GroupBy("predicate"), GroupBy("status"))),
    "SELECT predicate AS key_0, status AS key_1, count(*) AS row_count, round(sum(num), 4) AS value_0, count(*) AS value_1 FROM v WHERE kind = 2 AND f64 >= 50 GROUP BY 1, 2", 0,
)

# ---- what spills and interning join
register("spill_dictionary", "SELECT x.id, x.kind, x.text, x.i64, x.f64, x.b FROM entities x WHERE x.id IN (SELECT subject FROM l WHERE code = 2 UNION SELECT object FROM l WHERE code = 2)")(
    lambda t: t.entities.join(plan.select_rows(Query(statuses=("Retracted",)), t).select(F.explode(F.array("subject", "object")).alias("id")).distinct(), "id", "left_semi").select("id", *_values(F.col("value")))
)
register("interning_new_objects", "SELECT DISTINCT object FROM log WHERE object NOT IN (SELECT id FROM entities)")(lambda t: t.log.select("object").distinct().join(t.entities.select(F.col("id").alias("object")), "object", "left_anti"))
register("change_counts_by_bucket", "SELECT predicate, observed_at - ((observed_at % 3600) + 3600) % 3600 AS bucket, count(*) AS n FROM log GROUP BY 1, 2")(lambda t: counts_by_bucket(t.log, 3600))

from . import store_queries  # noqa: E402, F401  adds the queries that need a store of their own
