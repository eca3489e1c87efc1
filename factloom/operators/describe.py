"""What the store holds, and what a query would examine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_current
from ..plans.compile import Tables, page
from ..plans.ir import Query
from ..schema import STATUS_NAMES
from .reads import rows

#: Modelled cost of a lookup and of a row by source, and of a filter a row. They rank sources within one report and say nothing about Spark's time.
COSTS = {"lookup": 50.0, "index": 5.15, "columnar": 0.91, "row": 1.54, "filter": 3.0}

#: Reasons against a source.
REASONS = {
    "force_scan": "only scans are allowed (force_scan)",
    "force_row_scan": "only row scans are allowed (force_row_scan)",
    "subject": "no subject is given",
    "object": "no object is given",
    "predicate": "no predicate is given",
    "observed": "there is no upper bound on observed_at",
    "as_of": "current state is of no use to a read of the past",
    "shape": "current state holds open-ended active rows alone; others are asked for too",
}


def describe_predicates(tables: Tables) -> DataFrame:
    """id, name, current_rows of every predicate, zeros included."""
    counts = rows(tables, F.col("valid_to") == 0).where(is_current()).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    return tables.predicates.join(counts, F.col("id") == F.col("predicate"), "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("current_rows"))


def describe_corpus(tables: Tables) -> DataFrame:
    """One row: counts by status and spans of time (null if there are no rows), distinct subjects and current objects."""
    counts = [F.count_if(F.col("status_code") == i).alias(name.lower()) for i, name in enumerate(STATUS_NAMES)]
    spans = [f(c).alias(f"{n}_{c}") for c in ("observed_at", "valid_from") for n, f in (("min", F.min), ("max", F.max))]
    return rows(tables).agg(
        F.count(F.lit(1)).alias("assertion_count"),
        F.count_distinct("subject").alias("distinct_subjects"),
        F.count_distinct(F.when(is_current(), F.col("object"))).alias("distinct_current_objects"),
        *counts, *spans,
    )


def explain_query(query: Query, tables: Tables) -> dict:
    """Every source weighed: exact row counts from one aggregate, modelled costs, and reasons against. `plan` is Catalyst's own."""
    query.validate()
    subject, object = tables.resolve(query.subject), tables.resolve(query.object)
    bounds = [t for t in (query.observed_to, query.as_of_observed) if t is not None]
    mine = F.col("subject") == F.lit(subject) if subject is not None else F.lit(False)
    found = rows(tables).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct("subject").alias("subjects"),
        F.count_if(mine).alias("subject"),
        F.count_if(mine & (F.col("observed_at") <= F.lit(min(bounds) if bounds else 0))).alias("observed"),
        F.count_if(is_current() & (F.col("object") == F.lit(object if object is not None else 0))).alias("object"),
        F.count_if(is_current() & (F.col("predicate") == F.lit(query.predicate if query.predicate is not None else 0))).alias("predicate"),
    ).first()
    considered: list[dict] = []

    def usable(source: str, n: int, cost: float) -> None:
        considered.append({"source": source, "rows": n, "cost": cost})

    def rejected(source: str, why: str) -> None:
        considered.append({"source": source, "rejected_because": REASONS[why]})

    def index(source: str, n: int) -> None:
        usable(source, n, COSTS["lookup"] + COSTS["index"] * n)

    if query.force_scan:
        rejected("subject_index", "force_scan")
    elif subject is None:
        rejected("subject_index", "subject")
    else:
        index("subject_index", found.subject)
        index("observed_time_index", found.observed) if bounds else rejected("observed_time_index", "observed")
    for source, named, n in (("object_current_index", object, found.object), ("predicate_current_index", query.predicate, found.predicate)):
        if query.force_scan:
            rejected(source, "force_scan")
        elif named is None:
            rejected(source, source.split("_")[0])
        elif query.is_as_of:
            rejected(source, "as_of")
        elif not query.is_current_shaped:
            rejected(source, "shape")
        else:
            index(source, n)
    rejected("columnar_scan", "force_row_scan") if query.force_row_scan else usable("columnar_scan", found.total, COSTS["columnar"] * found.total)
    usable("row_scan", found.total, COSTS["row"] * found.total)
    best = min((c for c in considered if "cost" in c), key=lambda c: c["cost"])
    per_row = query.filter is not None
    return {
        "chosen": best["source"], "estimated_rows": best["rows"], "estimated_cost": best["cost"] + per_row * COSTS["filter"] * best["rows"],
        "filter_evaluated_per_row": per_row, "total_rows": found.total, "distinct_subjects": found.subjects, "considered": considered,
        "plan": page(query, tables)._jdf.queryExecution().explainString(tables.log.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")),
    }
