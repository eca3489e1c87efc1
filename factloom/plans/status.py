"""Statuses from links: the last record in scope that closes a row decides, else the status it was appended with.

A snapshot settles what it holds: each record is stored with its closers, so reads of it join nothing. Records behind the snapshot
may close settled ones; their links, and they alone, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOG, MAX_INLINE, RETRACTED, SUPERSEDED

#: Links of the records behind a snapshot that are few enough to be sent to every task; the store knows how many there are.
FEW_LINKS = 100_000


def in_scope(as_of_commit: int | None = None, as_of_observed: int | None = None) -> Column | None:
    if as_of_commit is not None:
        return F.col("id") <= F.lit(as_of_commit)
    if as_of_observed is not None:
        return F.col("observed_at") <= F.lit(as_of_observed)
    return None


def links(log: DataFrame) -> DataFrame:
    """(target, as, id, observed_at) of each record that closes another. A record has one link at most, so one scan finds both kinds."""
    superseding = F.col("supersedes_id") != 0
    return log.where("supersedes_id <> 0 or retracts_id <> 0").select(
        F.when(superseding, F.col("supersedes_id")).otherwise(F.col("retracts_id")).alias("target"),
        F.when(superseding, F.lit(SUPERSEDED)).otherwise(F.lit(RETRACTED)).cast("tinyint").alias("as"),
        "id", "observed_at",
    )


def _last(as_of_observed: int | None, of: str = "") -> Column:
    """What orders closers, with the status they give."""
    fields = ["observed_at", "id", "as"] if as_of_observed is not None else ["id", "as"]
    return F.struct(*(F.col(f"{of}{f}").alias(f) for f in fields))


def closers(found: DataFrame, as_of_commit: int | None = None, as_of_observed: int | None = None) -> DataFrame:
    """(target, closer): one row a closed record, of links. Aggregated map-side first, so a record that many others close is no hot key."""
    scope = in_scope(as_of_commit, as_of_observed)
    seen = found if scope is None else found.where(scope)
    return seen.groupBy("target").agg(F.max(_last(as_of_observed)).alias("closer"))


def with_status(log: DataFrame, as_of_commit: int | None = None, as_of_observed: int | None = None, rows: Column | None = None) -> DataFrame:
    """The visible rows of a log that nothing is settled of, with status_code instead of appended_status.

    rows: a condition on the rows wanted; it limits the rows, never their closers, which may have other subjects, predicates and times.
    """
    seen = _visible(log, as_of_commit, as_of_observed, rows)
    joined = seen.join(closers(links(log), as_of_commit, as_of_observed), F.col("id") == F.col("target"), "left")
    return joined.withColumn("status_code", F.coalesce(F.col("closer")["as"], "appended_status")).drop("target", "closer", "appended_status")


def _visible(log: DataFrame, as_of_commit: int | None, as_of_observed: int | None, rows: Column | None) -> DataFrame:
    scope = in_scope(as_of_commit, as_of_observed)
    seen = log if scope is None else log.where(scope)
    return seen if rows is None else seen.where(rows)


def _settled_closer(as_of_commit: int | None, as_of_observed: int | None) -> Column:
    """The last closer in scope, of those that are stored with a record."""
    if as_of_observed is not None:
        inside = F.filter("closers", lambda c: c["observed_at"] <= F.lit(as_of_observed))
        return F.array_max(F.transform(inside, lambda c: F.struct(c["observed_at"].alias("observed_at"), c["id"].alias("id"), c["as"].alias("as"))))
    inside = F.filter("closers", lambda c: c["id"] <= F.lit(as_of_commit))
    return F.array_max(F.transform(inside, lambda c: F.struct(c["id"].alias("id"), c["as"].alias("as"))))


def statuses(tables, as_of_commit: int | None = None, as_of_observed: int | None = None, rows: Column | None = None) -> DataFrame:
    """with_status over a store's tables: settled records by what is stored with them, those behind the snapshot by their links."""
    if tables.settled is None:
        return with_status(tables.log, as_of_commit, as_of_observed, rows)
    kept = [c for c in LOG.names if c != "appended_status"]
    seen = _visible(tables.settled, as_of_commit, as_of_observed, rows)
    if as_of_commit is None and as_of_observed is None:
        code = F.col("closed_as")
        own = None
    else:
        own = _settled_closer(as_of_commit, as_of_observed)
        if tables.crowded is not None:
            more = closers(tables.crowded, as_of_commit, as_of_observed).select(F.col("target").alias("__crowded"), F.col("closer").alias("__more"))
            seen = seen.join(more, F.col("id") == F.col("__crowded"), "left")
            own = F.coalesce("__more", own)
        code = own["as"]
    if tables.tail is None:
        return seen.select(*kept, F.coalesce(code, "appended_status").alias("status_code"))
    if tables.tail_links:
        later = closers(links(tables.tail), as_of_commit, as_of_observed).withColumnRenamed("closer", "__later")
        if tables.tail_links <= FEW_LINKS:
            later = F.broadcast(later)
        seen = seen.join(later, F.col("id") == F.col("target"), "left")
        # identifiers behind the snapshot are larger than all in it; observed times needn't be
        code = F.greatest(own, "__later")["as"] if as_of_observed is not None else F.coalesce(F.col("__later")["as"], code)
    settled = seen.select(*kept, F.coalesce(code, "appended_status").alias("status_code"))
    if tables.tail_links:
        return settled.unionByName(with_status(tables.tail, as_of_commit, as_of_observed, rows))
    return settled.unionByName(_visible(tables.tail, as_of_commit, as_of_observed, rows).withColumnRenamed("appended_status", "status_code"))


def settle(log: DataFrame) -> DataFrame:
    """The log with each record's closers (SETTLED), for a snapshot. Of a record that many others close, MAX_INLINE + 1 links a task go on, whatever their number."""
    found = links(log)
    newest = found.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("id")))).where(F.col("r") <= MAX_INLINE + 1)
    closed = newest.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("id", "observed_at", "as"))).alias("closers"), F.max_by("as", "id").alias("closed_as"))
    crowded = F.size("closers") > MAX_INLINE
    closed = closed.select("target", "closed_as", F.when(~crowded, F.col("closers")).alias("closers"), crowded.alias("crowded"))
    return log.join(closed, F.col("id") == F.col("target"), "left").select(*LOG.names, "closed_as", "closers", F.coalesce("crowded", F.lit(False)).alias("crowded"))


def crowded_links(log: DataFrame, settled: DataFrame) -> DataFrame:
    """The links (CROWDED) of records that have more of them than are stored with one."""
    targets = settled.where("crowded").select(F.col("id").alias("target"))
    return links(log).join(targets, "target", "left_semi")
