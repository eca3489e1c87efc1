"""Stores that the driver's events go into by several ways: loads, batches, archive and snapshot; and by the kernel's own commits, with names.

Each is made once a session and table, and read from then on.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import batched

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.values import Value, struct_of
from ..kernel import Kernel, PendingNamed, Provenance
from ..schema import LOG, MAX_BATCH
from . import adapter
from .store import Store

_MADE: dict[tuple, Store] = {}


def opened(spark: SparkSession, sf_dir: str, make: Callable[[SparkSession, str, Store], None]) -> Store:
    """A store that make fills, opened for reading."""
    key = (make.__name__, *adapter.version_of(spark, f"{sf_dir}/events.parquet"))
    if key not in _MADE:
        root = adapter.folder(spark, make.__name__)
        with Store(spark, root) as store:
            make(spark, sf_dir, store)
        _MADE[key] = Store(spark, root, read_only=True)
    return _MADE[key]


def _catalogs(spark: SparkSession, sf_dir: str, store: Store) -> None:
    whole = adapter.tables(spark, sf_dir)
    store.load("entities", whole.entities, counter="entity")
    store.load("predicates", whole.predicates, counter="predicate")


def archived(spark: SparkSession, sf_dir: str, store: Store) -> None:
    """Three loads, the first of which goes to the archive, and the last hundredth in batches."""
    whole = adapter.tables(spark, sf_dir)
    last = whole.last_id
    cuts = [0, last * 3 // 10, last * 6 // 10, last - last // 100]
    _catalogs(spark, sf_dir, store)
    for low, high in zip(cuts, cuts[1:]):
        store.load_log(whole.log.where((F.col("id") > low) & (F.col("id") <= high)))
    rest = whole.log.where(F.col("id") > cuts[-1]).orderBy("id").toLocalIterator()
    for some in batched(rest, min(MAX_BATCH, max(1, last // 300))):
        store.append({"log": [dict(zip(LOG.names, r)) for r in some]}, assertion=len(some))
    store.archive_segments_before(cuts[1] + 1)


def snapshot_and_tail(spark: SparkSession, sf_dir: str, store: Store) -> None:
    """A snapshot of the first six tenths, settled again with the next three, and a tail behind it."""
    whole = adapter.tables(spark, sf_dir)
    last = whole.last_id
    cuts = [0, last * 6 // 10, last * 9 // 10, last]
    _catalogs(spark, sf_dir, store)
    for low, high in zip(cuts, cuts[1:]):
        store.load_log(whole.log.where((F.col("id") > low) & (F.col("id") <= high)))
        if high < last:
            store.write_snapshot()


#: Events at both ends that go into the store by commit_batch_by_name, and turns that become one commit.
ENDS, TURNS = 300, 1000


def committed(spark: SparkSession, sf_dir: str, store: Store) -> None:
    """All events by name: the first and last by commit_batch_by_name, those between by load_by_name. Then, for every 499th of them, a correction, a hypothesis or a merge, and provenance and documents beside them."""
    kernel = Kernel.over(store)
    events = adapter.events_of(spark, sf_dir).where("event_type is not null")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    rows = events.select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), k.alias("k"))

    def commit(some: list) -> None:
        kernel.commit_batch_by_name(
            [PendingNamed(f"user-{r.user_id}", r.event_type, Value("int64", r.k) if r.event_id % 2 else Value("text", f"page-{r.k}"), r.start, 0, r.start, r.event_id % 101 / 100) for r in some]
        )

    first = rows.orderBy("event_id").limit(ENDS).collect()
    commit(first)
    if len(first) == ENDS:
        rest = rows.where(F.col("event_id") > first[-1].event_id)
        last = rest.orderBy(F.desc("event_id")).limit(ENDS).collect()[::-1]
        if last:
            between = rest.where(F.col("event_id") < last[0].event_id)
            value = F.when(F.col("event_id") % 2 != 0, struct_of(1, F.col("k"))).otherwise(struct_of(0, F.concat(F.lit("page-"), F.col("k").cast("string"))))
            named = between.select(
                "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject_name"), F.col("event_type").alias("predicate_name"), value.alias("object"),
                F.col("start").alias("valid_from"), F.lit(0).cast("bigint").alias("valid_to"), F.col("start").alias("observed_at"), (F.col("event_id") % 101 / 100).alias("confidence"),
            )
            kernel.load_by_name(named, "event_id")
            commit(last)
    end = store.next("assertion")
    for some in batched(range(3, end, 499), TURNS):
        with kernel.together():
            for at in some:
                _turn(kernel, at)


def _turn(kernel: Kernel, at: int) -> None:
    turn = at // 499 % 4
    if turn == 0:
        kernel.commit_superseding(1, 1, 2, at, 0, at, 0.5, supersedes_id=at)
    elif turn == 1:
        kernel.commit_retraction(1, 1, 2, at, 0, at, 0.5, retracts_id=at)
    elif turn == 2:
        kernel.commit_hypothesis(1, 1, 2, at, 0, at, 0.5, source=at, recorded_at=at + 1, method="script")
    else:
        kernel.commit(1, 1, 2, at, 0, at, 0.5)
        kernel.record_provenance(at, at, at + 2, "single")
    kernel.record_provenance_batch([Provenance(at, at + 1, at + 3, "batch"), Provenance(1, at, at, "first")])
    kernel.intern_document(f"document {at}".encode())
    kernel.merge_entities(1, 1_000_000 + at, at)
