"""The driver's events as an assertion log, loaded into a store once a session and table, and read from there.

Identifiers are arithmetic (no ranking over the data): an event's row is its id, a user is a subject, and objects are numbered
by kind. Some objects stay without a value. Residues of event_id pick corrections, hypotheses, closed intervals and backdating.
SQL twins of these rules are in plans/queries.py.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import struct_of
from ..plans.compile import Tables
from ..schema import HYPOTHESIS, RETRACTION, EngineError
from .scratch import shared_folder
from .store import Store

PAGE, COUNT, FLAG, AMOUNT, DOCUMENT = 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000, 1_000_000_000_000


def _parts(events: DataFrame) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return events.select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), k.alias("k"))


def _object() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "purchase", AMOUNT + F.col("cents")).when(kind == "error", COUNT + F.col("k")).when(kind == "signup", FLAG + F.col("k") % 2).otherwise(PAGE + F.col("k"))


def predicates(events: DataFrame) -> DataFrame:
    """Event types numbered by name; a handful of rows after the distinct."""
    types = events.select("event_type").where("event_type is not null").distinct()
    return types.select(F.row_number().over(Window.orderBy("event_type")).cast("bigint").alias("id"), F.col("event_type").alias("name"))


def log(events: DataFrame) -> DataFrame:
    e = _parts(events)
    types = F.broadcast(predicates(events).select(F.col("id").alias("predicate"), F.col("name").alias("__name")))  # a row an event type
    e = e.join(types, F.col("event_type") == F.col("__name")).drop("__name")
    subject = (F.col("user_id") + 1).cast("bigint")
    before = Window.partitionBy("subject", "predicate").orderBy("event_id")
    n = F.col("event_id")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = e.withColumn("subject", subject).withColumn("one", F.lag("event_id", 1).over(before) + 1).withColumn("two", F.lag("event_id", 2).over(before) + 1)
    supersedes = F.when(n % 5 == 2, F.col("one")).when(n % 23 == 7, F.col("two"))
    retracts = F.when(F.coalesce(supersedes, F.lit(0)) == 0, F.when(n % 17 == 4, F.col("one")))
    return e.select(
        (n + 1).cast("bigint").alias("id"), "subject", "predicate", _object().cast("bigint").alias("object"),
        start.alias("valid_from"), F.when(n % 3 == 0, start + 86_400).otherwise(0).cast("bigint").alias("valid_to"),
        (start + n % 7 * 3600 - F.when(n % 11 == 3, 200_000).otherwise(0)).cast("bigint").alias("observed_at"),
        (n % 101 / 100).cast("double").alias("confidence"),
        F.when(F.coalesce(retracts, F.lit(0)) != 0, RETRACTION).when(n % 19 == 5, HYPOTHESIS).otherwise(0).cast("tinyint").alias("appended_status"),
        F.coalesce(supersedes, F.lit(0)).cast("bigint").alias("supersedes_id"), F.coalesce(retracts, F.lit(0)).cast("bigint").alias("retracts_id"),
    )


def entities(events: DataFrame) -> DataFrame:
    e = _parts(events)
    users = e.select((F.col("user_id") + 1).cast("bigint").alias("id")).distinct().select("id", struct_of(0, F.concat(F.lit("user-"), (F.col("id") - 1).cast("string"))).alias("value"))
    objects = e.select(_object().cast("bigint").alias("id")).distinct()
    at = F.col("id")
    pages = objects.where((at >= PAGE) & (at < COUNT) & ((at - PAGE) % 13 != 0)).select("id", struct_of(0, F.concat(F.lit("page-"), (at - PAGE).cast("string"))).alias("value"))
    counts = objects.where((at >= COUNT) & (at < FLAG)).select("id", struct_of(1, at - COUNT).alias("value"))
    flags = objects.where((at >= FLAG) & (at < AMOUNT)).select("id", struct_of(3, at - FLAG == 1).alias("value"))
    amounts = objects.where(at >= AMOUNT).select("id", struct_of(2, (at - AMOUNT) / 100).alias("value"))
    return users.unionByName(pages).unionByName(counts).unionByName(flags).unionByName(amounts)


#: Redirects in order: a chain of users, one that a later one replaces, cycles of two and three with tails before them, and the same among pages.
REDIRECTS = [
    (100_001, 100_000), (100_000, 1), (100_002, 7), (100_002, 2), (200_001, 200_002), (200_002, 200_001), (200_003, 200_001), (300_001, 300_002), (300_002, 300_003), (300_003, 300_001), (300_004, 300_002),
    (PAGE + 6, PAGE + 7), (PAGE + 7, PAGE + 6), (PAGE + 8, PAGE + 6), (PAGE + 9, 9), (PAGE + 10, PAGE + 9),
]


def merges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, a, s, 10 * i) for i, (a, s) in enumerate(REDIRECTS, 1)], "seq BIGINT, absorbed BIGINT, surviving BIGINT, merged_at BIGINT")


def provenance(events: DataFrame) -> DataFrame:
    """Every third event has a source, every ninth a second record that replaces the first."""
    e = events.where("event_id % 3 = 0").select(F.col("event_id"), F.explode(F.when(F.col("event_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn"))
    return e.select(
        (F.col("event_id") * 2 + F.col("turn") + 1).cast("bigint").alias("seq"), (F.col("event_id") + 1).cast("bigint").alias("assertion_id"),
        (F.col("event_id") % 10 + F.col("turn") * 100 + 1).cast("bigint").alias("source"), (F.col("event_id") * 10 + F.col("turn")).cast("bigint").alias("recorded_at"),
        F.when(F.col("turn") == 0, "import").otherwise("review").alias("method"),
    )


def payloads(events: DataFrame) -> DataFrame:
    """A document for every seventh event: its properties."""
    return events.where("event_id % 7 = 0").select((F.col("event_id") + DOCUMENT).cast("bigint").alias("id"), F.encode(F.coalesce("props", F.lit("")), "utf-8").alias("content"))


def folder(spark: SparkSession, tag: str) -> Path:
    """A new folder for a store below the shared one, which a store needs to be mounted everywhere; removed when the driver ends."""
    place = urlparse(shared_folder(spark))
    if place.scheme not in ("", "file"):
        raise EngineError("a store needs a shared folder that is mounted; spark.checkpoint.dir isn't")
    path = Path(place.path) / f"factloom-{tag}-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def load(spark: SparkSession, events: DataFrame, root: Path, snapshot: bool = True) -> None:
    """All tables of events in a new store."""
    with Store(spark, root) as store:
        store.load_log(log(events))
        store.load("entities", entities(events), counter="entity")
        store.load("predicates", predicates(events), counter="predicate")
        store.load("merges", merges(spark), "seq")
        store.load("provenance", provenance(events), "assertion_id")
        store.load("payloads", payloads(events))
        if snapshot:
            store.write_snapshot()


_OPEN: dict[tuple, Tables] = {}


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def version_of(spark: SparkSession, path: str) -> tuple:
    """Session, path, and the newest change and length of what lies there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, path, system.getFileStatus(where).getModificationTime(), system.getContentSummary(where).getLength()


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a store that holds the events of sf_dir; loaded by the first call of a session, and again if the file changes."""
    key = version_of(spark, f"{sf_dir}/events.parquet")
    if key not in _OPEN:
        root = folder(spark, "store")
        load(spark, events_of(spark, sf_dir), root)
        _OPEN[key] = Store(spark, root, read_only=True).tables()
    return _OPEN[key]
