"""The log as a stream: each committed record once, bulk-loaded, archived and snapshot ones too.

Statuses aren't part of the feed: they need all later corrections, so no watermark could ever drop history. Backdated rows
come when they are committed.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import LOG
from . import feed

register_pickle_by_value(feed)  # workers needn't have the package
_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG.fields)


def changes(spark: SparkSession, root: str | Path, observed_since: int | None = None, after: int = 0) -> DataFrame:
    """Records of a store behind an identifier, as they are committed."""
    spark.dataSource.register(feed.LogSource)
    stream = spark.readStream.format("factloom-log").option("root", str(Path(root).resolve())).option("after", str(after)).option("schema", _DDL).load()
    return stream if observed_since is None else stream.where(F.col("observed_at") >= F.lit(observed_since))


def counts_by_bucket(stream: DataFrame, width: int) -> DataFrame:
    """Records a predicate and bucket of observed time; state has a row a group, and late records change their group."""
    return stream.groupBy("predicate", (F.col("observed_at") - F.pmod("observed_at", F.lit(width).cast("bigint"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what is there now and ends; started again with the same checkpoint it goes on from there."""
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
