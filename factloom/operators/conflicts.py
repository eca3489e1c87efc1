"""Conflicts: active rows of one subject and predicate with different objects and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import overlaps
from ..plans.compile import Tables
from ..schema import ACTIVE
from .reads import rows


#: Rows of one subject and predicate that one task holds against others, about.
TOGETHER = 5_000


def conflicts(tables: Tables, where: Column | None = None, together: int = TOGETHER) -> DataFrame:
    """Pairs (a_id, b_id), a_id < b_id, with their subject and predicate.

    The join has equality keys, so it is partitioned by (subject, predicate); overlap and difference are residual conditions of the same join. Groups of more than `together` rows are
    cut into slices: a row meets the other rows of each slice of its group in a task of that slice, so that a frequent subject is work for many.
    """
    active = rows(tables, where).where(F.col("status_code") == ACTIVE).select("subject", "predicate", "id", "object", "valid_from", "valid_to")
    fields = ("id", "object", "valid_from", "valid_to")
    sizes = active.groupBy("subject", "predicate").agg(F.ceil(F.count(F.lit(1)) / F.lit(together)).cast("int").alias("slices")).where("slices > 1")
    large = sizes.limit(MOST_LARGE + 1).collect()
    if large and len(large) <= MOST_LARGE:
        known = F.broadcast(active.sparkSession.createDataFrame([tuple(r) for r in large], sizes.schema))
        active = active.join(known, ["subject", "predicate"], "left")
    elif large:
        active = active.join(sizes, ["subject", "predicate"], "left")
    else:
        active = active.withColumn("slices", F.lit(None).cast("int"))
    slices = F.coalesce("slices", F.lit(1))
    a = active.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("subject", "predicate", "slice", *(F.col(c).alias(f"a_{c}") for c in fields))
    b = active.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).select("subject", "predicate", "slice", *(F.col(c).alias(f"b_{c}") for c in fields))
    meet = (F.col("a_id") < F.col("b_id")) & (F.col("a_object") != F.col("b_object")) & overlaps(F.col("a_valid_from"), F.col("a_valid_to"), F.col("b_valid_from"), F.col("b_valid_to"))
    return a.join(b, ["subject", "predicate", "slice"]).where(meet).drop("slice")


#: Large groups that are few enough to be sent to every task.
MOST_LARGE = 100_000


def find_conflicts(tables: Tables, subject: int, predicate: int) -> DataFrame:
    return conflicts(tables, (F.col("subject") == F.lit(tables.resolve(subject))) & (F.col("predicate") == F.lit(predicate)))
