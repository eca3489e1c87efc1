"""Entity merges: one-way redirects, followed transitively; the last redirect of an entity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def redirects(merges: DataFrame) -> DataFrame:
    return merges.groupBy("absorbed").agg(F.max_by("surviving", "seq").alias("surviving"))


def resolve(merges: DataFrame, entity: int) -> int:
    """Follows redirects from one entity, a read a step; on a cycle the first entity met again. Nothing but the chain reaches the driver."""
    seen = {entity}
    while True:
        row = merges.where(F.col("absorbed") == F.lit(entity)).agg(F.max_by("surviving", "seq").alias("to")).first()
        if row is None or row["to"] is None:
            return entity
        entity = row["to"]
        if entity in seen:
            return entity
        seen.add(entity)


#: Redirects that are few enough to be followed by the driver; more are followed by joins.
FEW = 100_000


def few_redirects(merges: DataFrame) -> dict[int, int] | None:
    """All redirects, or None if there are more than FEW."""
    rows = redirects(merges).limit(FEW + 1).collect()
    return {r["absorbed"]: r["surviving"] for r in rows} if len(rows) <= FEW else None


def follow(found: dict[int, int], entity: int) -> int:
    """As resolve does, over redirects at hand."""
    seen = {entity}
    while entity in found:
        entity = found[entity]
        if entity in seen:
            break
        seen.add(entity)
    return entity


def _doubled(spark, now: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(absorbed, surviving) after 2^rounds steps, or fewer if all have come to an end, and whether all have."""
    for _ in range(rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.surviving") == F.col("b.absorbed"), "left")
        moved = step.select("a.absorbed", F.coalesce("b.surviving", "a.surviving").alias("surviving"), F.col("b.absorbed").isNotNull().alias("moved"))
        moved = checkpointed(spark, moved)
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now, True
    return now, False


def resolve_all(merges: DataFrame, few: int = FEW) -> DataFrame:
    """(absorbed, surviving) of every absorbed entity, as resolve gives it: the end of its chain, or, where that leads into a cycle, the first entity of the cycle that it meets, itself if it
    is on it.

    More than `few` redirects are followed by pointer doubling: as many rounds as n redirects can take lead everything that doesn't end onto a cycle, and onto all of its entities. Those are
    ends in a second pass. n redirects take log2(n) rounds each.
    """
    spark = merges.sparkSession
    start = checkpointed(spark, redirects(merges))
    n = start.count()
    if n <= few:
        found = {r["absorbed"]: r["surviving"] for r in start.collect()}
        return spark.createDataFrame([(e, follow(found, e)) for e in found], "absorbed BIGINT, surviving BIGINT")
    now, ended = _doubled(spark, start, n.bit_length() + 1)
    if ended:
        return now
    cyclic = checkpointed(spark, now.select(F.col("surviving").alias("absorbed")).distinct().join(start.select("absorbed"), "absorbed", "left_semi"))
    now, _ = _doubled(spark, checkpointed(spark, start.join(cyclic, "absorbed", "left_anti")), n.bit_length() + 1)
    return now.unionByName(cyclic.select("absorbed", F.col("absorbed").alias("surviving")))
