"""Connected components of a link table by alternating large-star and small-star rounds.

Links stay distributed: each task first shrinks its links to a spanning forest, then rounds of two stars
run until the links don't change. What is left of few links, FEW at most, makes one forest more instead, in one task. Every round is checkpointed, and what the one before shuffled is given back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_with_hot, shared_root, swept, written

#: Links that one task takes at once; rounds over so few are nothing but scheduling.
FEW = 200_000


def forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node that this task's links lead to) for each node that isn't the smallest itself."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def links():
        out = [(x, root(x)) for x in list(up)]
        return [(x, r) for x, r in out if x != r]

    def rows(found):
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
        if len(up) > 1_000_000:
            yield from rows(links())
            up.clear()
    yield from rows(links())


def _star(links: DataFrame) -> DataFrame:
    """links (a, b), a > b. Large star: every larger neighbour of a node goes to its smallest neighbour; small star: every smaller one, and the node."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = written(least, "least")
    # a component's centre has a link to every member: it must not meet them all in one task
    large = join_with_hot(both, least.select("a", "m"), "a", least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of links; root is the smallest node reachable. Links of a node with itself and repeated links do no harm."""
    shared_root(links.sparkSession)
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    made = written(pairs.mapInArrow(forest, "a long, b long"), "forest")
    few, state = made.count() <= FEW, None
    now = written(made.coalesce(1).mapInArrow(forest, "a long, b long"), "one-forest") if few else made.distinct()
    while not few:
        now = now.checkpoint()
        swept(links.sparkSession)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.h) == state:
            break
        state = (found.n, found.h)
        now = _star(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
