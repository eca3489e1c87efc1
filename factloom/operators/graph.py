"""Graph reads: edges are current rows, followed both ways; correction chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_current
from ..plans.compile import Tables, shown
from ..plans.status import links
from ..schema import EngineError
from ..sources.scratch import checkpointed
from .merges import resolve_all
from .reads import rows

MAX_HOPS = 1000


def edges(tables: Tables) -> DataFrame:
    """(subject, object) of current rows."""
    return rows(tables, F.col("valid_to") == 0).where(is_current()).select("subject", "object").distinct()


#: Entities of a hop, and edges from and to them, that are few enough to be followed by the driver.
FEW = 1_000


def neighbors(tables: Tables, start: int, max_hops: int = 1, few: int = FEW) -> DataFrame:
    """(entity, hops) for every entity that at most max_hops edges reach, start excluded.

    As the fixed-shape reads do, outgoing edges are those of the frontier's merged entity and incoming ones those of the entity itself.
    As long as a hop has at most `few` entities and edges it is one read that names them; from the first larger one on, hops are joins of the frontier with the edges.
    """
    if max_hops < 0 or max_hops > MAX_HOPS:
        raise EngineError(f"max_hops is 0 to {MAX_HOPS}")
    spark, start = tables.log.sparkSession, tables.resolve(start)
    reached, frontier, hop = {start: 0}, {start}, 1
    while hop <= max_hops and frontier and len(frontier) <= few and tables.redirects is not None:
        out = {tables.resolve(e) for e in frontier}
        near = F.col("subject").isin(sorted(out)) | F.col("object").isin(sorted(frontier))
        edge = rows(tables, near & (F.col("valid_to") == 0)).where(is_current()).select("subject", "object").limit(few + 1).collect()
        if len(edge) > few:
            break
        frontier = ({r["object"] for r in edge if r["subject"] in out} | {r["subject"] for r in edge if r["object"] in frontier}) - reached.keys()
        reached |= dict.fromkeys(frontier, hop)
        hop += 1
    found = spark.createDataFrame(list(reached.items()), "entity BIGINT, hops INT")
    if hop <= max_hops and frontier:
        found = _joined(tables, found, hop, max_hops)
    return found.where("hops > 0")


def _joined(tables: Tables, reached: DataFrame, hop: int, max_hops: int) -> DataFrame:
    """The hops from one on as joins with the edges, and an anti-join with what was reached; each is checkpointed."""
    spark, edge = tables.log.sparkSession, edges(tables)
    if max_hops > hop and tables.settled is None:  # a snapshot is read as fast as what would be kept of it
        edge = checkpointed(spark, edge)
    merged = resolve_all(tables.merges) if tables.redirects != {} else None
    frontier = reached.where(F.col("hops") == hop - 1).select("entity")
    for hop in range(hop, max_hops + 1):
        out = frontier
        if merged is not None:
            out = frontier.join(merged, F.col("entity") == F.col("absorbed"), "left").select(F.coalesce("surviving", "entity").alias("entity"))
        forward = out.join(edge, F.col("entity") == F.col("subject")).select(F.col("object").alias("entity"))
        backward = frontier.join(edge, F.col("entity") == F.col("object")).select(F.col("subject").alias("entity"))
        frontier = checkpointed(spark, forward.unionByName(backward).distinct().join(reached.select("entity"), "entity", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return reached


def co_occurring_predicates(tables: Tables, subject: int) -> DataFrame:
    return rows(tables, (F.col("subject") == F.lit(tables.resolve(subject))) & (F.col("valid_to") == 0)).where(is_current()).select("predicate").distinct()


def chains(tables: Tables, rounds: int = 40) -> DataFrame:
    """(id, root, depth) of every record: where its chain of corrections begins, and how many links away. Pointer doubling.

    Links always point to smaller identifiers, so chains end; n links take log2(n) rounds.
    """
    spark = tables.log.sparkSession
    start = checkpointed(spark, links(tables.log).select("id", F.col("target").alias("root"), F.lit(1).cast("bigint").alias("depth")))
    now = start
    for _ in range(rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.id"), "left")
        moved = step.select("a.id", F.coalesce("b.root", "a.root").alias("root"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), F.col("b.id").isNotNull().alias("moved"))
        moved = checkpointed(spark, moved)
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    ends = now.select(F.col("id").alias("__id"), "root", "depth")
    whole = tables.log.select("id").join(ends, F.col("id") == F.col("__id"), "left")
    return whole.select("id", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def explain(tables: Tables, id: int) -> list[dict]:
    """The chain from a record to its root, newest first: a read a link for short chains.

    Beyond, links are doubled until each record knows its root, and those of the asked one's root and not above it are walked, in falling order and a partition at a time.
    """
    chain, at = [], id
    found = links(tables.log)
    for _ in range(8):
        chain.append(at)
        row = found.where(F.col("id") == F.lit(at)).first()
        if row is None:
            at = None
            break
        at = row["target"]
    if at is not None:
        spark = tables.log.sparkSession
        below = checkpointed(spark, chains(tables).where((F.col("depth") > 0) & (F.col("id") <= F.lit(at))).select("id", "root"))
        own = below.where(F.col("id") == F.lit(at)).first()
        if own is not None:
            mine = found.join(below.where(F.col("root") == F.lit(own["root"])).select("id"), "id", "left_semi")
            for row in mine.orderBy(F.desc("id")).toLocalIterator():
                if row["id"] == at:  # links point down, so one pass over falling identifiers walks the chain
                    chain.append(at)
                    at = row["target"]
        chain.append(at)
    found = {r["id"]: r.asDict() for r in shown(rows(tables, F.col("id").isin(chain[:1000]))).collect()} if len(chain) <= 1000 else {}
    if len(chain) > 1000:
        asked = tables.log.sparkSession.createDataFrame([(i,) for i in chain], "asked BIGINT")
        found = {r["id"]: r.asDict() for r in shown(rows(tables).join(asked, F.col("id") == F.col("asked"), "left_semi")).collect()}
    return [found[i] for i in chain if i in found]
