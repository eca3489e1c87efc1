"""Exact deduplication by a log-structured merge index over text digests.

Each task fills memtables (digest -> members). A full memtable is flushed as a run, sorted by digest, to a Parquet file with
Bloom filters on the digest; every flush is a generation of its own. Compaction merges what was compacted before and the runs since, all
sorted by digest, into one sorted data set of a row a digest, which keeps the smallest (or largest) identifier. Digests of several entries are
hits: a filter over (digest, identifier) picks the texts behind them, which are compared byte by byte, and texts
that only share a digest are put in groups of their own.

Hot groups: a memtable holds any number of copies as one entry, so a text with a third of all rows adds one entry a run; those entries
aren't sent to one task either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, filter_of, free_name, id_and_text, join_with_hot, may_hold, release, shared_path, written

RUN = "digest binary, run long, slot int, keep_id long, at int, n long, ids array<long>"
MERGED = "digest binary, win_id long, win_run long, win_slot int, total long, entries long"
SHOWN = pa.schema([("digest", pa.binary()), ("run", pa.int64()), ("slot", pa.int32()), ("keep_id", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])
#: Entries whose texts one task compares with their winner's, about.
TOGETHER = 64
FILTERED = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}


def digest_of(text: bytes, size: int = 32) -> bytes:
    return hashlib.sha256(text).digest()[:size]


def _best(ids: list, keep: str) -> int:
    """Position of the identifier that stays; null is below every number, of equal ones the first stays."""
    low = float("-inf")
    pick = max if keep == "largest" else min
    if keep == "smallest" and any(x is not None for x in ids):
        return min((x, i) for i, x in enumerate(ids) if x is not None)[1]
    best = pick(low if x is None else x for x in ids)
    return next(i for i, x in enumerate(ids) if (low if x is None else x) == best)


def _flush(table: dict[bytes, list], run: int, keep: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for digest in sorted(table):
        for slot, (_, ids) in enumerate(table[digest]):
            at = _best(ids, keep)
            rows.append((digest, run, slot, ids[at], at, len(ids), ids))
        if len(rows) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHOWN.types)], schema=SHOWN)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SHOWN.types)], schema=SHOWN)


def memtables(generation: int, keep: str, digest_bytes: int, memtable_bytes: int, memtable_rows: int):
    def run_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        run = generation << 44 | TaskContext.get().partitionId() << 20
        table: dict[bytes, list] = {}
        held = rows = 0
        for batch in batches(it):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                slots = table.setdefault(digest_of(text, digest_bytes), [])
                for kept, ids in slots:
                    if kept == text:  # bytes, not only digests
                        ids.append(doc_id)
                        break
                else:
                    slots.append((text, [doc_id]))
                    held += len(text) + 300
                rows += 1
                if held >= memtable_bytes or rows >= memtable_rows:
                    yield from _flush(table, run, keep)
                    table, held, rows, run = {}, 0, 0, run + 1
        yield from _flush(table, run, keep)

    return run_task


def _pairs(ids: pa.Array, digests: list[bytes]) -> np.ndarray:
    """A number for each (identifier, digest); digests of fewer than 8 bytes are filled up."""
    own = np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests), np.int64)
    return own ^ (ids.fill_null(-1).to_numpy(zero_copy_only=False) << 1)


class MergeIndex:
    """Digest runs below a folder.

    keep: "smallest" or "largest" identifier of each group stays. digest_bytes: SHA-256 is cut to so many bytes (tests force collisions by it).
    Nulls: a null text counts as empty, a null identifier is a row like others and stays only if its group has no other.
    A repeated row (identifier and text) is one more member; only one of them is kept. Empty table: empty result.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", digest_bytes: int = 32, memtable_bytes: int = 32 << 20, memtable_rows: int = 500_000):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.path, self.keep, self.digest_bytes = spark, path or shared_path(spark, "runs"), keep, digest_bytes
        self.memtable = (memtable_bytes, memtable_rows)

    def _folders(self, kind: str) -> dict[int, str]:
        """Complete generations or compactions by number."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        paths = [f.getPath() for f in system.listStatus(where)] if system.exists(where) else []
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return {int(p.getName().split("-")[1]): p.toString() for p in paths if p.getName().startswith(f"{kind}-") and system.exists(mark(p, "_SUCCESS"))}

    def flush(self, docs: DataFrame) -> int:
        """Adds a generation with the runs of docs (doc_id, text) and returns its number; earlier ones stay."""
        number = max([0, *self._folders("generation")]) + 1
        runs = id_and_text(docs).mapInArrow(memtables(number, self.keep, self.digest_bytes, *self.memtable), RUN)
        runs.write.options(**FILTERED).mode("overwrite").parquet(f"{self.path}/generation-{number:06d}")
        return number

    def runs(self, after: int = 0) -> DataFrame:
        """Entries of the generations after a number."""
        folders = [path for number, path in sorted(self._folders("generation").items()) if number > after]
        return self.spark.read.schema(RUN).parquet(*folders) if folders else self.spark.createDataFrame([], RUN)

    def merged(self) -> tuple[int, DataFrame | None]:
        """The last compaction, and the generation up to which it holds everything."""
        folders = self._folders("merged")
        return (max(folders), self.spark.read.schema(MERGED).parquet(folders[max(folders)])) if folders else (0, None)

    @staticmethod
    def _as_merged(runs: DataFrame) -> DataFrame:
        return runs.select("digest", F.col("keep_id").alias("win_id"), F.col("run").alias("win_run"), F.col("slot").alias("win_slot"), F.col("n").alias("total"), F.lit(1).cast("long").alias("entries"))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Winner and members of a few digests, compacted or not yet; the Parquet filters let files be skipped."""
        upto, merged = self.merged()
        asked = F.col("digest").isin([bytearray(d) for d in digests])
        found = self._as_merged(self.runs(upto).where(asked))
        return self._merge(found if merged is None else found.unionByName(merged.where(asked)))

    def _winner(self, id: str = "keep_id", run: str = "run", slot: str = "slot"):
        id, run, slot = F.col(id), F.col(run), F.col(slot)
        held = (id.alias("id"), run.alias("run"), slot.alias("slot"))
        if self.keep == "smallest":
            return F.min(F.struct(id.isNull().cast("int").alias("none"), *held))
        return F.max(F.struct(F.coalesce(id, F.lit(-(1 << 63))).alias("k"), (-run).alias("r"), (-slot).alias("s"), *held))

    def _merge(self, entries: DataFrame) -> DataFrame:
        """One row a digest of entries in MERGED's form."""
        merged = entries.groupBy("digest").agg(self._winner("win_id", "win_run", "win_slot").alias("w"), F.sum("total").alias("total"), F.sum("entries").alias("entries"))
        return merged.select("digest", F.col("w.id").alias("win_id"), F.col("w.run").alias("win_run"), F.col("w.slot").alias("win_slot"), "total", "entries")

    def compact(self) -> DataFrame:
        """Merges the last compaction and the generations since into one data set, sorted by digest and dealt by its ranges, and returns it.

        Members stay in the generations. The replaced compaction goes; a reader that has it open should open the new one.
        """
        upto, before = self.merged()
        latest = max([0, *self._folders("generation")])
        if latest > upto:
            since = self._as_merged(self.runs(upto))
            entries = since if before is None else since.unionByName(before)
            path = f"{self.path}/merged-{latest:06d}"
            self._merge(entries.repartitionByRange("digest")).sortWithinPartitions("digest").write.options(**FILTERED).mode("overwrite").parquet(path)
            if before is not None:
                old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/merged-{upto:06d}")
                old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        merged = self.merged()[1]
        return self.spark.createDataFrame([], MERGED) if merged is None else merged

    def groups(self, docs: DataFrame) -> DataFrame:
        """One row per row of docs, which are all that was flushed: doc_id, keep_id, group_size, kept, digest."""
        merged = self.compact()
        entries = self.runs()
        weights = merged.select("digest", F.col("entries").alias("n"))
        several = merged.where("entries > 1")
        hits = written(join_with_hot(entries.drop("ids"), several, "digest", weights), "hits")
        bad = None
        if not hits.isEmpty():
            salt = F.pmod(F.xxhash64("run", "slot"), F.ceil(F.col("entries") / TOGETHER)).cast("int")
            texts = written(self._texts(docs, hits).withColumn("salt", salt), "hit-texts")
            first = texts.where("run = win_run and slot = win_slot").dropDuplicates(["digest"])
            first = first.select("digest", F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("entries") / TOGETHER) - 1).cast("int"))).alias("salt"))
            other = texts.where("not (run = win_run and slot = win_slot)").join(first, ["digest", "salt"]).where("text <> first_text")
            bad = written(other.select("digest").distinct(), "collisions")
            if bad.isEmpty():
                bad = None
        whole = merged.drop("entries")
        if bad is not None:
            same = Window.partitionBy("digest", "text")
            split = texts.join(bad, "digest", "left_semi").dropDuplicates(["digest", "run", "slot", "text"]).withColumn("w", self._winner().over(same)).withColumn("total", F.sum("n").over(same))
            split = split.select("digest", "run", "slot", F.col("w.id").alias("win_id"), F.col("w.run").alias("win_run"), F.col("w.slot").alias("win_slot"), "total")
            clean = join_with_hot(entries.join(bad, "digest", "left_anti"), whole, "digest", weights)
            found = clean.unionByName(entries.join(split, ["digest", "run", "slot"]))
        else:
            found = join_with_hot(entries, whole, "digest", weights)
        wins = (F.col("run") == F.col("win_run")) & (F.col("slot") == F.col("win_slot"))
        out = found.select("digest", "win_id", "total", F.when(wins, F.col("at")).otherwise(-1).alias("at"), F.posexplode("ids").alias("pos", "doc_id"))
        return out.select("doc_id", F.col("win_id").alias("keep_id"), F.col("total").alias("group_size"), (F.col("pos") == F.col("at")).alias("kept"), "digest")

    def _texts(self, docs: DataFrame, hits: DataFrame) -> DataFrame:
        """hits with the text of each entry's keep_id; only texts that the filter over (digest, identifier) lets through are shuffled."""

        def numbers(batch: pa.RecordBatch) -> np.ndarray:
            return _pairs(batch.column(0), batch.column(1).to_pylist())

        bits = self.spark.sparkContext.broadcast(filter_of(hits, "keep_id", "digest", values=numbers))
        size = self.digest_bytes

        def through(it):
            for batch in batches(it):
                digests = [digest_of(t, size) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                ok = pa.array(may_hold(bits.value, _pairs(batch.column(0), digests)))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(digests, pa.binary()).filter(ok)], names=["doc_id", "text", "d"])

        # rows that repeat an identifier and a text are one here
        some = id_and_text(docs).mapInArrow(through, "doc_id long, text string, d binary").dropDuplicates(["doc_id", "d", "text"]).alias("x")
        joined = hits.alias("h").join(some, F.col("h.keep_id").eqNullSafe(F.col("x.doc_id")) & (F.col("h.digest") == F.col("x.d")))
        return joined.select("h.*", "x.text")


def exact_groups(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of each row of docs."""
    index = MergeIndex(docs.sparkSession, keep=keep, **options)
    index.flush(docs)
    return index.groups(docs)


def drop_copies(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """docs, all columns whatever their names, without the rows whose text another row keeps. Of rows that repeat identifier and text, one stays."""
    groups = written(exact_groups(docs, keep, **options).where("not kept"), "copies")
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    own, gone_id, gone = (free_name(docs.columns, n) for n in ("__own", "__gone_id", "__gone"))
    left = groups.where(~again).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    # the same join at every size: a broadcast of what goes would end where it grows too large
    kept = docs.withColumn(own, digest).join(left.hint("merge"), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone)), "left_anti")
    if not groups.where(again).isEmpty():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)


def op6_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = exact_groups(docs, keep="largest")
    return groups.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = {
    "op6_lsm_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)"""
}
