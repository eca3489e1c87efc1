"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each codebook; codebooks are fitted one after another to
residuals, and a beam search picks the codewords. The index stores codes, the approximation's squared norm and the
vector, in parts of a bounded number of bytes. A query makes one table of inner products with all codewords; a vector's approximate score is a sum of table
entries (and the stored norm, for Euclidean nearness). A fixed share of each part, the best by that score, is scored exactly on the
original vectors, and the parts' winners merged, so results don't depend on how many parts there are but for chance.

A search is one plan: rows that name a part and a block of queries, dealt over tasks; a task reads both from the shared folder and holds one of each.

Equal vectors are indexed once, with the few smallest identifiers that could ever be returned, so a vector that a third
of all rows share costs one entry and crowds out nobody.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_with_hot, place, shared_path, ship, written

MANY = 256  # parts whose winners are merged at once, about
AT_ONCE = 128  # queries scored at once


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x codewords x dimensions

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes and approximations of each row: beam search over the residuals."""
        books, size, dim = self.words.shape
        n = len(x)
        rest = x.astype(np.float32)[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for words in self.words:
            width = rest.shape[1]
            flat = rest.reshape(-1, dim)
            cost = ((flat**2).sum(1)[:, None] - 2 * flat @ words.T + (words**2).sum(1)).reshape(n, width * size)
            take = min(beam, width * size)
            best = np.argpartition(cost, take - 1, axis=1)[:, :take]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // size, best % size
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        return codes[:, 0], x.astype(np.float32) - rest[:, 0]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(counts)
        centres[full] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts[full])[:-1]])) / counts[full, None]
        if len(full) < k:
            centres[counts == 0] = x[rng.choice(len(x), int((counts == 0).sum()))]
    return centres


def fit(x: np.ndarray, books: int = 8, size: int = 256, rounds: int = 8, seed: int = 11) -> Codebooks:
    rng, rest = np.random.default_rng(seed), x.astype(np.float32)
    size = max(1, min(size, len(x)))
    words = []
    for _ in range(books):
        words.append(_kmeans(rest, size, rng, rounds))
        rest = rest - words[-1][np.argmin((words[-1] ** 2).sum(1) - 2 * rest @ words[-1].T, axis=1)]
    return Codebooks(np.stack(words))


def valid(v: Column) -> Column:
    """Not null, not empty, every component a finite number, one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def save(folder: str, name: str | None = None, **arrays: np.ndarray) -> str:
    """Writes arrays to a file below folder, a new one if it has no name, and returns where. It is moved into place, so a task that runs again replaces it."""
    file, out = posixpath.join(folder, f"{name or uuid.uuid4().hex}.npz"), io.BytesIO()
    np.savez(out, **arrays)
    system, path = place(file)
    system.create_dir(posixpath.dirname(path), recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as sink:
        sink.write(out.getbuffer())
    system.move(aside, path)
    return file


def load(file: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file, None if there is none."""
    system, path = place(file)
    if not system.get_file_info(path).is_file:
        return None
    with system.open_input_file(path) as source:
        return dict(np.load(io.BytesIO(source.read())))


def _slices(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly `rows` rows, the last one excepted."""
    held, n = [], 0
    for batch in it:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows - n)
            held.append(some)
            n, at = n + some.num_rows, at + some.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def nearest(part: dict[str, np.ndarray], q: np.ndarray, words: np.ndarray, k: int, share: float, euclidean: bool) -> list[list[dict]]:
    """The k best of a part for each query, by exact scores of the share that scores best approximately; an entry an identifier."""
    xs, codes, ids, ends = part["v"], part["codes"], part["ids"], part["ends"]
    n, out = len(xs), []
    take = min(n, max(4 * k, int(np.ceil(share * n))))
    for i in range(0, len(q), AT_ONCE):
        some = q[i : i + AT_ONCE]
        tables = [np.ascontiguousarray((some.astype(np.float32) @ w.T).T) for w in words]  # codewords x queries
        score = tables[0][codes[:, 0]]
        for m in range(1, len(words)):
            score += tables[m][codes[:, m]]
        if euclidean:
            score = 2 * score - part["norm"].astype(np.float32)[:, None]
        for x, approx in zip(some, np.ascontiguousarray(score.T)):
            mine = np.argpartition(-approx, take - 1)[:take] if take < n else np.arange(n)
            exact = -((xs[mine] - x) ** 2).sum(1) if euclidean else (xs[mine] * x).sum(1)
            pairs = [(float(exact[j]), int(v)) for j in top(exact, ids[ends[mine]], k) for v in ids[ends[mine[j]] : ends[mine[j] + 1]]]
            pairs.sort(key=lambda p: (-p[0], p[1]))
            out.append([{"far": -s, "id": v} for s, v in pairs[:k]])
    return out


class AdditiveIndex:
    """Every valid row of vectors (id long, embedding array), indexed by additive quantisation.

    fit_rows: codebooks are fitted to so many rows at most, picked by a hash of the identifier. answers: at most so many
    neighbours are asked for later. part_bytes: vectors of an index part. Rows whose embedding is null, zero, of another length than most, or holds null or non-finite components are
    left out, as are null identifiers. A repeated identifier is a candidate as often as it occurs with different vectors. Empty table: searches find nothing.
    """

    def __init__(
        self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", answers: int = 20, books: int = 8, size: int = 256, fit_rows: int = 16_384, beam: int = 4, part_bytes: int = 32 << 20
    ):
        self.spark, self.answers = vectors.sparkSession, answers
        ship(self.spark)
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & valid(F.col("v")))
        usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.dim = usual.d if usual else 0
        self.rows = rows.where(F.size("v") == self.dim)
        if not usual:
            return
        # the hash picks twice as many rows as are wanted, or all, before any are sorted
        share = min(1.0, 2 * fit_rows / usual["count"])
        few = self.rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(max(1, int(share * (1 << 30))))).dropDuplicates(["id"])
        sample = few.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toArrow()
        if not sample.num_rows:
            sample = self.rows.limit(fit_rows).toArrow()
        self.codebooks = fit(matrix(sample.column("v").combine_chunks(), self.dim), books, size)
        # of equal vectors only the smallest identifiers can be answers; one more, as a query leaves out its own; repeated rows take no places
        first = self.rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= answers + 1)
        distinct = first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        held, folder, dim = self.spark.sparkContext.broadcast(self.codebooks), shared_path(self.spark, "ann-parts"), self.dim
        part_rows = max(AT_ONCE, part_bytes // (8 * dim))
        # as many parts as the bytes ask for, or as there are cores, however many tasks dealt the rows out
        few_parts = max(-(-usual["count"] // part_rows), min(self.spark.sparkContext.defaultParallelism, -(-usual["count"] // 4096)))

        def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _slices(it, part_rows):
                x = matrix(part.column(0), dim)
                made = [held.value.encode(x[i : i + 2048], beam) for i in range(0, len(x), 2048)]
                norms = np.concatenate([(near.astype(np.float64) ** 2).sum(1) for _, near in made])
                lengths = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
                ids = part.column(1).flatten().to_numpy(zero_copy_only=False)
                file = save(folder, v=x, codes=np.concatenate([c for c, _ in made]), norm=norms, ids=ids, ends=np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(x)], pa.int64())], names=["part", "n"])

        self.parts = written(distinct.coalesce(few_parts).mapInArrow(encode, "part string, n long"), "ann-index")

    def search(self, queries: DataFrame, k: int = 20, share: float = 1 / 32, block: int = 512, euclidean: bool = False) -> DataFrame:
        """query_id, rank (from 1), vec_id, score of each query's k best other rows, largest exact score first, ties to smaller ids.

        queries: id, v. The score is the inner product (or minus the squared distance) in double precision. Queries are taken in blocks of at most `block`
        distinct vectors. Of each part of the index the best `share` by approximate scores is scored exactly, 4 (k + 1) vectors at least.
        """
        out = "query_id long, rank int, vec_id long, score double"
        if k > self.answers:
            raise ValueError("the index keeps fewer answers")
        if not self.dim:
            return self.spark.createDataFrame([], out)
        spark, dim, folder = self.spark, self.dim, shared_path(self.spark, "ann-queries")
        words = spark.sparkContext.broadcast(self.codebooks.words)
        asked = queries.withColumn("key", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))

        def write_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((b, key, v) for batch in it for b, key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2), dim)))
            for b, some in groupby(rows, key=lambda r: r[0]):
                some = list(some)
                save(folder, f"block-{b}", q=np.array([v for *_, v in some]), keys=np.array([key for _, key, _ in some]))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(some)], pa.int64())], names=["b", "n"])

        # queries go by their hash into blocks of about `block`
        blocks = max(1, -(-asked.count() // block))
        distinct = asked.groupBy("key").agg(F.first("v").alias("v")).select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("b"), "key", "v")
        made = written(distinct.repartitionById(blocks, F.col("b")).sortWithinPartitions("b").mapInArrow(write_blocks, "b int, n long"), "ann-blocks")
        rows = self.parts.count() * blocks
        if not rows or made.isEmpty():
            return spark.createDataFrame([], out)
        # each part with each block of queries: rows that name two files
        turns = self.parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        dealt = turns.repartition(min(4 * rows, 20_000 + rows), "part", "b").sortWithinPartitions("part")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, part = None, {}
            for batch in it:
                for own, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held = load(posixpath.join(folder, f"block-{b}.npz"))
                    if held is None:  # no query's hash led here
                        continue
                    if own != name:
                        name, part = own, load(own)
                    found = nearest(part, held["q"], words.value, k + 1, share, euclidean)
                    shown = pa.array(found, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([pa.array([own] * len(found)), pa.array(held["keys"].tolist()), shown], names=["part", "key", "found"])

        found = dealt.mapInArrow(run, "part string, key string, found array<struct<far double, id long>>")
        best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found")
        groups = max(1, -(-self.parts.count() // MANY))
        if groups > 1:
            found = found.groupBy("key", F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g")).agg(best)
        merged = written(found.groupBy("key").agg(best), "ann-found")
        members = asked.select("key", F.col("id").alias("query_id"))
        mine = join_with_hot(members, merged, "key", members.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        mine = mine.select("query_id", F.slice(F.expr("filter(found, x -> x.id <> query_id)"), 1, k).alias("found"))
        return mine.select("query_id", F.posexplode("found").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op9_additive_quantisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = AdditiveIndex(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return index.search(index.rows.where("id % 20 = 0"))
