"""What the operators share: table reading, the shared folder, written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once a Spark context; they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="factloom-ship-")) / "factloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own only where it is unset, and only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            root = kept.rsplit("/", 1)[0]
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="factloom-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/factloom-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a file or folder that driver and executors share."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else pa.fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}")


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: cuts the lineage so that lost executors cost no recomputation."""
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more. It does so when the JVM collects them, which many small plans alone don't
    bring about: their files, of a block each at least, then pile up as partitions times shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            return


#: What Python workers, which outlive an operator, keep for the next task of the same one.
KEPT: list = []


def release(but=None) -> None:
    """Gives back what other operators keep in this Python worker, all but what `but` keeps; tasks that need the memory begin with it."""
    for kept in KEPT:
        if kept is not but:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # freed memory goes back to the system where the C library can do so
        ctypes.CDLL(None).malloc_trim(0)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id long and text string alone, null text as the empty text; other columns, whatever their names, are left out."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def batches(it: Iterator[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `size` bytes of text, so that a task's memory doesn't follow the length of texts."""
    for batch in it:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as the empty text."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def buffer_and_offsets(column: pa.Array):
    """All texts of a batch as one array of bytes, and where each starts (one entry more than texts)."""
    column = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bits of a filter, at most: 32 MB. Beyond some 20 million values more passes the filter than has to; what passes is joined exactly in any case.
MOST_BITS = 1 << 28


def _positions(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two filter positions of each value."""
    x = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return [((x >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 32)]


def longs(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's first column, null as -1."""
    return batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)


def filter_of(rows: DataFrame, *columns: str, values: Callable[[pa.RecordBatch], np.ndarray] = longs) -> np.ndarray:
    """Bloom filter over what `values` makes of a batch of the columns, a long a row: 12 bits a value or more, MOST_BITS at most. Words are merged by the executors before the driver gets them.

    Values are made where the words are: a step in Python before this one would run beside it, in a second worker for each task, which stays.
    """
    bits = min(MOST_BITS, 1 << max(15, math.ceil(math.log2(12 * max(1, rows.count())))))

    def words(it):
        for batch in it:
            for at in _positions(values(batch), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> 5, pa.int64()), pa.array(1 << (at & 31), pa.int64())], names=["w", "b"])

    found = rows.select(*columns).mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 5, np.uint32)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return out


def may_hold(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values the filter lets through."""
    ok = np.ones(len(values), bool)
    for at in _positions(values, len(words) << 5):
        ok &= (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
    return ok


def free_name(columns: list[str], name: str) -> str:
    """name, or name_1, name_2 and so on where a column has it."""
    taken, n, out = {c.lower() for c in columns}, 0, name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def join_with_hot(rows: DataFrame, found: DataFrame, key: str, weights: DataFrame, share: int = 200) -> DataFrame:
    """rows joined with found, which has one row a key, so that no frequent key meets in one task.

    weights: key, n (how many rows have it). Keys with more than one in `share` of all rows, fewer than `share` therefore, are broadcast with what was found;
    the others are joined by key, as all are where there are fewer than 1000 rows a share.
    """
    all_of = weights.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (all_of.most or 0) * share <= (all_of.n or 0) or all_of.n < 1000 * share:  # few rows are no load for one task
        return rows.join(found, key)
    hot = weights.where(F.col("n") * share > all_of.n).select(key)
    some = F.broadcast(found.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(some, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(found, key))
