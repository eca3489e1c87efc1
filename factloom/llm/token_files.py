"""Token-ID files with fixed-width bit packing.

A file holds documents in order. Each id takes the bits that the vocabulary needs. Blocks are written as they fill, so a
writer holds a few blocks and the documents' table, however large the file:

    magic "FLTOK1\\0\\0"
    payload        blocks of `block length` ids, each padded to whole bytes
    doc ids        int64 x documents, then a mark of nulls as uint8 x documents
    document ends  int64 x documents      ids up to and with each document
    block offsets  int64 x (blocks + 1)   byte offset of each block in the payload
    footer         little-endian int64: bits, block length, documents, ids, blocks, byte length of the payload; then the magic again

A block is unpacked by numpy without a loop over ids; any range of ids is read by the blocks that hold it.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import encoder, tokenizer_path
from .common import batches, id_and_text, place, release, shared_path, ship, written

MAGIC = b"FLTOK1\0\0"
FOOT = 48 + len(MAGIC)


def bits_for(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenWriter:
    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.offsets, self.pending, self.held, self.n_ids = [0], [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.n_ids += len(ids) // 4
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        self.pending.append(ids)
        self.held += len(ids) // 4
        if self.held >= 16 * self.block:
            self._blocks(self.held - self.held % self.block)

    def _blocks(self, upto: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError("an id doesn't fit into the width")
        for i in range(0, upto, self.block):
            data = pack_bits(ids[i : min(i + self.block, upto)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.pending, self.held = [ids[upto:].tobytes()], len(ids) - upto

    def finish(self) -> None:
        if self.held:
            self._blocks(self.held)
        self.out.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.out.write(np.array(self.ends, "<i8").tobytes())
        self.out.write(np.array(self.offsets, "<i8").tobytes())
        self.out.write(np.array([self.bits, self.block, len(self.doc_ids), self.n_ids, len(self.offsets) - 1, self.offsets[-1]], "<i8").tobytes() + MAGIC)


class TokenFile:
    """Random access to one file's bytes: len(), ids of a document, any range of ids."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.payload = source, len(MAGIC)
        size = source.size()
        source.seek(max(0, size - FOOT))
        foot = source.read(FOOT)
        if len(foot) < FOOT or foot[48:] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, docs, self.n_ids, blocks, payload = (int(x) for x in np.frombuffer(foot, "<i8", 6))
        source.seek(self.payload + payload)
        table = source.read(17 * docs + 8 * (blocks + 1))
        nulls = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(np.frombuffer(table, "<i8", docs), nulls)]
        self.ends = np.frombuffer(table, "<i8", docs, 9 * docs)
        self.offsets = np.frombuffer(table, "<i8", blocks + 1, 17 * docs)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids start..stop of the file; reads the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(self.payload + int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            at = int(self.offsets[b] - self.offsets[first])
            out.append(unpack_bits(data[at : at + int(self.offsets[b + 1] - self.offsets[b])], self.bits, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, ids_at_once: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the file, ids) in order; several documents are unpacked at once."""
        i = 0
        while i < len(self):
            start = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, start + ids_at_once, "right")))
            some = self.ids(start, int(self.ends[j - 1]))
            for k in range(i, j):
                a = int(self.ends[k - 1]) if k else 0
                yield self.doc_ids[k], a, some[a - start : int(self.ends[k]) - start]
            i = j


#: Keys sampled to lay out ranges, about, and ranges whose bounds are taken from them. Both are fixed, so what the driver holds never grows with the rows.
SAMPLE, BOUNDS = 1 << 16, 1 << 10


class Ranges:
    """Ranges of (doc_id, hash of the text), numbered in their order; as many as asked for, about, with about as many rows each.

    bounds: upper keys of coarse ranges. Where more ranges are wanted than bounds, each coarse range is cut into `cuts` by
    interpolation between its bounds, on the identifier or, if that is the same, on the hash.
    """

    def __init__(self, keys: list[tuple[int, int]], parts: int):
        coarse = max(1, min(parts, BOUNDS, len(keys)))
        self.bounds = sorted({keys[len(keys) * i // coarse] for i in range(1, coarse)}) if keys else []
        self.cuts = -(-parts // (len(self.bounds) + 1))
        self.low, self.high = (keys[0], keys[-1]) if keys else ((LOWEST, LOWEST), (LOWEST, LOWEST))

    def __len__(self) -> int:
        return (len(self.bounds) + 1) * self.cuts

    def of(self, doc_id: int | None, h: int) -> int:
        key = (LOWEST if doc_id is None else doc_id, h)
        at = bisect_right(self.bounds, key)
        if self.cuts == 1:
            return at
        low, high = (self.bounds[at - 1] if at else self.low), (self.bounds[at] if at < len(self.bounds) else self.high)
        i = 0 if low[0] != high[0] else 1
        cut = (key[i] - low[i]) * self.cuts // (high[i] - low[i] + 1)
        return at * self.cuts + min(self.cuts - 1, max(0, cut))


def _ranges(rows: DataFrame, total: int, parts: int) -> Ranges:
    """Ranges laid out by a sample of rows (doc_id, h). Identifiers alone are read, unless one fills a range: then the texts' hashes split it."""
    if parts < 2:
        return Ranges([], 1)
    share = min(1.0, SAMPLE / max(total, 1))
    for names in (["doc_id"], ["doc_id", "h"]):
        picked = rows.select(*names).sample(share, 17).collect()  # SAMPLE rows, about
        keys = sorted((LOWEST if r[0] is None else r[0], r[1] if len(names) > 1 else LOWEST) for r in picked)
        if not keys or Counter(keys).most_common(1)[0][1] * min(parts, BOUNDS) < 2 * len(keys):
            break
    return Ranges(keys, parts)


LOWEST = -(1 << 63)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, block: int = 1 << 14, file_ids: int = 128 << 20, part_rows: int = 20_000, cache: int = 400_000) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order to files below folder and returns the manifest: file, documents, n_ids, base.

    Texts are encoded where they are read; what is dealt out, by ranges of (doc_id, a hash of the text), are packed ids. So a repeated
    identifier doesn't land in one task; a null identifier comes first, and rows that repeat one are ordered by that hash. Null and
    empty texts are the end id alone. Each file is written under another name and moved into place, so a task that runs again replaces
    what it wrote. The manifest, a row a file, is a Parquet data set beside them; an empty table makes an empty one. part_rows: documents of a range, about.
    cache: chunks whose ids a Python worker keeps, for a byte-level tokenizer as columns of some 40 bytes each; for others some 200 bytes each, twice at most.
    """
    spark, end = docs.sparkSession, end_id.to_bytes(4, "little")
    rows = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    total = docs.count()
    laid = _ranges(rows, total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_rows)))
    ranges, parts = spark.sparkContext.broadcast(laid), len(laid)

    def tokens(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, cache)
        bits = bits_for(max(codec.vocab_size, end_id + 1))
        for batch in batches(it, size=4 << 20):
            doc_ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ids = codec.encode(batch.column(1).cast(pa.binary()).to_pylist())
            packed = [pack_bits(np.frombuffer(x + end, "<u4"), bits) for x in ids]
            counts = [len(x) // 4 + 1 for x in ids]
            part = list(map(ranges.value.of, doc_ids, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array([bits] * len(part), pa.int32())], names=["part", "doc_id", "h", "n", "packed", "bits"])

    def files(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        fs, base = place(folder)
        writer = aside = None
        part, made = -1, []

        def close():
            writer.finish()
            writer.out.close()
            name = f"tokens-{part:06d}-{len(made):05d}.fltok"
            fs.move(aside, posixpath.join(base, name))
            made.append((part, len(made), name, len(writer.doc_ids), writer.n_ids))

        for batch in batches(it, size=4 << 20, column="packed"):
            columns = [batch.column(i).to_pylist() for i in range(5)]
            if bits := columns[4][0] if len(set(columns[4])) == 1 and columns[4][0] == 16 else 0:  # whole batches at once
                wide = np.frombuffer(b"".join(columns[3]), "<u2").astype("<u4").tobytes()
                ends = np.cumsum([0, *columns[2]]).tolist()
                columns[3] = [wide[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
            for own, doc_id, n, packed, width in zip(*columns):
                if writer is not None and (own != part or writer.n_ids >= file_ids):
                    close()
                    writer = None
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    aside = posixpath.join(base, f".{own:06d}-{uuid.uuid4().hex}")
                    writer, part = TokenWriter(fs.open_output_stream(aside), width, block), own
                writer.add(doc_id, packed if bits else unpack_bits(packed, width, n).astype("<u4").tobytes())
        if writer is not None:
            close()
        if made:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=["part", "turn", "file", "documents", "n_ids"])

    packed = rows.mapInArrow(tokens, "part int, doc_id long, h long, n long, packed binary, bits int")
    dealt = packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "h").select("part", "doc_id", "n", "packed", "bits")
    made = written(dealt.mapInArrow(files, "part long, turn long, file string, documents long, n_ids long"), "token-files").withColumn("group", F.floor(F.col("part") / BOUNDS))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row a thousand ranges
    groups = made.groupBy("group").agg(F.sum("n_ids").alias("held")).select("group", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("group").orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    based = made.withColumn("ahead", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(groups, "group")
    based.select("file", "documents", "n_ids", (F.col("start") + F.col("ahead")).alias("base")).write.mode("overwrite").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, documents, n_ids and base (ids of all files before it) of each file below folder."""
    return spark.read.schema("file string, documents long, n_ids long, base long").parquet(f"{folder}/manifest")


def _as_ids(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"])


def read_tokens(spark: SparkSession, folder: str, make=_as_ids, schema: str = "doc_id long, start long, ids binary") -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian uint32) of each document in the files below folder.

    make, schema: what to make of a list of such rows in the same pass, a record batch of the schema.
    """
    ship(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        fs, base = place(folder)
        for some in it:
            for name, before in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                rows, held = [], 0
                with fs.open_input_file(posixpath.join(base, name)) as source:
                    for doc_id, start, ids in TokenFile(source).documents():
                        rows.append((doc_id, before + start, ids.astype("<u4").tobytes()))
                        held += len(ids)
                        if held >= 1 << 19:
                            yield make(rows)
                            rows, held = [], 0
                if rows:
                    yield make(rows)

    files = manifest(spark, folder).select("file", "base")
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def op8_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("byte_bpe_50k.json"))

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, starts, ids = zip(*rows)
        columns = (doc_ids, starts, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, folder, digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
