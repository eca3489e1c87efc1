"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit, then the binary
digits of the rest, longest first. Each piece is a sequence by itself, in the bucket of its length. No sequence
crosses documents and none is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encoder, tokenizer_path
from .common import batches, id_and_text, release

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"
NAMES = [f.split()[0] for f in PIECES.split(", ")]


def piece_lengths(n: int, longest: int) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, longest: int = 4096, end_id: int = 2, with_ids: bool = True, cache: int = 150_000, size: int = 2 << 20) -> DataFrame:
    """One row a piece: its ids (little-endian uint32) with their CRC-32, and where they stand in the document and in the sequence.

    sequence_id is the task's number in the top bits and a count below, so ids are unique without a shuffle; bucket is log2 of the length.
    Null and empty texts are the end id alone. A null identifier and repeated rows are packed like others. Empty table: no pieces.
    with_ids=False leaves ids null. cache: chunks whose ids a Python worker keeps, some 200 bytes each, twice at most; size: bytes of text that it encodes at once, for which it takes some twelve times as many.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence is a power of two")
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release(but=encoder)
        encode = encoder(path, cache).encode
        sequence = TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches(it, size=size):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).cast(pa.binary()).to_pylist())):
                ids += end
                start, total = 0, len(ids) // 4
                for n in piece_lengths(total, longest):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, part if with_ids else None, zlib.crc32(part), total, sequence, 0, n.bit_length() - 1))
                    start += n
                    sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=NAMES)

    return id_and_text(docs).mapInArrow(run, PIECES)


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False, cache=600_000, size=8 << 20).drop("ids")
