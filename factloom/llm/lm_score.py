"""Stupid-backoff scores of documents under n-gram counts of the corpus itself.

Counting and look-up are one relational round trip, in columns of packed numbers rather than a row an n-gram, which for orders 1 to 3 would
take eight times the input:

    blocks     documents are packed into blocks of a few MB of text, kept in side files of the shared folder
    requests   each block lists its distinct n-grams as sorted hashes with counts, cut by the hash's top bits
    tables     the requests of one hash range meet in one task, are summed into that range's count table, and every request is
               answered by the totals in the order it asked
    scores     the answers join their block, whose n-grams are exploded again, and sum up per document

An n-gram reaches a count table once a block, however frequent it is, so no key is hot; answers carry no keys at all.

    S(w | c) = count(c w) / count(c)           if count(c w) >= least
             = backoff * S(w | c without its first word)   otherwise
    S(w)     = count(w) / words of the corpus

Words are those that ASCII white space separates, ASCII letters lowered; n-grams don't cross documents. Hashes are as wide as gives a
look-up a chance of 2^-MARGIN to meet another n-gram, at every size of the corpus, and 64 bits at most.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, id_and_text, place, shared_path, written

BODY = "block long, docs long, raw_size long, words long, held binary"
REQUEST = "p int, block long, k int, n long, hashes binary, counts binary"
ANSWER = "block long, k int, p int, totals binary"
MARGIN = 28


@cache
def _codec(level: int) -> pa.Codec:
    return pa.Codec("zstd", compression_level=level)


class Block:
    """Where a block's text lies, and its documents' identifiers and lengths in bytes; as one binary value for rows."""

    def __init__(self, file: str, at: int, size: int, raw_size: int, ids: list[int | None], sizes: list[int]):
        self.file, self.at, self.size, self.raw_size, self.ids, self.sizes = file, at, size, raw_size, ids, sizes

    def encode(self) -> bytes:
        head = json.dumps([self.file, self.at, self.size, self.raw_size, len(self.ids), [i for i, x in enumerate(self.ids) if x is None]]).encode()
        numbers = np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes()
        return len(head).to_bytes(4, "little") + head + numbers

    @staticmethod
    def decode(data: bytes) -> Block:
        n = int.from_bytes(data[:4], "little")
        file, at, size, raw_size, docs, nulls = json.loads(data[4 : 4 + n])
        ids = np.frombuffer(data, "<i8", docs, 4 + n).tolist()
        for i in nulls:
            ids[i] = None
        return Block(file, at, size, raw_size, ids, np.frombuffer(data, "<i8", docs, 4 + n + 8 * docs).tolist())

    def read(self) -> bytes:
        if not self.raw_size:
            return b""
        system, path = place(self.file)
        with system.open_input_file(path) as source:
            source.seek(self.at)
            return _codec(6).decompress(source.read(self.size), self.raw_size, asbytes=True)


def bodies(docs: DataFrame, folder: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Documents packed into blocks of about block_bytes of text; texts go to a file a task below folder."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        file, out, at = posixpath.join(folder, f"texts-{uuid.uuid4().hex}"), None, 0

        def row():
            nonlocal out, at
            raw = b"".join(texts)
            data = _codec(6).compress(raw, asbytes=True) if raw else b""
            if data and out is None:
                system, path = place(file)
                system.create_dir(posixpath.dirname(path), recursive=True)
                out = system.open_output_stream(path)
            if data:
                out.write(data)
            block = Block(file, at, len(data), len(raw), ids, list(map(len, texts)))
            at += len(data)
            columns = ([number], [len(ids)], [len(raw)], [sum(len(t.split()) for t in texts)], [block.encode()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()])], names=[f.split()[0] for f in BODY.split(", ")])

        for batch in batches(it):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
                if held >= block_bytes:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()
        if out is not None:
            out.close()

    return id_and_text(docs).mapInArrow(run, BODY)


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class BlockGrams:
    """The n-grams of a block: for each order k the sorted distinct hashes of so many bits, their counts, and which of them ends at each word."""

    def __init__(self, sizes: list[int], raw: bytes, order: int, bits: int = 64):
        raw = raw.lower()
        words: list[bytes] = []
        lengths, at = [], 0
        for n in sizes:
            some = raw[at : at + n].split()
            words += some
            lengths.append(len(some))
            at += n
        self.lengths = np.array(lengths, np.int64)
        self.document = np.repeat(np.arange(len(sizes)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(words)) - starts[self.document] if words else np.zeros(0, np.int64)
        number = {w: i for i, w in enumerate(set(words))}
        h = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
        del words, number, raw
        self.hashes, self.counts, self.ends_at, self.which = [], [], [], []
        gram = h
        for k in range(1, order + 1):
            if k > 1:
                gram = _mix(gram[:-1], h[k - 1 :], k)
            ends = np.flatnonzero(self.place >= k - 1)
            found, which, counts = np.unique(gram[ends - (k - 1)] >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            self.hashes.append(found)
            self.counts.append(counts)
            self.ends_at.append(ends)
            self.which.append(which.astype(np.uint32))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers byte plane by byte plane, so that compression finds what planes have in common."""
    return _codec(1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True)


def _from_planes(data: bytes, width: int, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(_codec(1).decompress(data, width * n, asbytes=True), np.uint8).reshape(width, n).T
    return wide.view("<u8").reshape(-1)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers of up to 64 bits, in as many bytes as the largest needs; the first byte says how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + len(x).to_bytes(8, "little") + _planes(x, width)


def unpack_numbers(data: bytes) -> np.ndarray:
    return _from_planes(data[9:], data[0], int.from_bytes(data[1:9], "little"))


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return pack_numbers(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), named)], names=[n for n, _ in named])


def requests(blocks: DataFrame, order: int, bits: int, top_bits: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for number, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block.decode(held)
                grams = BlockGrams(block.sizes, block.read(), order, bits)
                for k, (hashes, counts) in enumerate(zip(grams.hashes, grams.counts), 1):
                    edges = np.searchsorted(hashes, np.arange(1, 1 << top_bits, dtype=np.uint64) << np.uint64(bits - top_bits))
                    cuts = [(p, i, j) for p, (i, j) in enumerate(zip([0, *edges], [*edges, len(hashes)])) if i < j]
                    if cuts:
                        yield _rows([(p, number, k, j - i, pack_sorted(hashes[i:j]), pack_numbers(counts[i:j])) for p, i, j in cuts], REQUEST)

    return blocks.select("block", "held").mapInArrow(run, REQUEST)


def count_range(asked: list[tuple[int, bytes, bytes]]) -> list[bytes]:
    """The answers to requests (block, hashes, counts) of one hash range and order: the totals of the range's count table, as wide as they are."""
    lists = [unpack_sorted(hashes) for _, hashes, _ in asked]
    _, which = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.zeros(int(which.max()) + 1, np.uint64)
    np.add.at(totals, which, np.concatenate([unpack_numbers(counts) for *_, counts in asked]))
    cuts = np.cumsum([0, *map(len, lists)])
    return [pack_numbers(totals[which[i:j]]) for i, j in zip(cuts, cuts[1:])]


def _rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _answers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, k, block, hashes, counts) sorted by p and k to answers."""
    for (p, k), rows in groupby(_rows_of(it), key=lambda r: r[:2]):
        asked = [r[2:] for r in rows]
        yield _rows([(block, k, p, totals) for (block, *_), totals in zip(asked, count_range(asked))], ANSWER)


def score_block(grams: BlockGrams, totals: list[np.ndarray], words: int, least: int, backoff: float) -> np.ndarray:
    """Sum of log scores of each document of a block. totals: those of each order's distinct n-grams, in their order."""
    n = len(grams.document)
    if not n:
        return np.zeros(len(grams.lengths))
    seen = totals[0][grams.which[0]].astype(float)  # count of the (k-1)-gram that ends at each word
    logs = np.log(seen / max(words, 1))
    for k in range(2, len(totals) + 1):
        ends = grams.ends_at[k - 1]
        count = totals[k - 1][grams.which[k - 1]].astype(float) if len(ends) else np.zeros(0)
        known = count >= least
        logs[ends] = np.where(known, np.log(np.maximum(count, 1) / np.maximum(seen[ends - 1], 1)), np.log(backoff) + logs[ends])
        seen = np.zeros(n)
        seen[ends] = count
    return np.bincount(grams.document, logs, len(grams.lengths))


def backoff_scores(docs: DataFrame, order: int = 3, least: int = 2, backoff: float = 0.4, block_bytes: int = 8 << 20, range_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms), mean_log_score (a word's) of each row under the counts of all rows.

    range_bytes: text whose n-grams one hash range, and so one task, gets. Null and empty texts have no words and score 0. Repeated rows count and are scored
    each time; null identifiers stay rows. Empty table: empty result.
    """
    spark = docs.sparkSession
    blocks = written(bodies(docs, shared_path(spark, "lm-texts"), block_bytes), "lm-blocks")
    whole = blocks.agg(F.sum("raw_size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")).first()
    words, top_bits = whole.words or 0, max(4, ((whole.size or 0) // range_bytes).bit_length())
    bits = min(64, (words * order + 1).bit_length() + MARGIN)
    spread = blocks.repartition(max(1, -(-whole.n // 2)))  # rows of a few KB that stand for MB: files alone would deal them to a few tasks
    dealt = requests(spread, order, bits, top_bits).repartitionById(1 << top_bits, F.col("p")).sortWithinPartitions("p", "k").select("p", "k", "block", "hashes", "counts")
    answered = dealt.mapInArrow(_answers, ANSWER).unionByName(blocks.select("block", F.lit(0).alias("k"), F.lit(0).alias("p"), F.col("held").alias("totals")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.n // 4))
    met = answered.repartition(tasks, "block").sortWithinPartitions("block", "k", "p").select("block", "k", "totals")
    schema = "doc_id long, n_tokens long, log_score double, mean_log_score double"

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows_of(it), key=lambda r: r[0]):
            block, parts = None, [[] for _ in range(order)]
            for _, k, data in rows:  # k = 0, the block itself, comes first; then each order by rising ranges
                if k:
                    parts[k - 1].append(unpack_numbers(data))
                else:
                    block = Block.decode(data)
            grams = BlockGrams(block.sizes, block.read(), order, bits)
            logs = score_block(grams, [np.concatenate(p) if p else np.zeros(0) for p in parts], words, least, backoff)
            columns = [pa.array(block.ids, pa.int64()), pa.array(grams.lengths), pa.array(logs), pa.array(logs / np.maximum(grams.lengths, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "log_score", "mean_log_score"])

    return met.mapInArrow(score, schema)


def op3_stupid_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", F.round("mean_log_score", 6).alias("mean_log_score"), F.round("log_score", 4).alias("log_score"), "n_tokens")


SQL = {
    "op3_stupid_backoff_score": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
                   FROM documents),
             t AS (SELECT r, unnest(ws) AS w, unnest([NULL] || ws[:-2]) AS v, unnest(list_slice([NULL, NULL] || ws[:-3], 1, len(ws))) AS u FROM d WHERE len(ws) > 0),
             c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
             c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
             c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
             n AS (SELECT sum(c) AS n FROM c1),
             s AS (SELECT t.r, CASE WHEN t.u IS NOT NULL AND e.c >= 2 THEN ln(e.c / y.c)
                                    ELSE CASE WHEN t.u IS NOT NULL THEN ln(0.4) ELSE 0 END
                                       + CASE WHEN t.v IS NOT NULL AND b.c >= 2 THEN ln(b.c / x.c)
                                              ELSE CASE WHEN t.v IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(a.c / n.n) END END AS l
                   FROM t JOIN c1 a ON a.w = t.w CROSS JOIN n
                   LEFT JOIN c2 b ON b.v = t.v AND b.w = t.w
                   LEFT JOIN c1 x ON x.w = t.v
                   LEFT JOIN c3 e ON e.u = t.u AND e.v = t.v AND e.w = t.w
                   LEFT JOIN c2 y ON y.v = t.u AND y.w = t.v),
             g AS (SELECT r, count(*) AS k, sum(l) AS l FROM s GROUP BY r)
        SELECT d.doc_id, coalesce(g.k, 0) AS n_tokens, round(coalesce(g.l, 0), 4) AS log_score, round(coalesce(g.l / g.k, 0), 6) AS mean_log_score
        FROM d LEFT JOIN g ON g.r = d.r"""
}
