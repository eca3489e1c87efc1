"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, fewer than three pieces would need: if two fingerprints differ in at most two
bits, one half differs in at most one. So each distinct fingerprint is indexed under variants of a half with one wildcard
bit, or none, together with a piece of the other half that must then be equal:

    no wildcard: a half as it is, and each third of the other half (which differs in two bits at most)     2 x 3 variants
    one wildcard: the upper half without bit p, and each half of the lower one (one bit at most)            32 x 2 variants

Equal variants are joined and verified by the Hamming distance. A key has at least 42 bits, so buckets stay small
however many documents there are, and only distinct fingerprints enter: exact groups never meet as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, free_name, id_and_text, join_with_hot, written
from .components import components

VARIANTS = 70
CHUNK = 255  # rows whose bits a byte can count


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """ASCII letters lowered, words split at ASCII white space; of fewer words than a shingle, the sequence itself; of none, 0."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    hash_of = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter((hash_of(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, digests: bool = False) -> DataFrame:
    """doc_id and fp (long) of each row, with digests its text's SHA-256 in hexadecimal too; null text counts as empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            columns = [batch.column(0), pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]
            if digests:
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "digest"][: len(columns)])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long" + ", digest string" * digests)


def variants(fps: DataFrame) -> DataFrame:
    """fp and key of each variant: the variant's number in the top 7 bits, at most 47 bits of the fingerprint below."""
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v")).select(
        "fp",
        F.expr("""
            (cast(v as bigint) << 57) | case
              when v < 3 then ((fp >>> 32) << 11) | ((fp >>> (11 * v)) & case when v = 2 then 1023 else 2047 end)
              when v < 6 then ((fp & 4294967295) << 11) | ((fp >>> (32 + 11 * (v - 3))) & case when v = 5 then 1023 else 2047 end)
              else (((fp >>> 32) & ~(1L << ((v - 6) div 2))) << 16) | ((fp >>> (16 * ((v - 6) % 2))) & 65535)
            end""").alias("key"),
    )


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """(a, b) for distinct fingerprints a < b that differ in at most `most` (up to 2) bits; each link once."""
    if not 0 <= most <= 2:
        raise ValueError("two halves with one wildcard cover up to two bits")
    keys = variants(fps)
    x, y = keys.select("key", F.col("fp").alias("a")), keys.select("key", F.col("fp").alias("b"))
    # Spark takes the variants for as few bytes as the fingerprints have, and would broadcast them by way of the driver
    return x.hint("merge").join(y.hint("merge"), "key").where(F.expr(f"a < b and bit_count(a ^ b) <= {int(most)}")).select("a", "b").distinct()


def rooted(marked: DataFrame, most: int = 2) -> DataFrame:
    """fp, n (its rows), least (its smallest identifier) and root (the same for all of a component) of each distinct fingerprint of marked (doc_id, fp)."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), most))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest identifier reachable) of each row of docs.

    Empty and null texts have fingerprint 0 and link like any other. A null identifier never names a component unless it has no other.
    Repeated rows are members like others. Empty table: empty result.
    """
    marked = written(fingerprints(docs, words), "fingerprints")
    found = written(rooted(marked, most), "rooted")
    names = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(found.join(names, "root").select("fp", "n", "component_id"), "components")
    return join_with_hot(marked, named.select("fp", "component_id"), "fp", named.select("fp", "n")).select("doc_id", "fp", "component_id")


def drop_but_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest identifier (null last), then of the smallest digest.

    groups: doc_id, digest (hexadecimal SHA-256 of the text, null as the empty one) and root of each row of docs. Rows go by identifier and text, so
    that an identifier that other texts share takes none of them along.
    """
    rows = written(groups.groupBy("doc_id", "digest", "root").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    gone = rows.join(first, "root").where("not (doc_id <=> first.doc_id and digest = first.digest)")
    own, gone_id, gone_digest = (free_name(docs.columns, n) for n in ("__own", "__gone_id", "__gone"))
    gone = written(gone.select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)), "near-copies")
    marked = docs.withColumn(own, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    kept = marked.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_digest)), "left_anti")
    if not rows.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", own])
    return kept.drop(own)


def drop_near_copies(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest identifier."""
    marked = written(fingerprints(docs, words, digests=True), "fingerprints")
    return drop_but_one(docs, marked.join(rooted(marked, most), "fp"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
