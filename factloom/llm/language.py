"""Language identification by multilingual mixture inference.

Each language has a distribution of hashed byte trigrams, counted over all training texts. A document is a mixture of
languages: expectation-maximisation estimates their shares from its trigrams' likelihoods, and a penalised likelihood
picks how many languages the document has. The largest share names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, buffer_and_offsets, id_and_text, ship

BITS = 15
BUCKETS = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.full(256, 32, np.uint32)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram: ASCII letters lowered, other ASCII as space; trigrams of spaces are left out."""
    c = FOLD[data]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    code = c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([SPACE, data, SPACE])


SPACE = np.array([32], np.uint8)


def in_fold(doc_id: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # languages x BUCKETS


def learn(docs: DataFrame, lang: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """Counts trigrams of every row with a language and a text, repeated rows each time. The driver gets one count a language and bucket, whatever the corpus."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches(it, size=2 << 20):
            data, offsets = buffer_and_offsets(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name] += np.bincount(grams(padded(data[offsets[i] : offsets[i + 1]])), minlength=BUCKETS)
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    found = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.full((len(names), BUCKETS), smooth)
    if names:
        row = {n: i for i, n in enumerate(names)}
        np.add.at(counts, ([row[n] for n in found.column("lang").to_pylist()], found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return LanguageModel(tuple(names), counts / counts.sum(1, keepdims=True))


def mixtures(gram: np.ndarray, count: np.ndarray, lengths: np.ndarray, likelihood: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Shares (documents x languages) of the selected languages; documents must have grams.

    gram, count: distinct buckets of each document and how often they occur, one document after another; lengths: entries a document.
    Of the languages as EM over all of them ranks them, the first 1, 2 and so on are fitted again until the penalised likelihood no longer rises; each one more costs
    half the logarithm of the document's grams, and 2.
    """
    docs, k = len(lengths), len(likelihood)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    p = likelihood[:, gram].T
    n = np.add.reduceat(count, starts)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = np.repeat(share, lengths, axis=0)
            r *= p
            r *= (count / r.sum(1))[:, None]
            share = np.add.reduceat(r, starts, axis=0) / n[:, None]
        r = np.repeat(share, lengths, axis=0)
        r *= p
        return share, np.add.reduceat(count * np.log(r.sum(1)), starts)

    share, _ = em(np.full((docs, k), 1 / k), rounds)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, value, rises = None, None, np.ones(docs, bool)
    for m in range(1, k + 1):
        chosen = np.where(rank < m, np.maximum(share, 1e-3), 0.0)
        fitted, likely = em(chosen / chosen.sum(1, keepdims=True), 0 if m == 1 else rounds // 2)
        likely = likely - 0.5 * (m - 1) * np.log(n) - 2.0 * (m - 1)
        if best is None:
            best, value = fitted, likely
            continue
        rises &= likely > value  # a document that stopped stays, whatever others in its batch do
        if not rises.any():
            break
        best, value = np.where(rises[:, None], fitted, best), np.where(rises, likely, value)
    return best


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and languages (lang, share; largest first) of each row's whole text.

    Null texts and texts without a letter, and all texts if no language was learned, are `und` with score 0 and no languages. Ties go to the first name.
    Repeated rows and null identifiers are rows like others; other columns of docs don't matter. Empty table: empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    share_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, likelihood = held.value.languages, held.value.likelihood
        for batch in batches(it, rows=500, size=1 << 20):
            data, offsets = buffer_and_offsets(batch.column(1))
            found, counts, who = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if names and has_letter(text):
                    c = np.bincount(grams(padded(data[offsets[i] : offsets[i + 1]])), minlength=BUCKETS)
                    at = np.flatnonzero(c)
                    found.append(at)
                    counts.append(c[at].astype(float))
                    who.append(i)
            n = batch.num_rows
            pred, score, langs = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if who:
                shares = mixtures(np.concatenate(found), np.concatenate(counts), np.array(list(map(len, found))), likelihood)
                for i, s in zip(who, shares):
                    order = np.argsort(-s, kind="stable")
                    langs[i] = [{"lang": names[j], "share": float(s[j])} for j in order if s[j] > 0]
                    pred[i], score[i] = names[order[0]], min(1.0, float(s[order[0]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array(langs, share_type)], names=["doc_id", "lang_pred", "score", "languages"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang string, share double>>")


def op5_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(in_fold() != 2))
    return identify(docs, model).select("doc_id", (in_fold() == 2).alias("held_out"), "lang_pred", "score")
