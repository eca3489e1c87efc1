"""Quality classifier: a sparse rule ensemble.

Statistics of whole texts are split by small boosted trees. Every path from a root to a node is a rule, a conjunction of
comparisons. A logistic model with an L1 penalty weights the rules and drops most. What remains is compiled into one Spark
column over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, buffer_and_offsets, free_name, release, ship

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?", "bang": b"!", "mark": b"#$%&*@^~+=<>", "bar": b"|/\\_{}[]", "line": b"\n",
}
STATISTICS = ["words", "word_length", *(f"{c}_share" for c in CLASSES), "distinct_words", "repeats", "commonest", "distinct_lines", "marked_words"]
HELD = "__quality"


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS a text; an empty text has zeros."""
    data, offsets = buffer_and_offsets(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.diff(offsets).astype(float)
    full = np.flatnonzero(size)
    if len(full):
        starts = offsets[:-1][full]
        for j, chars in enumerate(CLASSES.values()):
            table = np.zeros(256, np.int32)
            table[np.frombuffer(chars, np.uint8)] = 1
            out[full, 2 + j] = np.add.reduceat(table[data], starts) / size[full]
    at = 2 + len(CLASSES)
    for i, text in enumerate(column.cast(pa.binary()).fill_null(b"").to_pylist()):
        words = text.split()
        if not words:
            continue
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        k = len(words)
        lines = text.split(b"\n")
        out[i, 0] = np.log1p(k)
        out[i, 1] = size[i] / k
        out[i, at] = len(counts) / k
        out[i, at + 1] = sum(map(eq, words, words[1:])) / k
        out[i, at + 2] = max(counts.values()) / k
        out[i, at + 3] = len(set(lines)) / len(lines)
        out[i, at + 4] = sum(c for w, c in counts.items() if w[-1] in b"!#$%&*@^~+=<>|") / k
    return out


def with_statistics(docs: DataFrame, text: str = "text", held_as: str = HELD) -> DataFrame:
    """docs with a struct of the text's statistics in the column held_as; every other column stays as it is."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    kind = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches(it, size=2 << 20, column=text):
            made = statistics(batch.column(at))
            fields = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(made.T)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, fields], names=[*batch.schema.names, held_as])

    held = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(held_as, held)]))


@dataclass(frozen=True)
class Rule:
    """Holds where each (statistic, above, threshold) holds: value > threshold if above, else value <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def on(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) == above
        return out

    def column(self, held: str = HELD) -> Column:
        out = F.lit(True)
        for j, above, t in self.terms:
            value = F.col(f"{held}.{STATISTICS[j]}")
            out = out & ((value > t) if above else (value <= t))
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[float, ...]
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, r in zip(self.weights, self.rules):
            z += w * r.on(x)
        return 1 / (1 + np.exp(-z))

    def column(self, held: str = HELD) -> Column:
        z = F.lit(self.bias)
        for w, r in zip(self.weights, self.rules):
            z = z + F.when(r.column(held), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree of one boosting step: its paths, and its values on x."""
    rules: list[Rule] = []
    value = np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple, left: int) -> None:
        if terms:
            rules.append(Rule(tuple(sorted(terms))))
        value[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        if not left or len(rows) < 2 * least:
            return
        whole, best = g[rows].sum() ** 2 / (h[rows].sum() + 1), (1e-6, 0, 0.0)
        for j in columns:
            b = np.searchsorted(cuts[j], x[rows, j], "left")  # 0..len(cuts): value <= cuts[b]
            k = len(cuts[j]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
            if not len(gs):
                continue
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float(cuts[j][i]))
        if best[0] > 1e-6:
            above = x[rows, best[1]] > best[2]
            grow(rows[~above], (*terms, (int(best[1]), False, best[2])), left - 1)
            grow(rows[above], (*terms, (int(best[1]), True, best[2])), left - 1)

    grow(np.arange(len(x)), (), depth)
    return rules, value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 1e-3, rounds: int = 400, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weights by lasso logistic regression (accelerated proximal gradient)."""
    y = y.astype(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return RuleModel(bias, (), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 66)[1:-1])) for c in x.T]
    z = np.full(len(y), bias)
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rules, value = _tree(x, cuts, p - y, p * (1 - p), rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), False), depth, max(5, len(y) // 500))
        z += 0.4 * value
        found.update(dict.fromkeys(rules))
    columns: dict[bytes, Rule] = {}
    for r in found:
        on = r.on(x)
        if 0 < on.sum() < len(on):
            columns.setdefault(np.packbits(on).tobytes(), r)
    rules = list(columns.values())
    if not rules:
        return RuleModel(bias, (), ())
    a = np.stack([r.on(x) for r in rules], 1).astype(np.float32)
    mean = a.mean(0)
    a -= mean
    step = 4 / np.linalg.norm(a.T @ a / len(y), 2)
    w, last, t, b = np.zeros(len(rules)), np.zeros(len(rules)), 1.0, bias
    for _ in range(rounds):
        u = 1 + (t - 1) / (t + 2)
        v = last + (w - last) * u
        p = 1 / (1 + np.exp(-(a @ v.astype(np.float32) + b)))
        grad = a.T @ (p - y).astype(np.float32) / len(y)
        last, t = w, t + 1
        w = v - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= 4 * float((p - y).mean())
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - mean @ w), tuple(float(w[i]) for i in kept), tuple(rules[i] for i in kept))


def in_fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the identifier as text, modulo folds; null identifiers count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 12_000) -> RuleModel:
    """A model of `target`, learned from at most max_rows labelled rows outside the held-out fold, picked by a hash of the identifier.

    Of rows that repeat an identifier the one whose text has the smallest hash counts. Labels other than 0 and 1, and null identifiers, are left out. No labelled rows: a model
    without rules.
    """
    picked = labels.where((in_fold() != 0) & F.col(target).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__y").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("__d"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("__d") == F.col("__id"))
    rows = with_statistics(texts).select("__y", F.array(*(F.col(f"{HELD}.{s}") for s in STATISTICS)).alias("x"), "__d", F.xxhash64("text").alias("h"))
    rows = rows.groupBy("__d", "__y").agg(F.min(F.struct("h", "x")).alias("first")).select("__d", "__y", "first.x").toArrow()  # a row a label picked, at most
    if not rows.num_rows:
        return RuleModel(0.0, (), ())
    order = np.lexsort((rows.column("__y").to_numpy(), rows.column("__d").to_numpy()))
    x = np.array(rows.column("x").to_pylist(), float)[order]
    return fit(x, rows.column("__y").to_numpy()[order])


def score(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """docs with the score (0 to 1, higher for label 1) of each row's whole text.

    Empty and null texts have zero statistics and a score like others; repeated rows and null identifiers are rows like others. A column of docs that is called `name` stays, and the score
    is then name_1, or the next free one. Empty table: empty result.
    """
    held = free_name(docs.columns, HELD)
    return with_statistics(docs, held_as=held).withColumn(free_name(docs.columns, name), model.column(held)).drop(held)


def keep_good(docs: DataFrame, model: RuleModel, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more, with docs' columns."""
    held = free_name(docs.columns, HELD)
    return with_statistics(docs, held_as=held).where(model.column(held) >= least).drop(held)


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (in_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
