"""Secret scans with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must hold. Each block of
documents gets an inverted index of the trigrams that queries name (postings are sorted positions of documents in the
block); queries intersect and unite postings, and only candidates are verified by the expression itself. A rule whose
query needs no trigram scans every document. The index is split by documents, so it needs no shuffle and its memory is a block's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, buffer_and_offsets, id_and_text, ship
from .patterns import parse


@dataclass(frozen=True)
class Rule:
    """A match counts if `group` has at least `least` characters; others are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @cached_property
    def expression(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.expression.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # the runs of [0-9a-f]+ with 24 characters or more: a run is matched whole, so the shortest length may stand in the expression
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

# Queries: True (anything), a trigram (three lower-case characters), ("and", parts) or ("or", parts).
MOST_STRINGS = 64


def _join(op: str, parts: list):
    """The query that needs all of the parts, or one of them."""
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts:
        return True
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _holds(strings: set[str]):
    """What a text needs that holds one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _analyse(node) -> tuple[set[str] | None, object]:
    """(all strings that a node of a parsed expression matches, lower-cased, or None if they are many; its query)."""
    kind = node[0]
    if kind == "chars":
        chars = None if node[1] is None else {c.lower() for c in node[1]}
        return (chars if chars is not None and len(chars) <= 8 else None), True
    if kind == "alt":
        found = [_analyse(x) for x in node[1]]
        strings = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return strings, _join("or", [q for _, q in found])
    if kind == "rep":
        strings, query = _analyse(node[1])
        low, high = node[2:]
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, _holds(out)
        return None, (query if low else True)
    now, parts, exact = {""}, [], True
    for item in node[1]:
        strings, query = _analyse(item)
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        exact = False
        parts += [_holds(now), query if strings is None else _holds(strings)]
        now = {""} if strings is None else strings
    parts.append(_holds(now))
    return (now if exact else None), _join("and", parts)


def trigram_query(rule: Rule):
    return _analyse(parse(rule.pattern))[1]


def trigrams_of(query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams_of, query[1]))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class TrigramIndex:
    """Postings of the wanted trigrams over a block's documents, ASCII letters lowered."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[str]):
        self.documents = len(offsets) - 1
        low = LOWER[data].astype(np.uint32)
        codes = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) if len(low) > 2 else np.zeros(0, np.uint32)
        hits = np.flatnonzero(_wanted(tuple(wanted))[codes])
        doc = np.searchsorted(offsets, hits, "right") - 1
        inside = hits + 3 <= offsets[doc + 1]
        hits, doc = hits[inside], doc[inside]
        found = codes[hits]
        self.postings = {t: np.unique(doc[found == _code(t)]) for t in wanted}

    def search(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.documents)
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.search(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out


def _code(t: str) -> int:
    return ord(t[0]) << 16 | ord(t[1]) << 8 | ord(t[2])


@cache
def _wanted(trigrams: tuple[str, ...]) -> np.ndarray:
    table = np.zeros(1 << 24, bool)
    table[[_code(t) for t in trigrams]] = True
    return table


def found_spans(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of each text, by start, then kind as the rules are listed."""
    queries = [trigram_query(r) for r in rules]
    index = TrigramIndex(*buffer_and_offsets(column), sorted(set().union(*map(trigrams_of, queries))))
    texts = column.cast(pa.string()).fill_null("").to_pylist()
    out: list[list] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries)):
        for i in index.search(query).tolist():
            out[i] += [(start, order, end) for start, end in rule.spans(texts[i])]
    return [[(rules[order].kind, start, end) for start, order, end in sorted(x)] for x in out]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row's whole text. Null and empty texts have no spans; repeated rows and null identifiers stay rows. Empty table: empty result."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, size=2 << 20):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found_spans(batch.column(1), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def cover(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """text with each stretch of spans that overlap or touch replaced by mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with secrets in the text column replaced by mark; all columns and rows stay, null texts too."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, size=2 << 20, column=text):
            column = batch.column(at)
            found = found_spans(column, rules)
            new = [t if not s else cover(t, s, mark) for t, s in zip(column.to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, column.type) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
