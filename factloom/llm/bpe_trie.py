"""Byte-level BPE by a depth-first walk of a trie of distinct words.

BPE has the property that a word's encoding, cut after any token, is the encoding of the part before the cut. So each
prefix has one last token, and a prefix's encoding is that of a shorter prefix and its last token. The walk goes
through the trie of a batch's distinct words (in sorted order, which is its depth-first order; a word keeps the states
of the prefix it shares with the one before), and finds the last token of each new prefix from the states above: the token
that ends there and may follow the last token of what precedes it. Two tokens may follow each other if BPE of both together
would not merge across their border first.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import BARE, Chunked, Generations, chunk_key, chunk_text, tokenizer_path
from .common import KEPT, batches, id_and_text

NEVER = 1 << 60
#: Letters, then nothing but ASCII punctuation: a word of the pattern each.
PLAIN = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
#: Letters below are the same in every version of Unicode.
LATIN = "\u0250"


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(own)))
    return out


class TrieBpe(Chunked):
    """encode(texts) and decode(ids) with a tokenizers file of the byte-level BPE kind."""

    keeps_space = True

    def __init__(self, path: str, limit: int = 800_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model["type"] != "BPE" or odd or model.get("ignore_merges") or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> its two parts and the merge's rank
        for n, pair in enumerate(model["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            x, y = self.ids[a], self.ids[b]
            if self.rank.setdefault((x, y), n) == n:
                self.made.setdefault(self.ids[a + b], (x, y, n))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word borders aren't supported")
        from tokenizers import Tokenizer

        self.cut_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str  # its Unicode tables decide what a letter is
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.follows: dict[int, bool] = {}
        self.tokens: dict[bytes, int] = {}  # those that are the encoding of their own bytes
        self.longest = [1] * 256  # by last byte
        for i, raw_token in sorted(self.bytes_of.items()):
            if i in self.made and self.merged(raw_token) == [i] or len(raw_token) == 1:
                self.tokens[raw_token] = i
                self.longest[raw_token[-1]] = max(self.longest[raw_token[-1]], len(raw_token))
        self.bytes_of.update((i, t.encode()) for t, i in self.added.items())
        self.by_id = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.chunks = Generations(limit)

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that ends it) along a border of the token's merge tree, from the byte up."""
        out, above, x = [], NEVER, token
        while True:
            out.append((x, above))
            if x not in self.made:
                return out[::-1]
            above, x = self.made[x][2], self.made[x][side]

    def _apart(self, a: int, b: int) -> bool:
        """Does BPE leave a and b apart when they stand side by side?"""
        if (left := self.right.get(a)) is None:
            left = self.right[a] = self._border(a, 1)
        if (right := self.left.get(b)) is None:
            right = self.left[b] = self._border(b, 0)
        i = j = 0
        rank = self.rank.get
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = rank((x, y), NEVER)
            # of equal merges the one further left comes first
            if across < x_ends and across <= y_ends and across < NEVER:
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def merged(self, word: bytes) -> list[int]:
        """Encoding by the definition: the merge of lowest rank, leftmost first, until none applies."""
        out = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(out) > 1:
            best = min(((self.rank.get(p, NEVER), i) for i, p in enumerate(zip(out, out[1:]))))
            if best[0] == NEVER:
                break
            i = best[1]
            out[i : i + 2] = [self.ids[self.bytes_of[out[i]] + self.bytes_of[out[i + 1]]]]
        return out

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of distinct words, depth first through their trie."""
        token_of, longest, follows = self.tokens.get, self.longest, self.follows
        last, begins = [-1], [0]  # of each prefix: its last token, and where that begins
        known = follows.get
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], begins[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                first = max(0, end - longest[word[end - 1]])
                likely = max(first, begins[-1])  # one byte more for the last token, or a shorter one; any order finds the only answer
                for start in (*range(likely, end), *range(likely - 1, first - 1, -1)):
                    token = token_of(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        pair = last[start] << 20 | token
                        apart = known(pair)
                        if apart is None:
                            apart = follows[pair] = self._apart(last[start], token)
                        if apart:
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                last.append(token)
                begins.append(start)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end = begins[end]
            yield word, out[::-1]
            before = word

    def _words(self, chunk: str) -> list[str]:
        parts = [chunk] if self.special is None else [p for p in self.special.split(chunk) if p]
        return [w for p in parts for w in ([p] if p in self.added else [p[a:b] for _, (a, b) in self.cut_words(p)])]

    def _learn(self, missing: set) -> None:
        """A chunk's ids are its words'; a word is a chunk of its own, so both are known by the same key."""
        if len(self.follows) > 500_000:
            self.follows.clear()
        known = self.chunks.new
        split = []
        for c in missing:
            m = None if c[:1] == BARE else PLAIN.fullmatch(c.decode())
            if m is not None and (m[1].isascii() or max(m[1]) < LATIN and m[1].isalpha()) and "<|" not in m[2]:  # letters, then nothing but punctuation: two words, as the pattern has it
                split.append((c, [m[1].encode(), BARE + m[2].encode()] if m[2] else [c]))
            else:
                split.append((c, [chunk_key(w) for w in self._words(chunk_text(c))]))
        new = self.chunks.missing({w for _, words in split for w in words})
        for content, i in self.added.items():
            if (key := chunk_key(content)) in new:
                known[key] = i.to_bytes(4, "little")
                new.discard(key)
        text_of = {chunk_text(w).encode(): w for w in new}
        known.update([(text_of[w], np.array(ids, "<u4").tobytes()) for w, ids in self.walk(list(text_of))])
        known.update([(c, b"".join([known[w] for w in words])) for c, words in split if len(words) != 1 or words[0] != c])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def trie_bpe(path: str) -> TrieBpe:
    """One a Python worker."""
    return TrieBpe(path)


KEPT.append(trie_bpe)

def encoded(docs: DataFrame, path: str, make, schema: str) -> DataFrame:
    """make(doc ids, list of ids as little-endian uint32, codec) -> record batch of `schema`, over whole texts in one pass."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(path)
        for batch in batches(it, size=4 << 20):
            yield make(batch.column(0), bpe.encode(batch.column(1).cast(pa.binary()).to_pylist()), bpe)

    return id_and_text(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian uint32) of each row's whole text; null and empty texts have none. Repeated rows and null identifiers stay rows. Empty table: empty result."""
    return encoded(docs, path, lambda doc_id, ids, _: pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], names=["doc_id", "ids"]), "doc_id long, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text of the ids; null ids count as none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(path)
        for batch in batches(it, size=4 << 20, column="ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


NAMES = [str(i) for i in range(1 << 16)]


def op7_trie_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def digests(doc_id: pa.Array, ids: list[bytes], bpe: TrieBpe) -> pa.RecordBatch:
        shown = [sha(",".join(map(NAMES.__getitem__, np.frombuffer(x, "<u4").tolist()))) for x in ids]
        return pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(shown), pa.array([sha(bpe.decode(x)) for x in ids])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, tokenizer_path("byte_bpe_50k.json"), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
