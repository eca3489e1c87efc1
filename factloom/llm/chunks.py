"""Exact encoding by the tokenizers library with each distinct chunk encoded once.

No token of the two supported tokenizer families spans a change from other characters to white space, so a text's ids are
its chunks' ids in order. Chunks repeat; a cache keeps the frequent ones and bounds memory: columns for chunks that keep their
spaces, else a dict of two generations.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT

#: The characters that \\s stands for in the tokenizers' patterns.
WHITE = "\t-\r \x85\xa0  -     　"
SPACED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BULK = 100


class Generations:
    """A dict of at most about two times `limit` entries; entries used since the last turn survive a turn."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that aren't known; the others are in `new` afterwards, until the next turn."""
        return self._promoted(keys.difference(self.new))

    def _promoted(self, keys: set) -> set:
        """Keys that aren't in `new`, without those that `old` has, which move."""
        if self.old:
            old = self.old
            known = [k for k in keys if k in old]
            self.new.update([(k, old[k]) for k in known])
            keys = keys.difference(known)
        return keys

    def values(self, keys: list[bytes], learn) -> list[bytes]:
        """The value of each key; learn(keys) puts those of unknown ones into `new`."""
        found = list(map(self.new.get, keys))
        unknown = {k for k, v in zip(keys, found) if v is None}
        if unknown:
            self.turn(len(unknown))
            if missing := self._promoted(unknown):
                learn(missing)
            known = self.new
            found = [known[k] if v is None else v for k, v in zip(keys, found)]
        return found

    def turn(self, more: int) -> None:
        """Makes room for so many entries; only here entries go."""
        if len(self.new) + more > self.limit:
            self.old, self.new = self.new, {}


#: Stands before a chunk that no space precedes; no UTF-8 text holds this byte.
BARE = b"\xff"


def cut_slowly(raw: bytes) -> list[bytes]:
    """A text's chunks, each with the space before it left out (BARE stands there if there is none)."""
    return [chunk_key(c) for c in SPACED.findall(raw.decode())]


def spaced_evenly(raw: bytes) -> bool:
    """Do single spaces stand between other characters? Then they are the cuts."""
    if raw[:1] == b" " or raw[-1:] == b" " or b"  " in raw or b"\n " in raw or b"\t " in raw or b"\r " in raw or b"\x0b " in raw or b"\x0c " in raw:
        return False
    return raw.isascii() or not any(w in raw for w in _WIDER)


#: ASCII punctuation but for what opens an added token.
PUNCTUATION = b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{}~"


def word_of(chunk: bytes) -> bytes:
    """The chunk without the punctuation that ends it, if a letter that nothing changes stands before; no pattern joins the two."""
    word = chunk.rstrip(PUNCTUATION)
    if word[-1:].isalpha() or word[-2:-1] == b"\xc3" and word[-1:] not in (b"\x97", b"\xb7"):
        return word
    return chunk


#: First bytes of the white space beyond ASCII (U+0085 and U+00A0, U+1680, U+2000 to U+205F, U+3000).
_WIDER = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")


def chunk_text(chunk: bytes) -> str:
    return chunk[1:].decode() if chunk[:1] == BARE else " " + chunk.decode()


def chunk_key(text: str) -> bytes:
    """The inverse of chunk_text."""
    return text[1:].encode() if len(text) > 1 and text[0] == " " else BARE + text.encode()


class Chunked:
    """Encodes whole texts by their chunks, of which each distinct one is looked up once a batch.

    keeps_space: chunks are cut at single spaces and tokens keep them (byte-level); else ASCII white space is dropped. A
    subclass learns the ids of unknown chunks.
    """

    keeps_space: bool
    chunks: Generations

    def _learn(self, missing: set) -> None:
        raise NotImplementedError

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text as little-endian uint32."""
        if self.keeps_space:
            even = [i for i, t in enumerate(texts) if t and spaced_evenly(t)]
            lists = pc.split_pattern(pa.array([BARE + texts[i] for i in even], pa.binary()), b" ")
        else:
            even = [i for i, t in enumerate(texts) if t]
            lists = pc.ascii_split_whitespace(pa.array([texts[i] for i in even], pa.binary()).cast(pa.string()))
        out = [b""] * len(texts)
        if len(even) < len(texts):
            for i in set(range(len(texts))).difference(even):
                if texts[i]:
                    out[i] = b"".join(self.chunks.values(cut_slowly(texts[i]), self._learn))
        if not even:
            return out
        coded = lists.flatten().dictionary_encode()
        values = self.chunks.values(coded.dictionary.cast(pa.binary()).to_pylist(), self._learn)
        pool, which = np.frombuffer(b"".join(values), "<u4"), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        each = sizes[which]
        ends = np.cumsum(each, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        raw = pool[np.repeat(begins[which] - ends + each, each) + np.arange(total, dtype=np.int32)].tobytes()
        cuts = (4 * np.concatenate([[0], ends]).astype(np.int64)[lists.offsets.to_numpy()]).tolist()
        for i, a, b in zip(even, cuts, cuts[1:]):
            out[i] = raw[a:b]
        return out


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of spans, one span behind the other."""
    ends = np.cumsum(sizes, dtype=begins.dtype)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=begins.dtype)


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that a binary array's buffer holds, and where in them each entry starts (one entry more than the array)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def as_text(column: pa.Array) -> pa.Array:
    """The same bytes as strings, unchecked."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)


class Columns:
    """Keys and their ids as columns, `limit` keys at most: without an object a key, a look-up of many keys at once costs a tenth of a dict's. When full, the half that most batches used stays."""

    LONGEST = 100  # bytes of a key that is kept

    def __init__(self, limit: int):
        self.limit = limit
        self.keys, self.pool = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.begins, self.sizes, self.uses = (np.zeros(0, np.int32) for _ in range(3))

    def values(self, keys: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them the ids of each of the keys, which are distinct, begin and how many they are; learn(keys) gives the same for unknown ones."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        unknown = at < 0
        self.uses[at[~unknown]] += 1
        pool, begins, sizes = self.pool, np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        begins[~unknown], sizes[~unknown] = self.begins[at[~unknown]], self.sizes[at[~unknown]]
        if unknown.any():
            missing = keys.filter(pa.array(unknown))
            new, starts, counts = learn(missing)
            begins[unknown], sizes[unknown] = starts + np.int32(len(pool)), counts
            pool = np.concatenate([pool, new])
            self._keep(missing, new, starts, counts)
        return pool, begins, sizes

    def _keep(self, keys: pa.Array, pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(keys).to_numpy() <= self.LONGEST)[: self.limit]
        if len(self.keys) + len(short) > self.limit:
            stay = np.sort(np.argsort(-self.uses, kind="stable")[: min(self.limit // 2, self.limit - len(short))])
            self.pool = self.pool[spans(self.begins[stay], self.sizes[stay])]
            self.keys, self.sizes, self.uses = self.keys.take(pa.array(stay)), self.sizes[stay], self.uses[stay] >> 1
            self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        each = sizes[short]
        self.begins = np.concatenate([self.begins, np.cumsum(each, dtype=np.int32) - each + np.int32(len(self.pool))])
        self.pool = np.concatenate([self.pool, pool[spans(begins[short], each)]])
        self.keys = pa.concat_arrays([self.keys, keys.take(pa.array(short))])
        self.sizes, self.uses = np.concatenate([self.sizes, each]), np.concatenate([self.uses, np.zeros(len(short), np.int32)])


class ChunkEncoder(Chunked):
    """The tokenizers library's ids. Chunks that keep their spaces are cut, looked up and learnt as columns, without a Python object a chunk."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.keeps_space = not any(t.endswith("</w>") for t in vocab)
        self.edge = np.zeros(self.vocab_size, bool)  # begins with a space, or ends a word
        self.edge[[i for t, i in vocab.items() if (t[0] == "Ġ" if self.keeps_space else t.endswith("</w>"))]] = True
        lone = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.border = lone[0] if len(lone) == 1 else -1
        if any(re.search(f"[{WHITE}]", t.content) or not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token holds white space, or doesn't begin with <|")
        self.chunks = Columns(limit) if self.keeps_space else Generations(limit)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each text as little-endian uint32."""
        if not self.keeps_space:
            return super().encode(texts)
        raw, ends = self.spaced(texts)
        raw, cuts = raw.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def spaced(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and the number of ids up to and with each text."""
        even = [bool(t) and spaced_evenly(t) for t in texts]
        lists = pc.split_pattern(pa.array([BARE + t for t, e in zip(texts, even) if e], pa.binary()), b" ")
        cut = [pa.array(cut_slowly(t), pa.binary()) for t, e in zip(texts, even) if not e]
        coded = pa.concat_arrays([lists.flatten(), *cut]).dictionary_encode()
        pool, begins, sizes = self._distinct(coded.dictionary)
        which, even = coded.indices.to_numpy(), np.array(even, bool)
        numbers = np.zeros(len(texts), np.int64)  # chunks of each text
        numbers[even], numbers[~even] = np.diff(lists.offsets.to_numpy()), list(map(len, cut))
        if cut:  # those cut slowly lie behind the others
            firsts = np.zeros(len(texts), np.int64)
            firsts[even], firsts[~even] = np.cumsum(numbers[even]) - numbers[even], np.cumsum(numbers[~even]) - numbers[~even] + len(lists.flatten())
            which = which[spans(firsts, numbers)]
        each = sizes[which]
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])[np.cumsum(numbers)]
        return pool[spans(begins[which], each)], ends

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them those of each of these distinct chunks begin and how many they are. A word and the punctuation behind it are known apart."""
        data, offsets = bytes_and_offsets(chunks)
        words = pc.ascii_rtrim(as_text(chunks), characters=PUNCTUATION.decode())
        sizes = pc.binary_length(words).to_numpy()
        last = offsets[:-1] + sizes - 1
        a, b = (np.where(sizes > back, data[np.maximum(last - back, 0)], 0) if len(data) else np.zeros(len(last), np.uint8) for back in (0, 1))
        lower = a | 32
        letter = (lower >= 97) & (lower <= 122) | (b == 0xC3) & (a != 0x97) & (a != 0xB7)
        split = np.flatnonzero(letter & (sizes < np.diff(offsets)) & self._plain(chunks))
        tails = offsets[1:][split] - last[split]  # with the byte before, which becomes BARE
        marks = np.concatenate([[0], np.cumsum(tails)]).astype(np.int32)
        bare = data[spans(last[split], tails)]
        bare[marks[:-1]] = BARE[0]
        parted = np.zeros(len(chunks), bool)
        parted[split] = True
        firsts = pc.if_else(pa.array(parted), words.cast(pa.binary()), chunks)
        pieces = pa.concat_arrays([firsts, pa.Array.from_buffers(pa.binary(), len(split), [None, pa.py_buffer(marks), pa.py_buffer(bare)])]).dictionary_encode()
        pool, begins, sizes = self.chunks.values(pieces.dictionary, self._learn_columns)
        which = pieces.indices.to_numpy()
        numbers = 1 + parted
        at = np.cumsum(numbers) - numbers
        order = np.zeros(len(which), np.int32)
        order[at], order[at[split] + 1] = which[: len(chunks)], which[len(chunks) :]
        own = sizes[which[: len(chunks)]]
        own[split] += sizes[which[len(chunks) :]]
        return pool[spans(begins[order], sizes[order])], np.cumsum(own, dtype=np.int32) - own, own

    def _plain(self, chunks: pa.Array) -> np.ndarray:
        """Which chunks stand apart from others wherever they are?"""
        data, offsets = bytes_and_offsets(chunks)
        if not len(data):
            return np.zeros(len(chunks), bool)
        first, last = data[np.minimum(offsets[:-1], len(data) - 1)], data[np.maximum(offsets[1:] - 1, 0)]
        return (first > 32) & (first < 255) & (last > 32) & (np.diff(offsets) > 0) & ~pc.match_substring(chunks, b"<|").to_numpy(zero_copy_only=False)

    def _learn_columns(self, missing: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them those of each chunk begin and how many they are. Plain chunks many at once, as a call costs more than a chunk; others one by one.

        In a joined text a token that begins with a space shows where a chunk begins.
        """
        odd = ~self._plain(missing)
        plain = np.flatnonzero(~odd)
        begins, sizes = np.zeros(len(missing), np.int32), np.zeros(len(missing), np.int32)
        marks = np.append(np.arange(0, len(plain), BULK, dtype=np.int32), np.int32(len(plain)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(marks), as_text(missing.take(pa.array(plain)))), " ").to_pylist()
        found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)]
        # every chunk shows one edge at least, so equal numbers mean that each shows one
        good = np.array([int(self.edge[ids].sum()) for ids in found], np.int64) == np.diff(marks)
        ids = np.concatenate([np.zeros(0, "<u4"), *(f for f, ok in zip(found, good) if ok)])
        apart = np.repeat(good, np.diff(marks))
        starts = np.flatnonzero(self.edge[ids]).astype(np.int32)
        begins[plain[apart]], sizes[plain[apart]] = starts, np.diff(starts, append=np.int32(len(ids)))
        odd[plain[~apart]] = True
        alone = [np.frombuffer(x, "<u4") for x in self._encode([chunk_text(c) for c in missing.filter(pa.array(odd)).to_pylist()])]
        sizes[odd] = counts = np.array(list(map(len, alone)), np.int32)
        begins[odd] = len(ids) + np.cumsum(counts, dtype=np.int32) - counts
        return np.concatenate([ids, *alone]), begins, sizes

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set) -> None:
        """Chunks that stand apart wherever they are: many at once, as a call costs more than a chunk. Others one by one.

        In a joined text the end of a word, or a word between, shows where a chunk begins.
        """
        put = self.chunks.new
        plain = [c for c in missing if b"<|" not in c and b"\x01" not in c]
        odd = list(missing.difference(plain))
        split = [(c, w, c[len(w) :]) for c in plain if len(w := word_of(c)) < len(c)]
        if split:
            words, tails = {w for _, w, _ in split}, {t for _, _, t in split}
            new = self.chunks.missing(words | tails)
            odd += new.intersection(tails).difference(odd)
            plain = list(set(plain).difference([c for c, _, _ in split]).union(new.difference(tails)))
        letters = [c for c in plain if c.isalpha()]  # ASCII letters alone: one word each
        if letters:
            plain = list(set(plain).difference(letters))
        for chunks, between in ((plain, b" \x01 "), (letters, b" ")):
            parts = [chunks[i : i + BULK] for i in range(0, len(chunks), BULK)]
            joined = [between.join(p).decode() for p in parts]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                if chunks is letters:
                    ends = (np.flatnonzero(self.edge[ids]) + 1).tolist()
                    starts = np.array([0, *ends[:-1]])
                else:
                    at = np.flatnonzero(ids == self.border)
                    starts, ends = np.concatenate([[0], at + 1]), [*at.tolist(), len(ids)]
                if len(starts) != len(part):  # every chunk shows one edge at least, so equal numbers mean that each shows one
                    odd += part
                    continue
                raw = ids.tobytes()
                put.update([(c, raw[4 * i : 4 * j]) for c, i, j in zip(part, starts.tolist(), ends)])
        put.update(zip(odd, self._encode([c.decode() for c in odd])))
        put.update([(c, put[w] + put[t]) for c, w, t in split])


@cache
def encoder(path: str, limit: int) -> ChunkEncoder:
    """One encoder a Python worker; limit: entries of its columns, or of a generation of its dicts, some 200 bytes each."""
    return ChunkEncoder(path, limit)


KEPT.append(encoder)

def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
