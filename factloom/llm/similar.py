"""Near copies by the Jaccard similarity of their word shingles, found by deletion variants of SimHash segments.

A set's fingerprint is cut into segments of `width` bits. Sets that differ in at most one bit of some segment meet: a segment is indexed as it is
and under variants with one wildcard bit. Wildcards go to the WILD bits whose votes were closest, which are those that near copies
differ in. A bit differs with probability 0.15 at similarity 0.8 (the angle between the sets), so a segment brings two such sets together
with a probability that width gives; as many segments are taken as leave MISS of the pairs at exactly 0.8 apart, and far less of nearer ones. The width
follows the number of rows, so that buckets stay small at every size. Sets of at most SMALL shingles are coarse for votes: they also meet, exactly, under
each set with one element deleted. Every candidate is then verified on the sets themselves, so no pair below the bound is linked.

    stars     each set is held against the smallest of one of its buckets, that with the nearest sketch; twice more against the nearest that is in another component by then;
              and at last against all that still are. A large group of near copies grows together on the way, so it costs its size, not its square
    the rest  members of a bucket of three or more that are still in different components are held against each other. A set takes its root along to its buckets, whose rows then
              show by themselves whether they have several

The first 768 bits make a sketch; candidates whose sketches differ in more than FAR bits (116 expected at similarity 0.8, 4.5 standard deviations below FAR; FAR_FEW where a set
is small, as votes of few are coarse) aren't verified. Nor are those that can't be similar: a set's parity has a bit for each of 768 classes of hashes, whether an odd number of
its own are in it, so two parities differ in at most as many bits as elements are in one set alone, which at similarity 0.8 are a ninth of both sizes at most. This loses
no link and leaves few others of sets of up to some 1,500 shingles: a group of which many are a little less similar than 0.8 would otherwise make its square of pairs.
Only distinct sets enter: equal ones never meet as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, filter_of, id_and_text, join_with_hot, may_hold, release, swept, written
from .components import components
from .lm_score import _mix
from .simhash_dedup import drop_but_one

WILD, MISS, SMALL = 6, 5e-3, 12
FAR, FAR_FEW, FEW = 161, 215, 60
FLIP = math.acos(1.6 / 1.8) / math.pi  # a bit's chance to differ at similarity 0.8, sets of equal size
SKETCH = [f"s{i}" for i in range(12)]
PARITY = [f"p{i}" for i in range(12)]
BLOCK = 255  # rows whose bits a byte can count


@dataclass(frozen=True)
class Layout:
    width: int
    segments: int

    @property
    def kind(self) -> type:
        """Of a stored value or mask."""
        return np.uint32 if self.width <= 32 else np.uint64

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint."""
        return max(len(SKETCH), -(-self.width * self.segments // 64))


def layout(rows: int) -> Layout:
    """Segments so wide that two sets that have nothing in common rarely share a bucket, whatever the rows, and as many as MISS asks for."""
    width = min(54, max(16, math.ceil(math.log2(max(rows, 1))) + 4))
    same = (1 - FLIP) ** width
    one = 0.75 * width * FLIP * (1 - FLIP) ** (width - 1)  # by simulation three quarters of single differing bits are among both sets' WILD closest
    return Layout(width, math.ceil(math.log(MISS) / math.log(1 - same - one)))


def shingles(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles: ASCII letters lowered, words split at ASCII white space; of fewer words than a shingle, the sequence itself; of none, none."""
    split = [t.lower().split() for t in texts]
    of = {w: xxhash.xxh64_intdigest(w) for w in set().union(*split)}
    out = []
    for some in split:
        h = np.fromiter(map(of.__getitem__, some), np.uint64, len(some))
        k = min(words, len(h))
        gram = h[: len(h) - k + 1] if k else h
        for i in range(1, k):
            gram = _mix(gram, h[i : len(h) - k + 1 + i], i)
        out.append(np.unique(gram))
    return out


def name_of(grams: np.ndarray) -> int:
    """A set's number."""
    return xxhash.xxh64_intdigest(grams.tobytes())


def votes(grams: np.ndarray, words: int) -> np.ndarray:
    """How many of a set's hashes have each of 64 x words bits set; each word takes the hash through another mix."""
    turns = np.arange(1, words + 1, dtype=np.uint64)
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(grams), BLOCK):
        x = _mix(grams[i : i + BLOCK, None], turns[None, :], 77)
        x = _mix(x, turns[None, :], 78)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones


def signatures(sets: list[np.ndarray], form: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, none of them empty: segments' values and wildcard masks (sets x 2 x segments), and sketches (sets x 12)."""
    ones = np.stack([votes(s, form.words) for s in sets])
    n = np.array(list(map(len, sets)))[:, None]
    bits, doubt = 2 * ones > n, np.abs(2 * ones - n)
    cut = form.width * form.segments
    shape = (len(sets), form.segments, form.width)
    power = np.uint64(1) << np.arange(form.width, dtype=np.uint64)
    values = (bits[:, :cut].reshape(shape) * power).sum(2, dtype=np.uint64)
    weak = np.zeros(shape, bool)
    np.put_along_axis(weak, np.argpartition(doubt[:, :cut].reshape(shape), WILD - 1, axis=2)[:, :, :WILD], True, axis=2)
    masks = (weak * power).sum(2, dtype=np.uint64)
    return np.stack([values, masks], 1).astype(form.kind), np.packbits(bits[:, : 64 * len(SKETCH)], axis=1, bitorder="little").view(np.uint64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, for each of 768 classes of hashes, whether an odd number of its own are in it (sets x 12)."""
    bits = 64 * len(PARITY)
    at = (np.concatenate(sets) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
    who = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    odd = np.bincount(who * bits + at.astype(np.int64), minlength=len(sets) * bits).reshape(len(sets), bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def variant_keys(signature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which set, key) of every variant of signatures (sets x 2 x segments), set by set: the segment's number, the wildcard's place (63: none) and the other bits."""
    values, masks = signature[:, 0].astype(np.uint64), signature[:, 1].astype(np.uint64)
    wild = (masks[:, :, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(bool)
    who, segment, at = np.nonzero(np.concatenate([wild, np.ones((*masks.shape, 1), bool)], 2))
    none, at = at == width, at.astype(np.uint64)
    value = values[who, segment]
    value = np.where(none, value, value & ~(np.uint64(1) << at))
    place = np.where(none, np.uint64(63), at)
    return who, value | place << np.uint64(width) | segment.astype(np.uint64) << np.uint64(width + 6)


def deletion_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of a small set as it is and without each of its elements."""
    mixed = _mix(grams, grams, 79)
    whole = np.add.reduce(mixed, dtype=np.uint64)
    return _mix(np.append(whole - mixed, whole), np.ones(1, np.uint64), 80)


def marks(docs: DataFrame, form: Layout, words: int = 5) -> DataFrame:
    """doc_id, digest (of the text), fp (of its set), signature (null for an empty set), deletions, sketch, parity and size of each row; null text counts as empty."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches(it, rows=500, size=1 << 20):
            sets = shingles(batch.column(2).cast(pa.binary()).to_pylist(), words)
            fps = np.array([name_of(s) for s in sets], np.uint64).view(np.int64)
            full = [i for i, s in enumerate(sets) if len(s)]
            shown, sketch = [None] * len(sets), np.zeros((len(sets), len(SKETCH)), np.int64)
            parity = parities(sets).view(np.int64)
            if full:
                found, marked = signatures([sets[i] for i in full], form)
                sketch[full] = marked.view(np.int64)
                for i, x in zip(full, found):
                    shown[i] = x.tobytes()
            less = [deletion_keys(s).view(np.int64) if 0 < len(s) <= SMALL else [] for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(fps), pa.array(shown, pa.binary()), pa.array(less, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(c)) for c in np.hstack([sketch, parity]).T), pa.array(list(map(len, sets)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp", "signature", "deletions", *SKETCH, *PARITY, "size"])

    rows = id_and_text(docs).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest string, fp long, signature binary, deletions array<long>, " + ", ".join(f"{c} long" for c in SKETCH + PARITY) + ", size int")


def keys_of(distinct: DataFrame, form: Layout) -> DataFrame:
    """(fp, key) of every variant of every distinct set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                fps = batch.column(0).to_numpy(zero_copy_only=False)
                signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), form.kind).reshape(len(fps), 2, form.segments)
                who, keys = variant_keys(signature, form.width)
                less = batch.column(2)
                more = np.repeat(np.arange(len(fps)), [len(x) for x in less.to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(fps[np.concatenate([who, more])]), pa.array(np.concatenate([keys.view(np.int64), less.flatten().to_numpy(zero_copy_only=False)]))], names=["fp", "key"])

    return distinct.select("fp", "signature", "deletions").mapInArrow(run, "fp long, key long")


def mixed_buckets(several: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """key, fp, root, sketch, parity and size of the sets in buckets that have several roots. several: key and fp of the buckets to look at.

    A set's keys, of which there are as many as its segments have variants at most, are joined as one row with what else is known of it.
    """
    keys = several.groupBy("fp").agg(F.collect_list("key").alias("keys"))
    sets = sketches.join(keys, "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rows = sets.select(F.explode("keys").alias("key"), "fp", F.coalesce("root", "fp").alias("root"), *SKETCH, *PARITY, "size")
    bucket = Window.partitionBy("key")
    return rows.withColumn("lo", F.min("root").over(bucket)).withColumn("hi", F.max("root").over(bucket)).where("lo <> hi").drop("lo", "hi")


def sets_of(docs: DataFrame, wanted: DataFrame, marked: DataFrame, words: int) -> DataFrame:
    """fp and grams of the sets that `wanted` (fp) names. Of each one text is cut into shingles, picked by its digest; texts that a filter holds back aren't."""
    texts = marked.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("digest").alias("digest"))
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(texts.select(number.alias("n")), "n"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = pa.array(may_hold(bits.value, batch.column(1).to_numpy(zero_copy_only=False)))
            for some in batches([pa.RecordBatch.from_arrays([batch.column(0).filter(ok)], names=["text"])], rows=500, size=1 << 20):
                sets = shingles(some.column(0).cast(pa.binary()).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([name_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "grams"])

    named = id_and_text(docs).select("text", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).select("text", number.alias("n"))
    return named.mapInArrow(run, "fp long, grams array<long>").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of `least` or more."""
    x, y = sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("grams").alias("y"))
    # the smallest set of a large group is in a pair with every other one
    first = join_with_hot(pairs, x, "a", pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    both, sizes = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return first.join(y, "b").where(both / (sizes - both) >= F.lit(least)).select("a", "b")


def _distance(x: str, y: str, words: list[str] = SKETCH) -> str:
    return "(" + " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in words) + ")"


def _near(x: str, y: str) -> str:
    return f"9 * {_distance(x, y, PARITY)} <= {x}.size + {y}.size and {_distance(x, y)} <= if(least({x}.size, {y}.size) <= {FEW}, {FAR_FEW}, {FAR})"


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, digest, fp and root (the same number for all rows of a group) of each row of docs.

    Rows link if the Jaccard similarity of their shingle sets is at least `least`, which the segments are laid out for from 0.8; links reach on. Empty sets are equal to each other.
    Repeated rows and null identifiers are members like others. Empty table: empty result.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the segments are laid out for similarities of 0.8 and more")
    form = layout(docs.count())
    marked = written(marks(docs, form, words), "shingle-marks")
    distinct = written(marked.where("signature is not null").dropDuplicates(["fp"]).select("fp", "signature", "deletions", *SKETCH, *PARITY, "size"), "shingle-sets")
    keys = keys_of(distinct, form)
    bucket = Window.partitionBy("key")
    shared = keys.withColumn("m", F.min("fp").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
    buckets = written(shared.select("key", "fp", "m", "n"), "shingle-buckets")
    sketches = distinct.join(buckets.select("fp").distinct(), "fp", "left_semi").select("fp", *SKETCH, *PARITY, "size")
    sketches = written(sketches, "shingle-sketches")
    stars = buckets.where("fp <> m").select(F.col("m").alias("a"), F.col("fp").alias("b")).distinct()
    stars = stars.join(sketches.alias("x"), F.expr("a = x.fp")).join(sketches.alias("y"), F.expr("b = y.fp")).where(_near("x", "y")).select("a", "b", F.expr(_distance("x", "y")).alias("d"))
    stars = written(stars, "shingle-near-stars")
    links, sets = None, None

    def verify(pairs: DataFrame, turn: str) -> DataFrame:
        """Roots after the links among pairs."""
        nonlocal links, sets
        ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = written(ends if sets is None else ends.join(sets.select("fp"), "fp", "left_anti"), f"shingle-{turn}-wanted")
        if sets is None or not wanted.isEmpty():
            made = written(sets_of(docs, wanted, marked, words), f"shingle-{turn}-sets")
            sets = made if sets is None else sets.unionByName(made)
        near = written(verified(pairs, sets, least), f"shingle-{turn}-links")
        links = near if links is None else links.unionByName(near)
        roots = written(components(links), f"shingle-{turn}-roots")
        swept(docs.sparkSession)
        return roots

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose ends aren't in one component."""
        x, y = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        return pairs.join(x, "a", "left").join(y, "b", "left").where("coalesce(x, a) <> coalesce(y, b)").drop("x", "y")

    left, roots = stars, None
    for turn in range(3):
        nearest = left.groupBy("b").agg(F.min(F.struct("d", "a")).alias("first")).select("first.a", "b")
        tried = written(nearest, f"shingle-pairs-{turn}")
        roots = verify(tried, f"turn-{turn}")
        left = written(apart(left.join(tried, ["a", "b"], "left_anti"), roots), f"shingle-left-{turn}")
        if left.isEmpty():
            break
    else:
        roots = verify(left.select("a", "b"), "rest")
    mixed = written(mixed_buckets(buckets.where("n > 2").select("key", "fp"), sketches, roots), "shingle-mixed")
    met = mixed.alias("x").join(mixed.alias("y"), F.expr(f"x.key = y.key and x.fp < y.fp and x.root <> y.root and {_near('x', 'y')}"))
    met = written(met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti"), "shingle-met")
    if not met.isEmpty():
        roots = verify(met, "met")
    named = roots.select(F.col("node").alias("fp"), "root")
    every = written(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "shingle-named")
    return join_with_hot(marked.select("doc_id", "digest", "fp"), every.select("fp", "root"), "fp", every.select("fp", "n"))


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group: that of the smallest identifier."""
    return drop_but_one(docs, similar_groups(docs, words, least))
