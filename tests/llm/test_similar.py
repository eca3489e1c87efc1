"""The pipeline's near stage against brute-force Jaccard, and which rows go."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from brute_jaccard import one_a_group
from factloom.llm import similar


def near(spark, rows):
    return corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")


def test_near_stage_of_a_table(spark):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").drop_duplicates("text")
    rows = list(zip(d.doc_id.tolist(), d.text))
    assert sorted(r.doc_id for r in near(spark, rows).collect()) == one_a_group(rows)


def test_near_stage_of_edited_texts(spark):
    """Edits of one to twelve words of texts of 4 to 150: similarities on both sides of the bound; a chain whose ends differ; a part two texts share."""
    rng = random.Random(3)
    texts = ["", None, " \n", "one", "ONE", "a b c d e f g h", "a b c d e f g h i"]
    for n in (4, 5, 9, 30, 80, 150):
        for _ in range(8):
            t = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(t))
            for edits in (1, 1, 2, 3, 12):
                t = list(t)
                for _ in range(edits):
                    t[rng.randrange(n)] = f"z{rng.randrange(5000)}"
                texts.append(" ".join(t))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    found = sorted(r.doc_id for r in near(spark, rows).collect())
    assert found == one_a_group(rows) and len(found) < len(rows)


@pytest.mark.parametrize("n", [1, 4, 5, 8, 9, 12, 20, 61, 150])
def test_near_sets_meet(n):
    """Sets at the bound share a key and keep their sketches within FAR bits; of small ones none is missed, of others as few as MISS says."""
    rng, form = np.random.default_rng(n), similar.layout(250_000)
    missed = 0
    for _ in range(150):
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        own = n // 9
        y = np.concatenate([x[: n - own], rng.integers(0, 1 << 64, own, dtype=np.uint64)]) if own else x[: -(n // 5) or None]
        found, sketch = similar.signatures([x, y], form)
        keys = [set(similar.variant_keys(s[None], form.width)[1].tolist()) | (set(similar.deletion_keys(v).tolist()) if len(v) <= similar.SMALL else set()) for s, v in zip(found, (x, y))]
        missed += not keys[0] & keys[1]
        assert sum(int(v).bit_count() for v in sketch[0] ^ sketch[1]) <= (similar.FAR_FEW if n <= similar.FEW else similar.FAR)
    assert missed == 0 if n <= 9 else missed <= 4


def test_layouts_follow_the_rows():
    """Wider segments for more rows, and by the model as few misses."""
    widths = [similar.layout(n) for n in (0, 1000, 10**6, 10**9)]
    assert [w.width for w in widths] == [16, 16, 24, 34] and [w.segments for w in widths] == sorted(w.segments for w in widths)


def test_identifiers_that_texts_share(spark):
    """Each group keeps one row, whatever other rows with its identifiers do."""
    a, b = "red fox jumps over one lazy dog at noon today " * 2, "we ship nine crates of pears to the north port each week"
    rows = [(1, a), (3, a.upper()), (3, b), (7, b.upper()), (None, a.title()), (None, "an unrelated text that nobody else holds"), (None, "x y z"), (None, "X y z")]
    found = sorted((str(r.doc_id), r.text.lower()) for r in near(spark, rows).collect())
    assert found == sorted([("1", a), ("3", b), ("None", rows[5][1]), ("None", "x y z")])
