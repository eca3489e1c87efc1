"""Few links in one task and many in rounds: the same components, and rounds only where links are many."""

import random

import pytest

from factloom.llm import components as module


def brute(pairs):
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {x: up(x) for pair in pairs if pair[0] != pair[1] for x in pair}


@pytest.mark.parametrize("few", [module.FEW, 0])
def test_same_components(spark, monkeypatch, few):
    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(3)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(40)] + [(7, 7)]
    found = module.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
    assert len(found) == len({r.node for r in found}) and {r.node: r.root for r in found} == brute(pairs)


def test_few_links_take_no_rounds(spark, monkeypatch):
    """On 211 partitions rounds took hundreds of shuffles for some ten thousand links, and more disk than there is."""
    monkeypatch.setattr(module, "_star", lambda links: pytest.fail("a round"))
    links = spark.range(500).selectExpr("id as a", "id + 1 as b").repartition(8)
    assert {r.root for r in module.components(links).collect()} == {0}


def test_swept_gives_back_shuffle_files(spark):
    import gc
    import time
    from pathlib import Path

    from factloom.llm.common import swept

    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: sum(1 for _ in local.rglob("shuffle_*"))
    gc.collect()
    swept(spark)
    time.sleep(2)
    before = files()
    spark.range(1000).repartition(7, "id").distinct().write.format("noop").mode("overwrite").save()
    for _ in range(20):
        swept(spark)
        if files() <= before:
            break
        time.sleep(0.3)
    assert files() <= before
