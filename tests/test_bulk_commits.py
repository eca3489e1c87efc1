"""Commits of whole tables by name, and blocks of commits that become one, against the same commits one by one."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.values import Value
from factloom.kernel import Kernel, PendingNamed, Provenance
from factloom.plans import queries  # noqa: F401  the engine's modules in their order
from factloom.schema import EngineError
from factloom.sources import named

SCHEMA = "n BIGINT, subject_name STRING, predicate_name STRING, object STRUCT<kind: TINYINT, text: STRING, i64: BIGINT, f64: DOUBLE, b: BOOLEAN, ts: BIGINT>, valid_from BIGINT, valid_to BIGINT, observed_at BIGINT, confidence DOUBLE"
TABLES = ("log", "entities", "predicates", "payloads", "merges", "provenance")


def entries(n):
    rng = random.Random(5)
    values = [Value("text", "user-1"), Value("text", ""), Value("int64", 1), Value("double", 1.0), Value("double", -0.0), Value("double", 0.0), Value("double", float("nan")), Value("bool", True), Value("timestamp", 1)]
    return [PendingNamed(f"user-{rng.randrange(9)}", f"p{rng.randrange(4)}", rng.choice(values), i, 0, i, 0.5) for i in range(n)]


def frame(spark, some, first=0):
    rows = [(first + i, e.subject_name, e.predicate_name, e.object.fields(), e.valid_from, e.valid_to, e.observed_at, e.confidence) for i, e in enumerate(some)]
    random.Random(6).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def content(kernel):
    return {t: sorted(map(repr, kernel.store.table(t).drop("version").collect())) for t in TABLES} | {"next": kernel.store.manifest["next"]}


@pytest.mark.parametrize("few", [named.FEW, 0])
def test_load_by_name_is_commit_by_name(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(named, "FEW", few)
    all_of = entries(90)
    with Kernel(spark, tmp_path / "a") as one, Kernel(spark, tmp_path / "b") as bulk:
        for i in (0, 20, 70):
            one.commit_batch_by_name(all_of[i : {0: 20, 20: 70, 70: 90}[i]])
        bulk.commit_batch_by_name(all_of[:20])
        assert bulk.load_by_name(frame(spark, all_of[20:70]), "n") == 50
        bulk.commit_batch_by_name(all_of[70:])
        assert bulk.load_by_name(frame(spark, []), "n") == 0
        assert content(one) == content(bulk)
        with pytest.raises(EngineError):
            bulk.load_by_name(frame(spark, all_of[:3]).withColumn("subject_name", F.lit(None).cast("string")), "n")
        assert content(one) == content(bulk) and not list((tmp_path / "b").glob("_load-*"))


def steps(kernel):
    for i in range(1, 6):
        kernel.commit_by_name("x", f"q{i % 2}", Value("int64", i % 3), i, 0, i, 0.5)
        kernel.commit_superseding(1, 1, 2, i, 0, i, 0.5, supersedes_id=i)
        kernel.record_provenance_batch([Provenance(i, i, i, "m")])
        kernel.intern_document(b"d")
        kernel.merge_entities(1, 100 + i, i)


def test_together_is_one_commit_of_the_same(spark, tmp_path):
    with Kernel(spark, tmp_path / "a") as one, Kernel(spark, tmp_path / "b") as block:
        steps(one)
        with block.together():
            steps(block)
            assert not block.store.manifest["files"]["log"]
        assert content(one) == content(block)
        assert block.store.manifest["version"] == 1 and len(block.store.manifest["files"]["log"]) == 1
        with pytest.raises(ZeroDivisionError), block.together():
            block.intern_document(b"never")
            raise ZeroDivisionError
        with pytest.raises(EngineError), block.together():
            block.load_by_name(frame(spark, entries(2)), "n")
        assert content(one) == content(block)
    with Kernel(spark, tmp_path / "b") as again:
        assert again.store.next("assertion") == 11


def test_the_script_makes_few_commits(spark, tmp_path):
    """One commit a batch and turn took more than the time there is at 60 times the events."""
    from factloom.sources import scripted

    store = scripted.opened(spark, "/root/testdata/sf0.01", scripted.committed)
    assert store.manifest["version"] <= 4 and store.next("assertion") == 10_022
