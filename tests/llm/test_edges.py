"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names, for every operator and stage."""

import pytest

import corpus_pipeline
from factloom.llm import ann, bpe_trie, exact_dedup, language, lm_score, packing, quality, secrets, simhash_dedup, token_files
from factloom.llm.chunks import tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Names that the operators use for themselves.
CLASH = "digest string, run long, score double, ids string, part int, h long, bits int, n long, key string, node long, root long, block long, p int, held_out boolean, keep_id long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def docs(spark, texts):
    rest = ("x", 1, 0.5, "y", 1, 2, 3, 4, "k", 5, 6, 7, 8, True, 9)
    return spark.createDataFrame([(i, t, lang, None, None, *rest) for i, t, lang in texts], SCHEMA)


LONG = "uniform words repeat here and there " * 40_000
ODD = [(1, None, None), (2, "", "en"), (3, "a b c d", "en"), (3, "a b c d", "en"), (None, "a b c d", "de"), (None, None, None), (4, LONG, "en"), (5, "  \n\t ", "fr"), (6, "token: abcdef1 \U0001f600 é́", None), (7, "a b c d", "en")]

RUNS = {
    "packing": lambda d: packing.pack(d, tokenizer_path(WORD)),
    "quality": lambda d: quality.score(d.select("doc_id", "text"), quality.RuleModel(0.5, (1.0,), (quality.Rule(((0, True, 1.0),)),))),
    "backoff": lm_score.backoff_scores,
    "secrets": secrets.scan,
    "language": lambda d: language.identify(d, language.learn(d)),
    "exact": exact_dedup.exact_groups,
    "encode": lambda d: bpe_trie.decode(bpe_trie.encode(d, tokenizer_path(BYTE)), tokenizer_path(BYTE)),
    "near": simhash_dedup.near_groups,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(spark, name):
    found = RUNS[name](docs(spark, ODD)).collect()
    if name == "packing":
        assert sum(r.length for r in found if r.doc_id == 3) == 2 * next(r.doc_tokens for r in found if r.doc_id == 3)
        assert [r.length for r in found if r.doc_id == 2] == [1] and len({r.sequence_id for r in found}) == len(found)
    else:
        assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in ODD)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](docs(spark, [])).collect() == []


def test_exact_groups_of_odd_rows(spark):
    for keep, winner in (("smallest", 3), ("largest", 7)):
        found = exact_dedup.exact_groups(docs(spark, ODD), keep=keep).collect()
        same = [r for r in found if r.group_size == 4]
        assert len(same) == 4 and {r.keep_id for r in same} == {winner} and sum(r.kept for r in same) == 1
        empty = [r for r in found if r.doc_id == 2 or r.group_size == 3]
        assert len(empty) == 3 and {r.keep_id for r in empty} == {1 if keep == "smallest" else 2}


def test_kept_columns(spark):
    d = docs(spark, ODD)
    kept = exact_dedup.drop_copies(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6"]
    near = simhash_dedup.drop_near_copies(d)
    assert near.columns == d.columns and {r.doc_id for r in near.collect()} == {1, 3, 4, 6}
    red = secrets.redact(d)
    assert red.schema == d.schema and [r.text for r in red.collect() if r.doc_id == 6] == ["[SECRET] \U0001f600 é́"]
    assert quality.keep_good(d, quality.RuleModel(0.0, (), ())).columns == d.columns


def test_token_files_of_odd_rows(spark, tmp_path):
    for texts in (ODD, []):
        folder = f"file://{tmp_path}/t{len(texts)}"
        token_files.write_tokens(docs(spark, texts), folder, tokenizer_path(BYTE))
        found = token_files.read_tokens(spark, folder).orderBy("start").collect()
        assert len(found) == len(texts)
        assert [r.doc_id for r in found] == sorted((i for i, *_ in texts), key=lambda i: -1 if i is None else i)
        at = 0
        for r in found:
            assert r.start == at
            at += len(r.ids) // 4


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, id long, v string, key string"
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (40, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (20, [1.0, 0.0])]
    index = ann.AdditiveIndex(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema))
    found = index.search(index.rows.where("id % 20 = 0").distinct()).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(20, 1, 1, 1.0), (20, 2, 9, 1.0), (20, 3, 2, 0.5)]
    empty = ann.AdditiveIndex(spark.createDataFrame([], schema))
    assert empty.search(empty.rows).collect() == []


def test_untrained(spark):
    d, labels = docs(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(d, labels).rules == ()
    one = spark.createDataFrame([(3, 1, None), (4, None, 0), (None, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(d, one).rules == ()
    found = language.identify(d, language.learn(d.where("lang is null"))).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, texts in (("odd", ODD), ("none", [])):
        d = docs(spark, texts)
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, d, sf)
            assert stage == "packing" or out.columns == d.columns
            out.write.parquet(path := f"{sf}/{name}-{stage}")
            d = spark.read.parquet(path)
        assert d.count() == 0 if not texts else d.count() > 0
