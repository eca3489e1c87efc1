"""How many Python workers a task of the pipeline takes at once. Those that one stage needs stay, with what they keep, for all that follow."""

import re

import corpus_pipeline

TEXTS = [f"page {i} tells of {i * 7} ships that left the north port for {i % 5} other towns before noon" for i in range(40)]
LABELS = "doc_id long, quality int"


def beside(plan: str) -> list[str]:
    """Steps in Python of a plan, as Spark prints it, that take rows from another such step without an exchange or a file between."""
    above, found = [], []
    for line in plan.splitlines():
        if not (m := re.match(r"([\s:+-]*)(?:\* ?)?(?:\(\d+\) )?(\w+)", line)):
            continue
        depth = len(m[1])
        above = [x for x in above if x[0] < depth]
        within = [x[1] for x in above]
        last = max((i for i, x in enumerate(within) if "Exchange" in x), default=-1)
        if "InArrow" in m[2] and any("InArrow" in x for x in within[last + 1 :]):
            found.append(line)
        above.append((depth, m[2]))
    return found


def test_what_the_test_sees(spark):
    """One after the other is seen, an exchange between is not."""
    rows = spark.range(9)
    one = rows.mapInArrow(lambda it: it, "id long")
    shown = lambda df: beside(df._jdf.queryExecution().executedPlan().toString())
    assert not shown(one) and not shown(one.repartition(3).mapInArrow(lambda it: it, "id long")) and not shown(one.unionAll(one))
    assert shown(one.mapInArrow(lambda it: it, "id long")) and shown(one.where("id > 3").mapInArrow(lambda it: it, "id long"))


def test_one_worker_a_task(spark, tmp_path):
    """The exact stage's filter took two steps in Python at once: four workers on an executor of two cores, and over 3,000 MB of its memory later on."""
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: [listed.apply(i).executionId() for listed in [store.executionsList()] for i in range(listed.size())]
    before = max(ids(), default=-1)
    assert len({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [store.execution(i).get().physicalPlanDescription().split("\n\n")[0] for i in ids() if i > before]  # Spark keeps the last thousand
    assert sum("InArrow" in p for p in plans) > 8
    assert [x for p in plans for x in beside(p)] == []
