"""What must not come to the driver, whatever Spark takes its size for."""

from factloom.llm import simhash_dedup


def test_variants_are_never_broadcast(spark, tmp_path):
    """Seventy variants a fingerprint look as small as the fingerprints; a broadcast of them took more than the driver's memory at 0.6 GB of documents."""
    path = f"{tmp_path}/fps"
    spark.range(2000).selectExpr("xxhash64(id) as fp").write.parquet(path)
    plan = simhash_dedup.links(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
