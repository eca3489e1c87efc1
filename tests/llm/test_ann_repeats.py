"""Repeated rows take no places of the index."""

import numpy as np

from factloom.llm import ann


def test_a_hot_vector_of_repeated_rows(spark):
    """30 identifiers share a vector and each row is there three times: the 20 smallest others answer, for members and for a vector near them."""
    x = np.random.default_rng(9).normal(size=(200, 8))
    x[:30] = 4 * x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 3
    index = ann.AdditiveIndex(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=16)
    asked = spark.createDataFrame([(0, x[0].tolist()), (29, x[29].tolist()), (1000, (0.99 * x[0]).tolist())], "id long, v array<double>")
    found = index.search(asked, euclidean=True).toPandas().sort_values("rank").groupby("query_id").vec_id.apply(list)
    assert found[0] == list(range(1, 21)) and found[29] == found[1000] == list(range(20))
