"""Which rows of near-copy groups go where identifiers repeat."""

from factloom.llm import simhash_dedup

A, B = "red fox jumps over one lazy dog at noon today " * 2, "we ship nine crates of pears to the north port each week"
ROWS = [(1, A), (3, A.upper()), (3, B), (7, B.upper()), (None, A.title()), (None, "an unrelated text that nobody else holds at all"), (None, "x y z"), (None, "X y z"), (9, "twice the same row"), (9, "twice the same row")]


def test_identifiers_that_texts_share(spark):
    """Each group keeps one row, whatever other rows with its identifiers do."""
    found = sorted((str(r.doc_id), r.text.lower()) for r in simhash_dedup.drop_near_copies(spark.createDataFrame(ROWS, "doc_id long, text string")).collect())
    assert found == sorted([("1", A), ("3", B), ("None", ROWS[5][1]), ("None", "x y z"), ("9", "twice the same row")])
