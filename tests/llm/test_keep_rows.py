"""One row of each group of near copies stays where ids are repeated or null."""

from corpusloom.llm import jaccard_join as J


def test_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(3, a), (7, a + " x"), (7, b), (7, b), (None, a), (None, c), (None, c + " x"), (None, c), (9, ""), (None, None)]
    got = [tuple(r) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (7, b), (None, c), (9, ""), (None, None)], key=str)
