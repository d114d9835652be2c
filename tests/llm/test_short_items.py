"""Benchmark items of few words, and without an id."""

from corpusloom.llm import decontaminate as D


def test_short_items_and_items_without_an_id(spark):
    bench = spark.createDataFrame([(1, "Red, green, blue"), (2, "one two three four five six"), (None, "alpha beta gamma delta epsilon zeta"), (3, ""), (4, None)], "item_id long, text string")
    texts = ["a red green blue end", "red green", "say one two three four five", "alpha beta gamma delta epsilon", "red blue green", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.n_tiles, r.longest) for r in D.contaminated(docs, bench).collect()}
    assert got == {(0, 1): (3, 3, 1, 3), (2, 2): (5, 6, 1, 5)}
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [1, 4, 5, 6]
