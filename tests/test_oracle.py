"""Every query with SQL equals it on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return db


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_event_shares_read_no_tokens(spark, sf, con, monkeypatch):
    from corpusloom.plans import models

    monkeypatch.setattr(models, "assigned_of", lambda *a: pytest.fail("tokens are assigned"))
    assert QUERIES["event_psi"](spark, sf).count() == len(con.execute(SQL["event_psi"]).df())


def test_draw_in_a_document_of_many_words(spark, tmp_path):
    """Positions beyond 20,504 times 104,729 are more than an int holds."""
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(21_000)]
    spark.createDataFrame([(1, " ".join(words)), (2, "wak wbk")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["inverse_cdf_draw"](spark, str(tmp_path)).toPandas(), db.execute(SQL["inverse_cdf_draw"]).df()
    assert len(got) > 10_000
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_tokens_with_entities_are_not_shuffled(spark, sf):
    """A vocabulary of known size goes to the tokens, and a document's entities to its text: the only rows dealt out are documents and their entities."""
    from corpusloom.operators import corpus as C
    from corpusloom.operators import topics as M
    from corpusloom.plans import corpus, models

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a vocabulary beyond it
    try:
        encoded = C.encode(corpus.tokens_of(spark, sf), corpus.written(corpus.vocabulary_of(spark, sf), "vocabulary"))
        assert "hashpartitioning(token" not in encoded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    top = spark.createDataFrame([(1, 5, 2), (1, 9, 3), (2, 7, 1)], "doc_id long, entity_id long, cnt long")
    tokens = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in range(12)], "doc_id long, pos int")
    lists = {1: [5, 5, 9, 9, 9], 2: [7]}
    want = sorted((d, p, (d + p) % 2 if d in lists else 0, lists[d][p % len(lists[d])] if d in lists and (d + p) % 2 else None) for d in (1, 2, 3) for p in range(12))
    joined = tokens.join(M.entity_lists(top), "doc_id", "left")
    for rows in (M.switched(joined, models.TOP), M.switched(joined), M.with_entities(tokens, top)):
        assert sorted(tuple(r) for r in rows.select("doc_id", "pos", "s", "entity_id").collect()) == want
