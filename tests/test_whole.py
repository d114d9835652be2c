"""Queries that do the whole job on small tables of their own."""

import hashlib

import duckdb

from corpusloom.plans import catalog


def test_pieces_of_long_texts(spark, tmp_path):
    """Commas after the 80th character and all that follows a hyphen count."""
    text = "Word " + "x" * 100 + ", late , tag-" + "y" * 50 + ","
    spark.createDataFrame([(1, text), (2, ""), (3, "a,b"), (4, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in catalog.queries()["text_pieces_whole"](spark, str(tmp_path)).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    tags = ["Word " + "x" * 100, "late", "tag-" + "y" * 50, ""]
    assert got[1] == ("word", 51, md5("y" * 50 + ","), 4, md5("|".join(tags)))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in db.execute(catalog.oracle_sql()["text_pieces_whole"]).fetchall()} == got
