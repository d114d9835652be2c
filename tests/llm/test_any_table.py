"""All operators and stages on tables with extra columns of clashing names, nulls everywhere, very long texts, repeated rows, ties, and no rows."""

import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import decontaminate as D
from corpusloom.llm import jaccard_join as J
from corpusloom.llm import lm_score as L
from corpusloom.llm import mixing as M
from corpusloom.llm import secrets as S
from corpusloom.llm import toxicity as T
from corpusloom.llm import url_rules as U
from corpusloom.llm import vector_graph as V
from corpusloom.llm.shared import fresh_path
from corpusloom.llm.token_counts import token_counts
from corpusloom.llm.token_files import token_file_digest, write_token_files

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, and names that need quotes.
CLASHES = (
    "__mix_room __mix_block __mix_pass __mix_ __toxicity __row __row_part __row_from __draw_id class n h g node rep mult cell block key digest shard value tokens "
    "matched url url_tokens score held_out predicted n_tokens pass first bits prefix count root component_id u v train total word logp y terms kind item_id covered label embedding vec"
).split() + ["a.b", "with blank", "tick`ed", "SELECT"]

WORD, BYTES, PIECES = (lambda name: lambda: P.path(name))("word_bpe_49k.json"), (lambda name: lambda: P.path(name))("byte_bpe_50k.json"), (lambda name: lambda: P.path(name))("piece_bpe_32k.model")


def files(docs, labels, bench):
    out = fresh_path(docs.sparkSession, "test-files")
    write_token_files(docs, out, WORD())
    return token_file_digest(docs.sparkSession, out)


OPERATORS = {
    "op1": lambda docs, labels, bench: M.mix_report(docs),
    "op3": lambda docs, labels, bench: L.likelihoods(docs, PIECES()),
    "op5": lambda docs, labels, bench: S.secret_spans(docs),
    "op6": lambda docs, labels, bench: D.contaminated(docs, bench),
    "op7": lambda docs, labels, bench: token_counts(docs, BYTES(), fresh_path(docs.sparkSession, "test-cache")),
    "op8": lambda docs, labels, bench: T.toxicity_scores(docs, labels),
    "op9": files,
    "op10": lambda docs, labels, bench: J.jaccard_groups(docs),
}
LONG = " ".join(random.Random(5).choices([f"w{i}x" for i in range(4000)], k=60_000)) + ", token = abcdef123456"
SAME = "again " * 100_000


def tables(spark, rows):
    docs = spark.createDataFrame(rows, SHAPE)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, "again " * 40), (2, "again " * 40), (None, None), (3, "")], "item_id long, text string")
    return docs, labels, bench


def wide(df):
    return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in df.columns}))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PLAIN = [(i, f"say one two three four five six {'seven' if i % 3 else 'token = 12ab34cd56'} {'x' * (i % 5)}", "en", "ab"[i % 2], 1) for i in range(12)]
AWKWARD = [(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", "a", 0), (2, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (3, SAME, "en", "b", 1), (4, " \t\n", None, "b", None), (None, "one two three four five six seven", "en", None, 2), (5, "é" * 3000, "xx", "b", 1)]


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    docs, labels, bench = tables(spark, PLAIN)
    assert rows_of(OPERATORS[name](wide(docs), wide(labels), wide(bench))) == rows_of(OPERATORS[name](docs, labels, bench))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty_tables(spark, name):
    docs, labels, bench = tables(spark, AWKWARD)
    got = OPERATORS[name](docs, labels, bench).collect()
    ids = sorted((r.doc_id for r in got), key=str)
    if name == "op6":
        assert sorted(map(tuple, got), key=str) == sorted([(None, 1, 7, 7, 1, 7), (3, 2, 40, 40, 1, 40), (3, 2, 40, 40, 1, 40)], key=str)
    elif name != "op1":
        assert ids == sorted((r[0] for r in AWKWARD), key=str)
    by_id = {r.doc_id: r for r in got}
    if name == "op1":
        assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (2, 3)} == {2: 60_003, 3: 100_000}
    if name == "op3":
        assert by_id[2].n_tokens == 60_004 and all(math.isfinite(r.score) for r in got)
    if name == "op5":
        assert (by_id[2].n_assign, by_id[3].n_assign) == (1, 0)
    if name in ("op7", "op9"):
        tok = Tokenizer.from_file((BYTES if name == "op7" else WORD)())
        for i, text in ((2, LONG), (3, SAME), (5, "é" * 3000), (4, " \t\n")):
            ids = tok.encode(text, add_special_tokens=False).ids
            assert by_id[i].n_tokens == len(ids) + (name == "op9")
            if name == "op9":
                assert by_id[i].ids_crc32 == zlib.crc32(np.array([*ids, 1], "<u4").tobytes())
    if name == "op10":
        words = LONG.split()
        assert by_id[2].n_shingles == len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) and by_id[3].n_shingles == 1
    empty = [t.limit(0) for t in (docs, labels, bench)]
    assert OPERATORS[name](*empty).count() == 0
    if name not in ("op1", "op6"):
        assert OPERATORS[name](docs, *empty[1:]).count() == len(AWKWARD)


def test_vectors_of_any_table(spark):
    """One id with vectors of two labels; repeated rows; ties; clashing names."""
    rows = [(9, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (4, [1.0, 0.01], 1), (3, [1.0, 0.01], 2), (9, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (5, None, 1), (5, None, 1), (6, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = V.vector_groups(df).select("vec_id", "n_links", "component_id")
    want = [(9, 2, 4), (9, 1, 3), (4, 2, 4), (3, 1, 3), (9, 0, 9), (None, 2, 4), (5, 0, 5), (5, 0, 5), (6, 0, 6)]
    assert rows_of(got) == sorted(want, key=str)
    assert rows_of(V.vector_groups(wide(df)).select("vec_id", "n_links", "component_id")) == rows_of(got)


def test_recall_below_the_target_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 1000], 1) for i in range(30)], "vec_id long, embedding array<double>, label int")
    whole = V._search_all
    monkeypatch.setattr(V, "_search_all", lambda *a: whole(*a).withColumn("n", F.lit(0).cast("long")))
    with pytest.raises(RuntimeError, match="recall"):
        V.vector_groups(df)


def test_urls_of_any_table(spark):
    """Equal rules tie by name; very long urls; nulls; repeated rows; clashing names."""
    urls = [f"http://s.net/{'alpha/beta' if i % 2 else 'good'}/{chr(97 + i % 5)}" for i in range(200)]
    rows = list(enumerate(urls)) + [(500, None), (500, None), (501, "http://s.net/" + "alpha/" * 20_000 + "beta"), (None, "http://s.net/good/"), (1, urls[1])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = U.judge_urls(pages, labels)
    found = [tuple(r) for r in got.select("page_id", "verdict", "matched").collect()]
    assert len(found) == len(rows) and (501, "block", "alpha beta block") in found and (500, "allow", None) in found and (None, "allow", "good allow") in found
    assert rows_of(U.judge_urls(wide(pages.select("page_id", "url")), wide(labels))) == rows_of(got)
    assert U.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    _, labels, bench = tables(spark, [])
    labels.write.parquet(f"{path}/labels.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_any_table(spark, folder, name, stage):
    docs = tables(spark, AWKWARD + PLAIN)[0]
    got, last = stage(spark, docs, folder), name == corpus_pipeline.STAGES[-1][0]
    if not last:
        assert got.columns == docs.columns
        quoted = wide(docs)
        also = stage(spark, quoted, folder)
        assert also.columns == quoted.columns
        assert rows_of(also.select(docs.columns)) == rows_of(got)
        assert all(list(r)[len(docs.columns) :] == list(quoted.first())[len(docs.columns) :] for r in also.collect())
    else:
        assert rows_of(stage(spark, wide(docs), folder)) == rows_of(got) and got.count() == docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0
