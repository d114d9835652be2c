"""Indexes equal scans and read only what they need; large files are read by many tasks and give what whole files do."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import text_index as I
from corpusloom.sources import large as L
from corpusloom.sources import readers as R


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(2)
    return {i: draw.choice([None, "", "x"]) if i % 9 == 0 else " ".join(draw.choices(["Alpha", "alpha", "beta", "gamma", "alphabet", "É", "a1", "a"], k=30)) for i in range(80)}


def test_word_index(spark, tmp_path, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    I.WordIndex.build(docs, str(tmp_path / "w"), buckets=16)
    index = I.opened(spark, str(tmp_path / "w"), I.WordIndex, 16)
    words = {i: [w.lower() for w in (t or "").replace("É", " ").split()] for i, t in texts.items()}
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(index.all_of("ALPHA", "beta", "alpha")) == [i for i, w in words.items() if {"alpha", "beta"} <= set(w)]
    assert keys(index.any_of("x", "gamma")) == [i for i, w in words.items() if {"x", "gamma"} & set(w)]
    assert keys(index.prefix("alphab")) == [i for i, w in words.items() if any(x.startswith("alphab") for x in w)]
    assert keys(index.all_of("nowhere")) == keys(index.prefix("nowhere")) == keys(index.phrase("alpha", "nowhere")) == []
    places = {i: re.findall("[$a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    for phrase in (["alpha", "beta"], ["alpha", "alpha", "beta"], ["gamma"]):
        want = {i: s for i, w in places.items() if (s := [p for p in range(len(w)) if w[p : p + len(phrase)] == phrase])}
        assert {r.key: r.starts for r in index.phrase(*phrase).collect()} == want
    plan = index.postings(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,alpha)" in plan
    files = {r[0].split("bucket=")[1].split("/")[0] for r in index.postings(["alpha", "beta"]).select(F.input_file_name()).collect()}
    assert len(files) <= 2
    with pytest.raises(Exception, match="exist"):
        I.WordIndex.build(docs, str(tmp_path / "w"), buckets=16)
    with pytest.raises(FileNotFoundError):
        I.opened(spark, str(tmp_path / "none"), I.WordIndex)


def test_substring_index(spark, tmp_path, texts):
    docs = spark.createDataFrame([*texts.items(), (100, "ab"), (101, "a\nbc"), (102, "x" * 50_000 + "needle")], "doc_id long, text string")
    index = I.SubstringIndex.build(docs, str(tmp_path / "s"), "doc_id", "text", buckets=16)
    every = [tuple(r) for r in docs.collect()]
    for part in ("PHA be", "alphabet gam", "ab", "a", "a\nb", "xneed", "É a", "zzz", "", "alpha beta gamma alpha alpha"):
        assert sorted(r.key for r in index.contains(part).collect()) == [i for i, t in every if t is not None and part.lower() in t.lower()], part


def many_files(spark, tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.txt").write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    return str(tmp_path)


@pytest.fixture
def small_ranges(spark):
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_large_files_equal_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdé", k=draw.randint(1, 9)))
    pieces = ["{".join(draw.choice(["", "\n", word() + "\n" + word()]) for _ in range(300)) for _ in range(2)] + ["no mark", "{"]
    path = many_files(spark, tmp_path, pieces)
    whole = spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(pieces)], "name string, text string")
    assert spark.read.option("lineSep", "{").text(path).rdd.getNumPartitions() > 2
    assert rows_of(L.file_documents(spark, path)) == rows_of(R.split_documents(whole, "name"))
    got = rows_of(L.marked(spark, path).select("name", "ord", "text"))
    assert got == sorted((f"f{i}.txt", k, x) for i, t in enumerate(pieces) for k, x in enumerate(t.removesuffix("\n").split("\n")))
    assert rows_of(L.file_records(spark, path, 3)) == sorted((f"f{i}.txt", k, [*x[3 * k : 3 * k + 3]]) for i, t in enumerate(pieces) for x in [t.removesuffix("\n").split("\n")] for k in range(len(x) // 3))


def test_large_sgml_equals_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(5)
    body = lambda: "text " * draw.randint(1, 60) + draw.choice(["Reuter end", "", "\n< a"])
    item = lambda i: draw.choice([f"<TITLE>Title {i}</TITLE>\n<BODY>{body()}</BODY>", f"<DOC><TITLE>T{i}</TITLE> no body", f"<BODY>{body()}</BODY>", "junk\n"])
    texts = ["\n".join(item(i) for i in range(40)) for _ in range(3)] + ["<BODY>open"]
    path = many_files(spark, tmp_path, texts)
    whole = spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(texts)], "name string, text string")
    want = rows_of(R.split_sgml(whole, "name"))
    assert rows_of(L.file_sgml(spark, path)) == want and len(want) > 20


def test_postings_are_made_where_the_document_is(spark, tmp_path, monkeypatch):
    """A document's postings need no shuffle before the one that orders them, and are the same however many documents go together."""
    texts = [(1, "b A a é a$ 9 b"), (2, None), (3, ""), (7, "! ?"), (8, " ".join(f"w{i % 7}" for i in range(500))), (9, "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = {}
    for d, text in texts:
        for i, w in enumerate(re.findall("[$a-zA-Z0-9]+", text or "")):
            want.setdefault((w.lower(), d), []).append(i)
    write, plans = I._write, []
    monkeypatch.setattr(I, "_write", lambda p, *a: (plans.append(p._jdf.queryExecution().executedPlan().toString()), write(p, *a)))
    index = I.WordIndex.build(docs, str(tmp_path / "w"), buckets=4)
    rows = index.postings([w for w, _ in want]).collect()
    assert len(rows) == len(want) and {(r.term, r.key): r.positions for r in rows} == want
    assert len(plans) == 1 and "hashpartitioning" not in plans[0]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts]), pa.array([[w.lower() for w in re.findall("[$a-zA-Z0-9]+", t or "")] for _, t in texts])], ["key", "words"])
    for together in (1_000_000, 4, 1):
        monkeypatch.setattr(I, "TOGETHER", together)
        for part in (batch, batch.slice(3)):
            made = pa.Table.from_batches([*I._places_in_documents([part])]).to_pylist()
            assert {(r["term"], r["key"]): r["positions"] for r in made} == {k: v for k, v in want.items() if k[1] in part.column(0).to_pylist()}
