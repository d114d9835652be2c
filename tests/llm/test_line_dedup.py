"""Reversible line dedup against its definition, and the cuckoo filter by itself."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup as L
from corpusloom.llm.shared import fresh_path

SHAPE = "doc_id long, text string"
WHITE = " \t\n\x0b\x0c\r"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def key(line):
    return lower(line.strip(WHITE))


def by_definition(rows, shortest=20, least=3):
    """(doc_id, text, n_lines, n_dropped) of each row: lines in `least` documents stay in the largest only."""
    inside = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= shortest:
                    inside[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(inside[key(x)]) < least or i == max(inside[key(x)])]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(seed, ids):
    draw = random.Random(seed)
    shared = [f"  A line that many documents Share, number {i} é{'x' * (i % 3)}" for i in range(40)] + ["short", "", "exactly twenty chars", "only nineteen chars", "é" * 20, "é" * 19]
    line = lambda i: draw.choice(shared) + draw.choice(["", " ", "\t\r"]) if draw.random() < 0.7 else f"a line of document {i} alone {draw.random()}"
    return [(i, "\n".join(line(i) for _ in range(draw.randint(0, 9)))) for i in ids]


@pytest.mark.parametrize("least, shortest", [(3, 20), (2, 1)])
def test_equals_its_definition(spark, least, shortest):
    rows = some_rows(1, range(60))
    assert rows_of(L.line_dedup(spark.createDataFrame(rows, SHAPE), shortest, least)) == by_definition(rows, shortest, least)


def filters_hold(spark, index, rows):
    """All repeated keys pass the filters, and the filters' counts are the number of repeated keys."""
    keys = index.keys(spark.createDataFrame(rows, SHAPE)).distinct()
    repeated = {bytes(r.digest) for r in index.counts().filter(F.col("documents") >= index.least).collect()}
    passed = {bytes(r.digest) for r in index.hits(keys).collect()}
    assert repeated & {bytes(r.digest) for r in keys.collect()} <= passed
    assert (index.filters().agg(F.sum("n")).first()[0] or 0) == len(repeated)


def test_insertions_and_deletions_are_reversible(spark):
    a, b, c = some_rows(2, range(0, 40)), some_rows(3, range(40, 80)), some_rows(4, range(80, 100))
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    index = L.LineIndex(spark, fresh_path(spark, "index"))
    index.add(frame(a))
    alone, counts = rows_of(index.kept(frame(a))), rows_of(index.counts())
    assert alone == by_definition(a)
    index.add(frame(b))
    index.add(frame(c))
    assert rows_of(index.kept(frame(a + b + c))) == by_definition(a + b + c)
    filters_hold(spark, index, a + b + c)
    index.remove(frame(c).select("doc_id"))
    assert rows_of(index.kept(frame(a + b))) == by_definition(a + b)
    filters_hold(spark, index, a + b + c)
    index = L.LineIndex(spark, index.path)  # as another run opens it
    index.remove(spark.createDataFrame([(i,) for i in range(40, 80)] + [(None,), (5000,)], "doc_id long"))
    assert rows_of(index.counts()) == counts and rows_of(index.kept(frame(a))) == alone
    filters_hold(spark, index, a + b + c)
    index.remove(frame(a).select("doc_id"))
    assert index.counts().isEmpty() and index.filters().agg(F.sum("n")).first()[0] == 0
    index.add(frame(a))
    assert rows_of(index.counts()) == counts and rows_of(index.kept(frame(a))) == alone


def test_shards_grow_and_full_filters_are_made_anew(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    monkeypatch.setattr(L, "PROBED", 16)
    index, rows = L.LineIndex(spark, fresh_path(spark, "index")), []
    for step in range(4):
        more = [(step * 10 + i, "\n".join(f"line {j} of step {step} in many documents" for j in range(4 * 3**step))) for i in range(3)]
        rows += more
        index.add(spark.createDataFrame(more, SHAPE))
    assert index.shards >= 4
    assert rows_of(index.kept(spark.createDataFrame(rows, SHAPE))) == by_definition(rows)
    filters_hold(spark, index, rows)


def test_a_batch_that_failed_is_not_read(spark, monkeypatch):
    rows = some_rows(6, range(30))
    index = L.LineIndex(spark, fresh_path(spark, "index"))
    index.add(spark.createDataFrame(rows, SHAPE))
    monkeypatch.setattr(L.LineIndex, "filters", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(spark.createDataFrame(some_rows(7, range(30, 60)), SHAPE))
    monkeypatch.undo()
    assert rows_of(L.LineIndex(spark, index.path).kept(spark.createDataFrame(rows, SHAPE))) == by_definition(rows)


def test_any_table(spark):
    """Null ids and texts, repeated rows, a very long text, extra columns of clashing names, no rows."""
    line, long = "a line that is in many of the documents", "\n".join(f"line {i} of a very long document" for i in range(30_000))
    rows = [(None, None), (None, line), (None, line), (1, None), (1, ""), (2, line), (2, line), (3, f"{line}\nx"), (4, long), (5, long), (6, long + "\n" + line), (7, "é" * 100_000), (8, "\n" * 1000)]
    docs = spark.createDataFrame(rows, SHAPE)
    want = by_definition(rows)
    assert rows_of(L.line_dedup(docs)) == want
    clashes = "digest shard part filter n digests copy parts documents last delta was now n_lines n_dropped a.b tick`ed".split()
    assert rows_of(L.line_dedup(docs.select("*", *(F.lit("x").alias(c) for c in clashes)))) == want
    assert L.line_dedup(docs.limit(0)).count() == 0
    assert rows_of(L.line_dedup(docs.filter("text is null"))) == by_definition([r for r in rows if r[1] is None])
    index = L.LineIndex(spark, fresh_path(spark, "index"))
    assert rows_of(index.kept(docs)) == sorted(((i, t or "", (t or "").count("\n") + 1, 0) for i, t in rows), key=str)  # an index of nothing


@pytest.mark.parametrize("n", [0, 1, 3, 4, 1000, 60_000])
def test_cuckoo_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (n + 20_000, 2)).astype(np.uint64)
    inside, others = keys[:n], keys[n:]
    f = L.CuckooFilter.build(inside)
    assert f.contains(inside).all() and f.n == n and (f.table > 0).sum() == n
    assert f.contains(others).sum() <= 20
    f = L.CuckooFilter.from_bytes(f.to_bytes(), f.n)
    f.delete(inside[: n // 2])
    assert f.contains(inside[n // 2 :]).all() and (f.table > 0).sum() == n - n // 2 == f.n
    assert f.insert(inside[: n // 2]) and f.contains(inside).all()
    f.delete(inside)
    assert f.n == 0 and not f.table.any()
    with pytest.raises(ValueError):
        f.delete(others[:1])
    if n:
        assert not L.CuckooFilter(np.zeros((1, 4), np.uint16), 0).insert(np.arange(20, dtype=np.uint64).reshape(10, 2))
