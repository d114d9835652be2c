"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import spelling as S

SHAPE = "doc_id long, text string"


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(rows, least=6, count=5, period=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % period == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_definition(n, ratio=5):
    found = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) if xs else None for w, xs in found.items()}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] is not None else None) for w in n), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters, longest", [("ab", 5), ("abÿ", 4), ("aÀ", 9)])
def test_variants_equal_all_pairs(spark, letters, longest):
    draw = random.Random(letters)
    n = {"".join(draw.choices(letters, k=draw.randint(1, longest))): draw.choice([1, 1, 2, 5, 9, 25, 130, 700]) for _ in range(150)}
    assert rows_of(S.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == by_definition(n)


def test_documents_equal_all_pairs(spark):
    """A small period, so that many words lose a code point."""
    draw = random.Random(3)
    known = ["committee", "comittee", "Committee", "necessary", "neccessary", "separate", "seperate", "Ärzte", "größer", "grösser", "abcdef", "abcdeg", "a×÷b÷×", "short"]
    rows = [(i if i % 7 else None, " ".join(draw.choices(known, weights=[40, 2, 9, 30, 2, 50, 3, 9, 30, 2, 9, 2, 3, 9], k=60)) + ", x1y2") for i in range(60)]
    docs = spark.createDataFrame(rows, SHAPE)
    for period in (199, 3):
        n = words(rows, period=period)
        assert rows_of(S.vocabulary(docs, period=period)) == sorted(n.items(), key=str)
        assert rows_of(S.spelling_variants(docs, period=period)) == by_definition(n)


def test_chains_have_their_last_form_as_root(spark):
    chain = {("a" * i + "b" * (40 - i)): 6**i for i in range(12)}
    got = {r.word: r.root for r in S.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 11 + "b" * 29}


def test_very_long_words(spark):
    """Rows grow with a word's length, not with its square; words longer than a piece and than the kept powers."""
    a = "".join(random.Random(1).choices("abcdefgh", k=150_000))
    n = {a: 50, a[:70_000] + "z" + a[70_001:]: 9, a[:-1]: 8, "q" + a: 7, a[:65_536] + a[65_537:]: 6, "other": 50}
    got = {r.word: (r.form, r.n_near) for r in S.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got.pop(a) == (None, 4) and got.pop("other") == (None, 0) and set(got.values()) == {(a, 1)}


def test_any_table(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, clashing names, no rows, counts sent on early."""
    rows = [(None, None), (1, None), (2, ""), (3, "again " * 300_000 + "agains" * 3), (4, "letter letter"), (4, "letter letter"), (None, "letter LETTER"), (5, "lettér " * 7), (6, "123 !? " * 9)]
    docs = spark.createDataFrame(rows, SHAPE)
    want = by_definition(words(rows))
    assert rows_of(S.spelling_variants(docs)) == want and len(want) == 2
    clashes = "word n rank kind place k1 k2 wild size top next met longer near best form root n_near form_n a.b tick`ed".split()
    assert rows_of(S.spelling_variants(docs.select("*", *(F.lit("x").alias(c) for c in clashes)))) == want
    assert S.spelling_variants(docs.limit(0)).count() == 0
    assert rows_of(S.variants(spark.createDataFrame([(None, 3), ("", 9), ("ab", 1)], "word string, n long"))) == [("ab", None, "ab", 1, 0, None)]
    with pytest.raises(ValueError):
        S.variants(S.vocabulary(docs), ratio=1)
