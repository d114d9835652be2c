"""The tag model: best paths against all paths, scores against counts, and names that the list lacks."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import entities as E
from corpusloom.operators import tagger as G


@pytest.mark.parametrize("seed", range(4))
def test_best_paths_equal_all_paths(seed):
    rng = np.random.default_rng(seed)
    start, steps = rng.normal(size=3), rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) for n in (4, 0, 1, 6, 4, 2)]
    for s, path in zip(scores, G.best_paths(scores, start, steps), strict=True):
        total = lambda p: sum(s[i, x] + (steps[p[i - 1], x] if i else start[x]) for i, x in enumerate(p))  # noqa: B023, E731
        assert len(path) == len(s) and (not len(s) or math.isclose(total(path), max(map(total, itertools.product(range(3), repeat=len(s))))))
    assert G.best_paths([], start, steps) == []


def test_model_is_made_of_counts(spark):
    rows = [(d, p, t, x) for d, line in enumerate([[("in", -1), ("Seoul", 2), ("and", -1)], [("Kim", 1), ("Kim", 1)], [("IBM", 3)], [("Seoul", -1)]]) for p, (t, x) in enumerate(line)]
    m = G.learn(spark.createDataFrame(rows, "doc_id long, pos long, token string, label int"))
    steps, n = Counter(), [x for *_, x in rows]
    for d in range(4):
        labels = [None, *(x for e, _, _, x in rows if e == d)]
        steps.update(zip(labels, labels[1:], strict=False))
    for i, a in enumerate([*G.LABELS, None]):
        row = np.array([steps[a, b] + G.STEP for b in G.LABELS])
        np.testing.assert_allclose(m.start if a is None else m.steps[i], np.log(row / row.sum()))
    shapes = Counter((("lower" if t.islower() else "upper" if t.isupper() else "capital"), x) for *_, t, x in rows)
    kinds = {"lower": 3, "capital": 3, "upper": 2, "mixed": 1}
    score = lambda t, s, x: math.log((sum(u == t and y == x for *_, u, y in rows) + G.BACK_OFF * (shapes[s, x] + 0.5) / (n.count(x) + 2) / kinds[s]) / (n.count(x) + G.BACK_OFF))
    got = {r.token: r.scores for r in m.words.collect()}
    for t, s in (("in", "lower"), ("Seoul", "capital"), ("Kim", "capital"), ("IBM", "upper")):
        np.testing.assert_allclose(got[t], [score(t, s, x) for x in G.LABELS])
    np.testing.assert_allclose(m.shapes, [[score("?", s, x) for x in G.LABELS] for s in G.SHAPES])


def test_names_that_the_list_lacks(spark):
    """Half of the names are listed; the others are found by shape and neighbours."""
    draw = random.Random(1)
    people, places = ([f"{a}{b}{c}" for b in "aeiou" for c in ("lan", "ron", "mik", "tes")] for a in ("K", "S"))
    words = [f"w{''.join(draw.choices('abcde', k=4))}" for _ in range(60)]
    rows, truth = [], {}
    for d in range(300):
        line = []
        for _ in range(12):
            line += [(w, -1) for w in draw.choices(words, k=3)]
            line += [(draw.choice(people), 1) for _ in range(2)] if draw.random() < 0.5 else [(draw.choice(places), 2)]
        rows.append((d, " ".join(t for t, _ in line)))
        truth |= {(d, p): x for p, (_, x) in enumerate(line)}
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "12 !")], "doc_id long, text string")
    listed = spark.createDataFrame([(t, "person") for t in people[::2]] + [(t, "Location") for t in places[::2]], "token string, type string")
    got = {(r.doc_id, r.pos): r.label for r in G.tag(docs, G.learn(G.unsure(E.annotate_listed(docs, listed)))).collect()}
    assert set(got) == set(truth)
    hit = sum(x >= 0 and truth[k] >= 0 for k, x in got.items())
    f1 = 2 * hit / (sum(x >= 0 for x in got.values()) + sum(x >= 0 for x in truth.values()))
    by_list = {*people[::2], *places[::2]}
    lines = {(d, p): t for d, text in rows for p, t in enumerate(text.split())}
    of_list = [got[k] == truth[k] for k, t in lines.items() if t in by_list]
    assert f1 > 0.95 and np.mean(of_list) > 0.95


def test_documents_stay_where_they_are(spark, sf):
    """Arrays give what rows give, with a vocabulary of known size, for which no token is dealt out, and with one beyond it."""
    from corpusloom.plans import corpus

    docs = corpus.docs_of(spark, sf).unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 !")], "doc_id long, text string"))
    names = spark.createDataFrame([("The", "person"), ("In", "location"), ("the", "ORGANIZATION"), ("In", "person")], "token string, type string")
    old = G.unsure(E.annotate_listed(docs, names))
    rows = lambda d, label: sorted(map(tuple, d.select("doc_id", F.posexplode(F.arrays_zip("words", label)).alias("pos", "x")).select("doc_id", "pos", "x.*").collect()), key=str)
    want = sorted(map(tuple, old.select("doc_id", "pos", "token", "label").collect()), key=str)
    for most in (G.MOST_SENT, 0):
        assert rows(G.listed_labels(G.word_lists(docs), names, most=most), "labels") == want
    one, two = G.learn(old), G.learn_lists(G.listed_labels(G.word_lists(docs), names))
    np.testing.assert_array_equal(one.steps, two.steps)
    np.testing.assert_array_equal(one.shapes, two.shapes)
    assert sorted(map(tuple, one.words.collect()), key=str) == sorted(map(tuple, two.words.collect()), key=str)
    tagged = G.tag_lists(docs, two)
    assert "Exchange" not in tagged._jdf.queryExecution().executedPlan().toString()
    assert rows(tagged, "labels") == rows(G.tag_lists(docs, two, most=0), "labels")
    together, G.TOGETHER = G.TOGETHER, 50
    try:
        assert rows(tagged, "labels") == rows(G.tag_lists(docs, two), "labels")
    finally:
        G.TOGETHER = together
