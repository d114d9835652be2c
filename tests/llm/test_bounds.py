"""What bounds of samples and audits must not hide."""

import random

import numpy as np
import pytest

from corpusloom.llm import mixing as M
from corpusloom.llm import secrets as S
from corpusloom.llm import term_pairs as P
from corpusloom.llm import toxicity as T
from corpusloom.llm import vector_graph as V


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def area(y, s):
    return (s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean()


def test_a_pair_of_rare_words_is_found(spark):
    """Toxic is exactly one of two words, each rarer than 1,200 other words."""
    rng = np.random.default_rng(4)
    rows, known = [], []
    for i in range(3500):
        a, b = (bool(x) for x in rng.random(2) < 0.1)
        rows.append(" ".join([f"w{j}q" for j in np.flatnonzero(rng.random(1200) < 0.15)] + ["alpha"] * a + ["omega"] * b))
        known.append((i, 1, int(a != b)))
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(texts(spark, rows), labels).filter("held_out").join(labels, "doc_id").toPandas()
    assert area(got.toxic.to_numpy() == 1, got.score.to_numpy()) > 0.95


def brute_pairs(y, terms, buckets, least):
    """By contingency tables of every pair."""
    n = len(y)
    x = np.zeros((n, buckets), bool)
    for r, t in enumerate(terms):
        x[r, t] = True

    def told(cells):
        g = 0.0
        for rows in cells:
            for c in (0, 1):
                k = ((y == c) & rows).sum()
                if k:
                    g += 2 * k * np.log(k * n / (rows.sum() * (y == c).sum()))
        return g

    alone = [told([x[:, j], ~x[:, j]]) for j in range(buckets)]
    found = set()
    for a in range(buckets):
        for b in range(a):
            both = told([x[:, a] & x[:, b], x[:, a] & ~x[:, b], ~x[:, a] & x[:, b], ~x[:, a] & ~x[:, b]])
            if (x[:, a] & x[:, b]).sum() >= P.TOGETHER and both - alone[a] - alone[b] >= least:
                found |= {a, b}
    return sorted(found)


@pytest.mark.parametrize("least", [8.0, 15.0, 100.0])
def test_pairs_equal_brute_force(spark, least):
    rng = np.random.default_rng(2)
    terms = [np.flatnonzero(rng.random(30) < np.linspace(0.02, 0.6, 30)) for _ in range(400)]
    y = np.array([(3 in t) != (5 in t) if rng.random() < 0.9 else rng.random() < 0.5 for t in terms]).astype(int)
    assert P.telling_pairs(y, [rng.permutation(t) for t in terms], 30, least).tolist() == brute_pairs(y, terms, 30, least)
    assert P.telling_pairs(y, terms, 30, least, most_pairs=0).tolist() == [] and P.telling_pairs(y[:0], [], 30, least).tolist() == []


def test_fewer_terms_than_tasks(spark):
    """Two terms that are toxic apart and not together."""
    rng = np.random.default_rng(9)
    terms = [np.flatnonzero(rng.random(2) < 0.5) for _ in range(400)]
    y = np.array([len(t) == 1 for t in terms]).astype(int)
    assert P.telling_pairs(y, terms, 2, 100.0).tolist() == [0, 1] and P.telling_pairs(y, [t[:0] for t in terms], 2, 100.0).tolist() == []


def test_margin_is_the_sum_over_all_pairs():
    """The machine's margin by its definition: bias, weights, and inner products of all pairs of a row's terms."""
    rng = np.random.default_rng(3)
    terms = [np.flatnonzero(rng.random(40) < 0.2) for _ in range(300)]
    y = np.array([float(1 in t and 2 in t) for t in terms])
    m = T.fit_machine(y, terms, epochs=3)
    assert (m.pick >= 0).any()
    rows = [m.pick[t][m.pick[t] >= 0] for t in terms]
    got = m.margins(len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows))
    want = [m.bias + sum(m.weight[a] for a in r) + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_a_value_that_does_not_fit_is_passed_over(spark, monkeypatch):
    rng = random.Random(5)
    value = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    rows = [f"commit {value(40)} done" for _ in range(30)]
    alone = S.learn_formats(texts(spark, rows).select("text"))
    for _ in range(3):
        with_long = S.learn_formats(texts(spark, [*rows, f"blob {value(S.CHARACTERS + 10_000)}"]).select("text"))
        assert len(alone.kinds) == len(with_long.kinds) == 1
    monkeypatch.setattr(S, "CHARACTERS", 400)
    assert len(S.learn_formats(texts(spark, rows).select("text")).kinds) == 1


def test_audit_hears_rare_links(spark, monkeypatch):
    """Few vectors link: those that a search finds are audited, and the search is widened."""
    monkeypatch.setattr(V, "AUDITED", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x[[1, 3]] = x[[0, 2]] + 0.001
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    turns, whole = [], V._search_all
    monkeypatch.setattr(V, "_search_all", lambda *a: turns.append(a[2]) or whole(*a))
    got = V.vector_groups(df).toPandas()
    assert sorted(got.vec_id[got.n_links > 0]) == [0, 1, 2, 3] and set(got.audit_recall) == {1.0} and len(turns) == 2
    turns.clear()
    assert V.vector_groups(df.filter("vec_id > 3")).first().audit_recall is None and len(turns) == 3


def test_rows_without_ids_spread_over_blocks(spark):
    rows = [(None, f"text number {i} of a source", "a") for i in range(900)] + [(7, f"same id {i}", "a") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = M.plan_mix(docs, budget=0.5)
    assert mix.draws.count() > mix.blocks / 4
    first, again = (sorted(r.text for r in M.mixed(docs.repartition(k), budget=0.5).collect()) for k in (1, 5))
    assert first == again and 400 < len(first) < 500
