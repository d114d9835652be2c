"""The distributed sampler of all models: a part's sweep is that of its documents one after another, runs go on where they stopped, and configurations share a plan."""

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import samplers as S
from corpusloom.plans import catalog
from corpusloom.sources.shared import fresh_path

MODELS = ["lda", "entity_1", "entity_2", "entity_3", "event"]
SEEN = ("pos", "word", "cell", "held", "ents", "times", "events")


def some_documents(chain, seed=3):
    """Documents of several lengths, without entities, with one, and with many."""
    rng, rows = np.random.default_rng(seed), []
    for d, (n, e) in enumerate([(30, 2), (1, 0), (12, 1), (30, 3), (7, 0), (25, 2), (0, 1)]):
        ents = np.sort(rng.choice(5, e, replace=False)) + 10
        rows.append({"config": 0, "part": 0, "doc_id": d, "pos": np.arange(n) * 2, "word": rng.integers(6, size=n), "cell": [], "held": [], "ents": ents, "times": rng.integers(1, 4, size=e), "events": []})
    return S._Part(chain, pd.DataFrame(rows), 0).start()


def counts_of(chain, docs):
    (k_d, k_e), wide = chain.widths(), chain.topics if chain.model == "event" else max(1, chain.widths()[1])
    words, entities = np.zeros((6, k_d + k_e)), np.zeros((20, wide))
    for r in docs.itertuples():
        for w, c, e in zip(r.word, r.cell, r.held, strict=True):
            words[w, c] += 1
            if e >= 0 and chain.model != "event":
                entities[e, c - k_d] += 1
        for e, z in zip(np.repeat(r.ents, r.times), r.events, strict=False):
            entities[e, z] += 1
    return words, entities


def one_by_one(chain, docs, words, entities, sweep):
    """Each document's tokens one after another, with scalar formulas."""
    c, (k_d, k_e), out = chain, chain.widths(), {}
    size, v, event_size = words.sum(0), 6, entities.sum(0)
    for r in docs.itertuples():
        part = S._Part(chain, docs[docs.doc_id == r.doc_id], sweep)
        u, u_mention = part.uniforms()
        cell, held, mine = list(r.cell), list(r.held), {e: entities[e].copy() for e in r.ents}
        own = [sum(x == k for x in cell) for k in range(k_d)]
        switch = [sum(x < k_d for x in cell), sum(x >= k_d for x in cell)]
        for i, w in enumerate(r.word):
            seen = words[w].copy()
            seen[cell[i]] -= 1
            if cell[i] < k_d:
                own[cell[i]] -= 1
                switch[0] -= 1
            else:
                mine[held[i]][cell[i] - k_d] -= 1
                switch[1] -= 1
            weights, what = [], []
            for k in range(k_d):
                x = (seen[k] + c.beta) / (size[k] + v * c.beta) * (own[k] + c.alpha)
                if c.model.startswith("entity"):
                    x = x / (sum(own) + k_d * c.alpha) * (switch[0] + c.eta_d if c.model != "entity_1" else 1)
                weights.append(x)
                what.append((k, -1))
            prior, beta = (c.alpha_e, c.beta_e) if c.model == "entity_3" else (c.gamma, c.beta)
            for e, times in zip(r.ents, r.times, strict=True) if c.model.startswith("entity") else ():
                for k in range(k_e):
                    x = (seen[k_d + k] + beta) / (size[k_d + k] + v * beta) * (mine[e][k] + prior) / (mine[e].sum() + k_e * prior) * times / r.times.sum()
                    weights.append(x * (switch[1] + c.eta_e if c.model != "entity_1" else 1))
                    what.append((k_d + k, e))
            cell[i], held[i] = what[S.draw(np.array(weights), u[i])]
            if cell[i] < k_d:
                own[cell[i]] += 1
                switch[0] += 1
            else:
                mine[held[i]][cell[i] - k_d] += 1
                switch[1] += 1
        events = list(r.events)
        own = [events.count(k) for k in range(k_d)]
        for j, e in enumerate(np.repeat(r.ents, r.times) if c.model == "event" else ()):
            z = events[j]
            own[z] -= 1
            one = np.eye(k_d)[z]
            events[j] = S.draw((entities[e] - one + c.gamma) / (event_size - one + 3 * c.gamma) * (np.array(own) + c.alpha), u_mention[j])
            own[events[j]] += 1
        out[r.doc_id] = cell, held, events
    return out


@pytest.mark.parametrize("hashed", [False, True])
@pytest.mark.parametrize("model", MODELS)
def test_a_part_is_swept_as_its_documents_one_by_one(model, hashed):
    chain = S.Chain(model, topics=3, entity_topics=4, seed=7, hashed=hashed)
    docs = some_documents(chain)
    words, entities = counts_of(chain, docs)
    (k_d, k_e), ids = chain.widths(), np.arange(20)
    got = pd.concat([S._Part(chain, d, 1).sweep_all(np.arange(6), words, ids, entities, (words.sum(0), 6, entities.sum(0), 3)) for d in S._groups(docs)])
    want = one_by_one(chain, docs, words, entities, 1)
    assert (np.concatenate(got.sort_values("doc_id").cell.to_list()) != np.concatenate(docs.sort_values("doc_id").cell.to_list())).any()
    for r in got.itertuples():
        cell, held, events = want[r.doc_id]
        assert list(r.cell) == cell and list(r.held) == held and list(r.events) == events
        assert all((c >= k_d) == (h in r.ents) for c, h in zip(r.cell, r.held, strict=True)) and len(r.pos) == len(r.cell)


def corpus(spark):
    """Two kinds of documents with words of their own."""
    toks = spark.createDataFrame([(d, p, p * 7 % 5 + 5 * (d % 2)) for d in range(30) for p in range(20 if d else 200)], "doc_id long, pos long, word_id long")
    entities = spark.createDataFrame([(d, 1, d % 2 + 10, 2) for d in range(30) if d != 3] + [(99, 1, 10, 1)], "doc_id long, rank long, entity_id long, cnt long")
    return toks, entities


@pytest.mark.parametrize("model", MODELS)
def test_distributed_chain(spark, model):
    toks, entities = corpus(spark)
    rows = S.distributed(toks, entities, S.Chain(model, topics=2, entity_topics=3, burn_in=12, lag=2, samples=2, seed=2)).collect()
    assert sorted((r.iter, r.doc_id, r.pos, r.word_id) for r in rows) == sorted((it, *t) for it in (12, 14) for t in toks.collect())
    for r in rows:
        assert (r.entity_id == r.doc_id % 2 + 10 and r.doc_id != 3 and r.z < 3) if r.s else (r.entity_id == -1 and r.z < 2)
    if model in ("lda", "event"):
        table = np.zeros((2, 2))
        for r in rows:
            table[r.doc_id % 2, r.z] += 1
        assert table.max(1).sum() / table.sum() > 0.9 and table[0].argmax() != table[1].argmax()


def test_a_stopped_run_goes_on_and_ends_with_the_same_rows(spark, monkeypatch):
    toks, entities = corpus(spark)
    chain, rows_of = S.Chain("entity_2", topics=2, entity_topics=2, burn_in=3, lag=2, samples=2, seed=5), lambda df: sorted(map(tuple, df.collect()))
    whole = rows_of(S.distributed(toks, entities, chain))
    out, counted, made = fresh_path(spark, "run"), S._counted, []

    def stops(*a):
        made.append(1)
        if len(made) == 4:
            raise RuntimeError("stopped")
        return counted(*a)

    monkeypatch.setattr(S, "_counted", stops)
    with pytest.raises(RuntimeError):
        S.distributed(toks, entities, chain, out)
    assert rows_of(S.distributed(toks, entities, chain, out)) == whole and len(made) == 6  # sweeps 4 and 5 alone are made again
    assert rows_of(S.distributed(toks, entities, chain, out)) == whole and len(made) == 6


def test_configurations_share_a_plan(spark):
    toks, entities = corpus(spark)
    chains = [S.Chain("lda", topics=2, burn_in=2, lag=1, samples=1, seed=1), S.Chain("entity_1", topics=3, entity_topics=2, burn_in=1, lag=2, samples=2, seed=2), S.Chain("event", topics=4, burn_in=1, lag=1, samples=1, seed=3)]
    together = S.distributed_grid(toks, entities, chains).collect()
    for i, chain in enumerate(chains):
        assert sorted(tuple(r)[1:] for r in together if r.config == i) == sorted(map(tuple, S.distributed(toks, entities, chain).collect()))


@pytest.mark.parametrize("name", ["gibbs_entity_v1", "gibbs_event"])
def test_registered_over_documents(spark, tmp_path, name):
    texts = ["Seoul opens the market in Seoul", "the market of Paris opens", "Paris and the market", "a long market opens the market"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3} and {r.iter for r in rows} == {10, 15}


def test_long_documents_lie_together(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_TOKENS", 4_000)
    docs = spark.range(2000).selectExpr("id AS doc_id", "sequence(1L, CASE WHEN id % 100 = 0 THEN 1000 ELSE 10 END) AS pos", "CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END AS e")
    dealt, parts = S._dealt(docs, S.F.size("pos"), S.F.col("e"))
    rows = dealt.groupBy("part").agg(S.F.max(S.F.size("pos")).alias("longest"), S.F.sum(S.F.size("pos")).alias("n")).collect()
    assert 10 < parts < 40 and all(0 <= r.part < parts for r in rows) and sum(r.n for r in rows) == 20 * 1000 + 1980 * 10
    assert sum(r.longest > 10 for r in rows) <= 10 and max(r.n for r in rows) < 12_000


@pytest.mark.parametrize("model", MODELS)
def test_a_part_counts_its_own_tokens(model):
    chain = S.Chain(model, topics=3, entity_topics=4, seed=7)
    docs = some_documents(chain)
    words, entities = counts_of(chain, docs)
    counts = S._with_counts(chain, sum(chain.widths()), docs).dropna(subset=["kind"])
    for kind, want in ((0, words), (1, entities)):
        for r in counts[counts.kind == kind].itertuples():
            for i, n in zip(r.ids, r.n, strict=True):
                assert list(n[: want.shape[1]]) == list(want[i])
    assert sum(np.sum(n) for k, ns in zip(counts.kind, counts.n, strict=True) if k == 0 for n in ns) == 105
