"""Chains over documents as arrays: what is sent and what is shuffled give the same rows, and nothing of a document is left out."""

import numpy as np
import pytest

from corpusloom.operators import corpus as C
from corpusloom.operators import documents as D
from corpusloom.operators import entities as E
from corpusloom.operators import samplers as S
from corpusloom.plans import models
from corpusloom.sources.shared import written

TEXTS = ["Seoul opens the market in Seoul", "", "Paris and the market, Paris and Rome, Oslo then Lima then Cairo then Quito", None, "a long market opens the market", "Rome Rome or Oslo", "zzz"]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def rows_of(docs):
    return sorted((r.doc_id, list(r.pos), list(r.word), list(r.ents), list(r.times)) for r in docs.collect())


@pytest.mark.parametrize("most", [2, None])
def test_documents_are_the_same_sent_or_dealt_out(spark, most):
    docs = texts(spark)
    vocab = written(C.vocabulary(C.text_counts(docs), 2, 0), "vocabulary")
    mentions = E.mentions_in(E.mention_lists(docs))
    entities = written(E.entity_set(mentions, 1), "entities")
    want = rows_of(S.packed(C.encode(C.tokens(docs), vocab), E.document_entities(mentions, entities, most)))
    assert rows_of(D.listed(docs, vocab, entities, most)) == rows_of(D.listed(docs, vocab, entities, most, sent=0)) == want
    assert rows_of(D.listed(docs, vocab)) == rows_of(S.packed(C.encode(C.tokens(docs), vocab), None))
    assert max(len(r[3]) for r in want) == (most or 5)


def corpus(spark):
    toks = spark.createDataFrame([(d, p * 3, p * 7 % 5 + 5 * (d % 2) + 1000 * (p == 3) * d) for d in range(40) for p in range(d % 9 + 1)], "doc_id long, pos long, word_id long")
    entities = spark.createDataFrame([(d, r, 10 + d % 3 + r * (d + 5), r) for d in range(40) if d % 4 for r in (1, 2, 3)], "doc_id long, rank long, entity_id long, cnt long")
    return toks, entities


@pytest.mark.parametrize("model", ["lda", "entity_3", "event"])
def test_counts_are_the_same_sent_or_shuffled_and_however_parts_are_cut(spark, monkeypatch, model):
    chain, rows = S.Chain(model, topics=3, entity_topics=2, burn_in=2, lag=1, samples=2, seed=4), lambda df: sorted(map(tuple, df.collect()))
    whole = rows(S.distributed(*corpus(spark), chain))
    monkeypatch.setattr(S, "PART_TOKENS", 200)  # words and entities of one part only, and of several
    many = rows(S.distributed(*corpus(spark), chain))
    monkeypatch.setattr(S, "MOST_SENT", 0)
    assert rows(S.distributed(*corpus(spark), chain)) == many == whole


def test_counts_of_the_corpus_come_from_all_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_TOKENS", 200)
    toks, entities = corpus(spark)
    chain, seen, counted = S.Chain("event", topics=3, burn_in=3, lag=1, samples=1, seed=4), [], S._counted

    def kept(now, chains):
        found = counted(now, chains)
        seen.append((now.agg(S.F.max("part")).first()[0], found[2][0]))
        return found

    monkeypatch.setattr(S, "_counted", kept)
    S.distributed(toks, entities, chain)
    assert len(seen) == 3 and seen[0][0] > 3
    for _, (words, v, mentions, n) in seen:
        assert words.sum() == toks.count() and v == toks.select("word_id").distinct().count()
        assert mentions.sum() == entities.agg(S.F.sum("cnt")).first()[0] and n == entities.select("entity_id").distinct().count()


def test_a_sweep_shuffles_counts_only(spark, monkeypatch):
    """Parts lie in their files: what is dealt out in a sweep is counts."""
    kind, plans = type(spark.range(1)), []
    plain = kind.mapInArrow

    def kept(self, *a, **k):
        found = plain(self, *a, **k)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(kind, "mapInArrow", kept)
    toks, entities = corpus(spark)
    assert S.distributed(toks, entities, S.Chain("entity_1", topics=2, entity_topics=2, burn_in=2, lag=1, samples=1, seed=1)).count() == toks.count()
    assert ["Exchange" in p for p in plans] == [True, False, False, False]  # dealt out to parts, two sweeps, the sample


def test_draws_are_even_and_of_their_document_alone():
    ids, length = np.array([5, -3, 2**62]), np.array([20_000, 0, 20_000])
    u = S.fast_uniforms(1, 2, 0, ids, length)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and np.abs(np.bincount((u * 20).astype(int)) - 2000).max() < 250
    assert abs(np.corrcoef(u[:20_000], u[20_000:])[0, 1]) < 0.03 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03
    assert (S.fast_uniforms(1, 2, 0, ids[2:], length[2:]) == u[20_000:]).all()
    assert all((S.fast_uniforms(*other, ids, length) != u).mean() > 0.99 for other in ((2, 2, 0), (1, 3, 0), (1, 2, 1)))


def test_the_event_model_takes_all_entities(spark, tmp_path, monkeypatch):
    texts(spark).write.parquet(str(tmp_path / "documents.parquet"))
    took = []
    monkeypatch.setattr(S, "over_documents", lambda docs, chains, out=None: took.append((chains[0].model, rows_of(docs))) or spark.createDataFrame([(0, 1)], "config int, z long"))
    models.gibbs_event(spark, str(tmp_path))
    models.gibbs_entity_v1(spark, str(tmp_path))
    (event, every), (model, four) = took
    assert event == "event" and [len(r[3]) for r in every if r[0] == 2] == [5] and [sum(r[4]) for r in every if r[0] == 2] == [6]
    assert model == "entity_1" and [len(r[3]) for r in four if r[0] == 2] == [4]
