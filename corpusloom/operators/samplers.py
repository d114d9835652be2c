"""Gibbs samplers: exact sequential chains, and an approximate distributed sweep.

A collapsed Gibbs chain resamples tokens one after another, each given all others: its exact form runs in one
task by its nature, and is meant for corpora that fit there (MOST_TOKENS is checked). `distributed_lda`, and `distributed` for
all models, are another algorithm, for corpora of any size: each document is swept against the counts of the last
sweep and its own changes, and counts are merged between sweeps (Newman, Asuncion, Smyth, Welling: Distributed
Algorithms for Topic Models, JMLR 2009).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import exists, fresh_path, removed, written
from .topics import topic_vectors

MOST_TOKENS = 5_000_000
#: Tokens that one task sweeps.
PART_TOKENS = 1_000_000
#: Tokens that a part of a chain should have at least, where there are cores for more parts.
LEAST_TOKENS = 20_000
#: What a document counts for in the size of a part beside its tokens.
DOCUMENT = 32
#: Weights of tokens that a part holds at once.
CELLS = 1 << 20


@dataclass
class Chain:
    """A model and its run. Samples are taken at burn_in, burn_in + lag, ...; the chain stops after `samples` of them."""

    model: str  # lda, entity_1, entity_2, entity_3 or event
    topics: int = 10
    entity_topics: int = 0
    alpha: float = 0.1
    alpha_e: float = 0.1
    beta: float = 0.01
    beta_e: float = 0.01
    gamma: float = 0.1
    eta_d: float = 0.5
    eta_e: float = 0.5
    burn_in: int = 300
    lag: int = 20
    samples: int = 10
    seed: int = 1
    report_every: int = 0  # if set, the other schedule: every so many iterations until max_iterations, without a burn-in
    max_iterations: int = 0
    hashed: bool = False  # draws by md5 of seed, sweep, document and place, as SQL can make them; slower

    def sample_iterations(self) -> list[int]:
        if self.report_every:
            return list(range(self.report_every, self.max_iterations + 1, self.report_every))
        return [self.burn_in + i * self.lag for i in range(self.samples)]

    def widths(self) -> tuple[int, int]:
        """Topics (or events) of documents and of entities."""
        return self.topics, 0 if self.model in ("lda", "event") else self.entity_topics or self.topics


def draw(weights: np.ndarray, u: float) -> int:
    """The least index whose running sum exceeds u times the total."""
    sums = np.cumsum(weights)
    return min(int(np.searchsorted(sums, u * sums[-1], side="right")), len(weights) - 1)


class _State:
    """Assignments and counts of one chain. `spots` are tokens (document, word); each document may have entities, repeated by mentions."""

    def __init__(self, chain: Chain, doc: np.ndarray, word: np.ndarray, entities: list[np.ndarray], n_words: int, n_entities: int):
        self.c, self.doc, self.word, self.entities = chain, doc, word, entities
        self.rng = np.random.default_rng(chain.seed)
        k_d, k_e = chain.widths()
        n = len(doc)
        self.word_d, self.doc_k = np.zeros((n_words, k_d)), np.zeros((len(entities), k_d))
        self.word_e, self.entity_k = np.zeros((n_words, max(1, k_e))), np.zeros((max(1, n_entities), max(1, k_e)))
        self.switch = np.zeros((len(entities), 2))
        self.z, self.s, self.rho = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        self.entity_event = np.zeros((max(1, n_entities), k_d))
        self.mention_z = [np.zeros(len(e), np.int64) for e in entities]
        self.doc_mention = np.zeros_like(self.doc_k)
        for i in range(n):
            mine = entities[doc[i]]
            self.s[i] = self.rng.integers(2) if k_e and len(mine) else 0
            self.rho[i] = mine[self.rng.integers(len(mine))] if self.s[i] else -1
            self.z[i] = self.rng.integers(k_e if self.s[i] else k_d)
            self._count(i, 1)
        if chain.model == "event":
            for d, mine in enumerate(entities):
                for j, e in enumerate(mine):
                    self.mention_z[d][j] = self.rng.integers(k_d)
                    self._count_mention(d, e, self.mention_z[d][j], 1)

    def _count(self, i: int, by: int) -> None:
        w, d, z = self.word[i], self.doc[i], self.z[i]
        self.switch[d, self.s[i]] += by
        if self.s[i]:
            self.word_e[w, z] += by
            self.entity_k[self.rho[i], z] += by
        else:
            self.word_d[w, z] += by
            self.doc_k[d, z] += by

    def _count_mention(self, d: int, e: int, z: int, by: int) -> None:
        self.entity_event[e, z] += by
        self.doc_mention[d, z] += by

    def _totals(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, int]:
        """Over the corpus: tokens of each topic of documents and of entities, words, mentions of each event, entities."""
        return self.word_d.sum(0), self.word_e.sum(0), len(self.word_d), self.entity_event.sum(0), len(self.entity_event)

    def sweep(self) -> None:
        """Resample every token (and every mention of the event model), in order."""
        c = self.c
        size_d, size_e, v, size, n = self._totals()
        doc_size, entity_size = self.doc_k.sum(1), self.entity_k.sum(1)
        counted = [np.unique(e, return_counts=True) for e in self.entities]
        for i in range(len(self.doc)):
            self._count(i, -1)
            d, w = self.doc[i], self.word[i]
            if self.s[i]:
                size_e[self.z[i]] -= 1
                entity_size[self.rho[i]] -= 1
            else:
                size_d[self.z[i]] -= 1
                doc_size[d] -= 1
            weights = (self.word_d[w] + c.beta) / (size_d + v * c.beta) * (self.doc_k[d] + c.alpha)
            mine = self.entities[d]
            kinds = np.zeros(0, np.int64)
            if c.model.startswith("entity") and len(mine):
                weights = weights / (doc_size[d] + c.topics * c.alpha)
                kinds, times = counted[d]
                k_e = self.word_e.shape[1]
                prior, beta = (c.alpha_e, c.beta_e) if c.model == "entity_3" else (c.gamma, c.beta)
                words = (self.word_e[w] + beta) / (size_e + v * beta)
                extra = words * (self.entity_k[kinds] + prior) / (entity_size[kinds, None] + k_e * prior) * (times / len(mine))[:, None]
                if c.model != "entity_1":
                    weights, extra = weights * (self.switch[d, 0] + c.eta_d), extra * (self.switch[d, 1] + c.eta_e)
                weights = np.concatenate([weights, extra.ravel()])
            at = draw(weights, self.rng.random())
            self.s[i] = int(at >= c.topics)
            if self.s[i]:
                e, self.z[i] = divmod(at - c.topics, self.word_e.shape[1])
                self.rho[i] = kinds[e]
                size_e[self.z[i]] += 1
                entity_size[self.rho[i]] += 1
            else:
                self.z[i], self.rho[i] = at, -1
                size_d[at] += 1
                doc_size[d] += 1
            self._count(i, 1)
        if c.model == "event":
            for d, mine in enumerate(self.entities):
                for j, e in enumerate(mine):
                    z = self.mention_z[d][j]
                    self._count_mention(d, e, z, -1)
                    size[z] -= 1
                    z = draw((self.entity_event[e] + c.gamma) / (size + n * c.gamma) * (self.doc_mention[d] + c.alpha), self.rng.random())
                    self.mention_z[d][j] = z
                    size[z] += 1
                    self._count_mention(d, e, z, 1)


def exact(encoded: DataFrame, doc_entities: DataFrame | None, chain: Chain, handler: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(iter, doc_id, pos, word_id, z, s, entity_id): the assignments of every sample of an exact chain.

    Runs in one task; a corpus of more than MOST_TOKENS raises an error. Equal seeds and corpora give equal chains. handler
    is called with each sample's iteration and rows.
    """
    n = encoded.count()
    if n > MOST_TOKENS:
        raise ValueError(f"{n} tokens are too many for an exact chain in one task; use distributed_lda")
    rows = encoded.select(F.lit(0).alias("kind"), "doc_id", F.col("pos").cast("long").alias("pos"), F.col("word_id").cast("long").alias("word_id"), F.lit(1).cast("long").alias("cnt"))
    if doc_entities is not None:
        rows = rows.unionByName(doc_entities.select(F.lit(1).alias("kind"), "doc_id", F.col("rank").cast("long").alias("pos"), F.col("entity_id").cast("long").alias("word_id"), "cnt"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kind", "doc_id", "pos"])
        toks, marks = group[group.kind == 0], group[group.kind == 1]
        docs, doc = np.unique(toks.doc_id, return_inverse=True)
        words, word = np.unique(toks.word_id, return_inverse=True)
        names = np.unique(marks.word_id)
        by_doc = {d: np.repeat(np.searchsorted(names, g.word_id), g.cnt) for d, g in marks.groupby("doc_id")}
        state = _State(chain, doc, word, [by_doc.get(d, np.zeros(0, np.int64)) for d in docs], len(words), len(names))
        wanted, out = set(chain.sample_iterations()), []
        for it in range(1, max(wanted) + 1):
            state.sweep()
            if it in wanted:
                entity = np.where(state.rho >= 0, names[state.rho] if len(names) else -1, -1)
                out.append(pd.DataFrame({"iter": it, "doc_id": toks.doc_id.to_numpy(), "pos": toks.pos.to_numpy(), "word_id": toks.word_id.to_numpy(), "z": state.z, "s": state.s, "entity_id": entity}))
        return pd.concat(out)

    found = rows.withColumn("chain", F.lit(1)).groupBy("chain").applyInPandas(run, "iter long, doc_id long, pos long, word_id long, z long, s long, entity_id long")
    if handler is not None:
        found = written(found, "samples")  # the chain runs once, however many samples are handled
        for it in chain.sample_iterations():
            handler(it, found.filter(F.col("iter") == it))
    return found


def distributed_lda(assigned: DataFrame, topics: int, alpha: float, beta: float, vocabulary_size: int, sweeps: int, seed: int) -> DataFrame:
    """(doc_id, pos, word_id, z) after some approximate sweeps over a corpus of any size.

    A document is one row of arrays, and documents of about PART_TOKENS tokens and of about one length are a part, which one task sweeps. To each part come the counts
    of its distinct words, once a word, so a vocabulary may be as large as it likes, and no row of counts moves for each token. A document's own
    counts are exact. Each sweep is written to the shared folder.
    """
    spots = F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("pos", "word_id", "z")))))
    packed = assigned.groupBy("doc_id").agg(spots.alias("spots")).select("doc_id", *(F.col(f"spots.{c}").alias(c) for c in ("pos", "word_id", "z")))
    dealt, parts = _dealt(written(packed, "chain-documents"), F.size("pos"), F.lit(0))
    now = written(dealt, "sweep")
    wanted = written(now.select("part", F.explode("word_id").alias("word_id")).distinct(), "part-words")
    for sweep in range(sweeps):
        tokens = now.select(F.inline(F.arrays_zip("word_id", "z")))
        by_word = written(topic_vectors(tokens, "word_id", topics).select("word_id", "n"), "word-counts")
        totals = {r.k: r.n for r in by_word.select(F.posexplode("n").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()}  # K rows
        size = np.array([float(totals.get(k, 0)) for k in range(topics)])
        step = _lda_sweep(topics, alpha, beta, vocabulary_size, size, seed + sweep)
        swept = now.repartition(parts, "part").groupBy("part").cogroup(wanted.join(by_word, "word_id").groupBy("part")).applyInPandas(step, now.schema)
        now = written(swept, "sweep")
    return now.select("doc_id", F.inline(F.arrays_zip("pos", "word_id", "z")))


def _lda_sweep(topics: int, alpha: float, beta: float, v: int, size: np.ndarray, seed: int):
    """One pass over a part: each document's own counts are kept exactly, word counts are the last sweep's without the token itself.

    All documents of the part go on together, one token of each at a time, so a step is one operation on arrays.
    """

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        docs = docs.iloc[np.argsort(-docs.pos.map(len).to_numpy(), kind="stable")]
        length = docs.pos.map(len).to_numpy()
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        words = words.sort_values("word_id")
        counts = np.stack(words.n.to_list()).astype(float)
        word = np.searchsorted(words.word_id.to_numpy(), np.concatenate(docs.word_id.to_list()))
        z = np.concatenate(docs.z.to_list()).astype(np.int64)
        u = np.concatenate([np.random.default_rng((seed, int(d) & 0x7FFFFFFFFFFFFFFF)).random(n) for d, n in zip(docs.doc_id, length, strict=True)])
        own = np.zeros((len(docs), topics))
        np.add.at(own, (np.repeat(np.arange(len(docs)), length), z), 1)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t))  # documents of more than t tokens come first
            at, row = first[:live] + t, np.arange(live)
            own[row, z[at]] -= 1
            seen = counts[word[at]]
            seen[row, z[at]] -= 1
            sums = np.cumsum((seen + beta) / (size + v * beta) * (own[:live] + alpha), 1)
            z[at] = np.minimum((sums <= (u[at] * sums[:, -1])[:, None]).sum(1), topics - 1)
            own[row, z[at]] += 1
        return docs.assign(z=np.split(z, first[1:]) if len(docs) else [])

    return run


#: A part's row: what stays (`body`, see _closed) and each configuration's state (`state`: cells, places of entities and events, one after another), as bytes.
#: Or a row of a part's counts, where kind isn't null: some of its words (kind 0) or entities (kind 1), for each cell, topic or event how often it occurs with each of them (`n`),
#: with all of them that the part has (`whole`), and how many of them no other part has and aren't listed (`alone`).
_STATE = "part long, body array<binary>, state array<binary>, config int, kind int, ids array<long>, n array<array<long>>, whole array<long>, alone long"
_SCHEMA = pa.schema([("part", pa.int64()), ("body", pa.list_(pa.binary())), ("state", pa.list_(pa.binary())), ("config", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.list_(pa.int64()))), ("whole", pa.list_(pa.int64())), ("alone", pa.int64())])
#: Counts of words and entities, for all configurations together, up to which they are sent to the parts (96 MB); beyond, parts are shuffled to the counts of theirs.
MOST_SENT = 24_000_000
#: Rows of a sample that a task sends on together.
CHUNK = 200_000


def hashed_uniforms(seed: int, sweep: int, doc_id: int, pos: np.ndarray) -> np.ndarray:
    """Draws that SQL can make too: 52 bits of the md5 of `seed:sweep:doc:pos`."""
    return np.array([int(hashlib.md5(f"{seed}:{sweep}:{doc_id}:{p}".encode(), usedforsecurity=False).hexdigest()[:13], 16) / 2.0**52 for p in pos.tolist()])


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fast_uniforms(seed: int, sweep: int, stream: int, doc_ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As many draws as `length` says for each document, one after another: SplitMix64 from a state that depends on seed, sweep, stream and document only."""
    start = _mixed(_mixed(np.array([seed], np.int64).view(np.uint64)) + np.uint64(2 * sweep + stream))
    key = _mixed(_mixed(np.asarray(doc_ids, np.int64).view(np.uint64)) ^ start)
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length) + 1
    return (_mixed(np.repeat(key, length) + place.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) * 2.0**-53


def _flat(arrays) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)


def _cut(flat: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(length)[:-1]) if len(length) else []


def _by_place(length: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """For documents of descending length that lie one after another: the items' order by their place in the document, then by document, and how many documents have an item at each place."""
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - (np.cumsum(length) - length)[row]
    lives = len(length) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
    order = np.empty(len(row), np.int64)
    order[(np.cumsum(lives) - lives)[place] + row] = np.arange(len(row))
    return order, lives.tolist()


class _Part:
    """The documents of one part and configuration, all swept together: one token of each at a time, so a step is one operation on arrays.

    Each document's own counts are exact as it goes on: topics, switches, and what it changes in its entities' counts. Words have the counts of the last sweep without the token itself.
    """

    def __init__(self, chain: Chain, docs: pd.DataFrame, sweep: int):
        self.c, self.sweep, self.with_entities = chain, sweep, chain.model.startswith("entity")
        docs = docs.iloc[np.argsort(-docs.pos.map(len).to_numpy(), kind="stable")]
        self.docs, self.length = docs, docs.pos.map(len).to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(docs)), self.length)
        self.word, self.cell, self.events, held = (_flat(docs[c].to_list()) for c in ("word", "cell", "events", "held"))
        self.many, ents, times = docs.ents.map(len).to_numpy().astype(np.int64), _flat(docs.ents.to_list()), _flat(docs.times.to_list())
        self.of_mention = np.repeat(ents, times)
        self.mentions = np.bincount(np.repeat(np.arange(len(docs)), self.many), times, minlength=len(docs)).astype(np.int64)
        self.entity = np.full(len(self.word), -1)
        if self.with_entities:
            self.most = max(1, int(self.many.max(initial=0)))
            inside = np.arange(self.most) < self.many[:, None]
            self.ents, self.times = np.full((len(docs), self.most), -1, np.int64), np.zeros((len(docs), self.most))
            self.ents[inside], self.times[inside] = ents, times
            if len(held):  # else there is no state yet
                self.entity = np.where(held >= 0, (self.ents[self.row] == held[:, None]).argmax(1), -1)  # place among the document's entities

    def uniforms(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token and each mention a draw that depends on seed, sweep and document only."""
        if self.c.hashed:
            some = [(hashed_uniforms(self.c.seed, self.sweep, d, np.asarray(p)), hashed_uniforms(self.c.seed, self.sweep, d, -1 - np.arange(m))) for d, p, m in zip(self.docs.doc_id, self.docs.pos, self.mentions, strict=True)]
            return tuple(np.concatenate([np.zeros(0), *x]) for x in zip(*some, strict=True)) if some else (np.zeros(0), np.zeros(0))
        ids = self.docs.doc_id.to_numpy()
        return tuple(fast_uniforms(self.c.seed, self.sweep, i, ids, n) for i, n in enumerate((self.length, self.mentions)))

    def start(self) -> pd.DataFrame:
        """A first state: switch, entity by mentions, and topic by chance."""
        k_d, k_e = self.c.widths()
        u, v = self.uniforms()
        fine = (u * 2.0**20) % 1  # independent of the bits that choose the entity
        self.cell = np.minimum((fine * k_d).astype(np.int64), k_d - 1)
        if self.with_entities:
            free = self.many[self.row] > 0
            s = free & (u < 0.5)
            again = np.where(free, u * 2 % 1, u)  # what is left of the draw
            sums = np.cumsum(self.times, 1)
            at = (sums[self.row] <= (again * sums[self.row, -1])[:, None]).sum(1)
            self.entity = np.where(s, np.minimum(at, np.maximum(self.many[self.row] - 1, 0)), -1)
            self.cell = np.where(s, k_d + np.minimum((fine * k_e).astype(np.int64), k_e - 1), self.cell)
        self.events = np.minimum((v * k_d).astype(np.int64), k_d - 1) if self.c.model == "event" else np.zeros(0, np.int64)
        return self.rows()

    def rows(self) -> pd.DataFrame:
        held = np.where(self.entity >= 0, self.ents[self.row, np.maximum(self.entity, 0)], -1) if self.with_entities else self.entity
        return self.docs.assign(cell=_cut(self.cell, self.length), held=_cut(held, self.length), events=_cut(self.events, self.mentions) if len(self.events) else [np.zeros(0, np.int64)] * len(self.docs))

    def sweep_all(self, words: np.ndarray | None, word_counts: np.ndarray, entities: np.ndarray, entity_counts: np.ndarray, totals: tuple) -> pd.DataFrame:
        """Resample every token, then every mention of the event model. words and entities: sorted ids, with the corpus's counts of the last sweep; words None: a word is its place in them.

        Counts lie by topic, documents beside each other. A token's spot is its topic, or K_d + its entity's place * K_e + the entity's topic, so what it counts in is found by one number.
        """
        c, (k_d, k_e), n = self.c, self.c.widths(), len(self.docs)
        size, v, event_size, n_entities = totals
        u, u_mention = self.uniforms()
        order, lives = _by_place(self.length)
        word, row, u = (self.word if words is None else np.searchsorted(words, self.word))[order], self.row[order], u[order] * (1 - 2.0**-40)
        cell, spot = self.cell[order], self.cell[order]
        many = k_d + (self.most * k_e if self.with_entities else 0)
        if self.with_entities:
            entity = self.entity[order]
            spot = np.where(entity >= 0, cell + entity * k_e, cell)
        counts = np.zeros((many, n))
        counts[:k_d] = np.bincount((spot * n + row)[spot < k_d], minlength=k_d * n).reshape(k_d, n)
        of_spots, left = counts.reshape(-1), spot * n + row  # flat: where a token counts
        prior = np.full((many, 1), c.alpha)
        if self.with_entities:
            table = np.concatenate([entity_counts, np.zeros((1, k_e))])
            at = np.searchsorted(entities, self.ents)
            at = np.where((self.ents >= 0) & (at < len(entities)) & (entities[np.minimum(at, len(entities) - 1)] == self.ents) if len(entities) else False, at, len(entities))
            counts[k_d:] = table[at].transpose(1, 2, 0).reshape(-1, n)  # a document's own copy
            share = (self.times / np.maximum(1, self.times.sum(1, keepdims=True))).T.copy()
            prior_e, beta_e = (c.alpha_e, c.beta_e) if c.model == "entity_3" else (c.gamma, c.beta)
            prior[k_d:] = prior_e
            group = np.concatenate([np.zeros(k_d, np.int64), 1 + np.repeat(np.arange(self.most), k_e)])
            sizes = np.concatenate([counts[:k_d].sum(0)[None], counts[k_d:].reshape(self.most, k_e, n).sum(1)])  # tokens of the document's topics, and of each of its entities
            of_groups, left_group, others = sizes.reshape(-1), group[spot] * n + row, self.length - 1.0
        every, o, made = np.arange(n), 0, 0
        for live in lives:
            if o + live > made:  # what doesn't change within the sweep is made for many steps at once
                lo, made = o, min(len(cell), o + max(live, CELLS // (k_d + k_e)))
                seen = word_counts[word[lo:made]].astype(float)
                seen[np.arange(made - lo), cell[lo:made]] -= 1
                of_topics = ((seen[:, :k_d] + c.beta) / (size[:k_d] + v * c.beta)).T.copy()
                if self.with_entities:
                    of_words = ((seen[:, k_d:] + beta_e) / (size[k_d:] + v * beta_e)).T.copy()
            now, here = slice(o, o + live), slice(o - lo, o - lo + live)
            of_spots[left[now]] -= 1
            weights = counts[:, :live] + prior
            weights[:k_d] *= of_topics[:, here]
            if self.with_entities:
                of_groups[left_group[now]] -= 1
                own = sizes[0, :live]
                of_own, of_ents = 1 / (own + k_d * c.alpha), share[:, :live] / (sizes[1:, :live] + k_e * prior_e)
                if c.model != "entity_1":
                    of_own *= own + c.eta_d
                    of_ents *= others[:live] - own + c.eta_e
                weights[:k_d] *= of_own
                extra = weights[k_d:].reshape(self.most, k_e, live)
                extra *= of_words[:, here]
                extra *= of_ents[:, None, :]
            sums = np.cumsum(weights, 0)
            drawn = (sums <= u[now] * sums[-1]).sum(0)
            spot[now] = drawn
            of_spots[drawn * n + every[:live]] += 1
            if self.with_entities:
                of_groups[group[drawn] * n + every[:live]] += 1
            o += live
        if self.with_entities:
            self.entity[order] = np.where(spot < k_d, -1, (spot - k_d) // k_e)
            spot = np.where(spot < k_d, spot, k_d + (spot - k_d) % k_e)
        self.cell[order] = spot
        if c.model == "event":
            self._mentions(entities, entity_counts, event_size, n_entities, u_mention)
        return self.rows()

    def _mentions(self, entities: np.ndarray, counts: np.ndarray, size: np.ndarray, n_entities: int, u: np.ndarray) -> None:
        """A document's events by its mentions alone, one mention of each document at a time."""
        c, n = self.c, len(self.docs)
        by_many = np.argsort(-self.mentions, kind="stable")
        first, many = (np.cumsum(self.mentions) - self.mentions)[by_many], self.mentions[by_many]
        order, lives = _by_place(many)
        row = np.repeat(np.arange(n), many)[order]
        at = (np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(order)))[order]  # the mention in its own order
        z, u, i = self.events[at], u[at] * (1 - 2.0**-40), np.arange(len(at))
        seen, less = counts[np.searchsorted(entities, self.of_mention[at])].astype(float), np.tile(size, (len(at), 1))
        seen[i, z] -= 1
        less[i, z] -= 1
        fixed = ((seen + c.gamma) / (less + n_entities * c.gamma)).T.copy()
        own = np.bincount(z * n + row, minlength=c.topics * n).reshape(c.topics, n).astype(float)
        flat, left, every, o = own.reshape(-1), z * n + row, np.arange(n), 0
        for live in lives:
            now = slice(o, o + live)
            flat[left[now]] -= 1
            sums = np.cumsum(fixed[:, now] * (own[:, :live] + c.alpha), 0)
            z[now] = (sums <= u[now] * sums[-1]).sum(0)
            flat[z[now] * n + every[:live]] += 1
            o += live
        self.events[at] = z


def _groups(docs: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Documents with about as many entities each, so that tables by entity have few empty places."""
    size = np.ceil(np.log2(np.maximum(1, docs.ents.map(len).to_numpy())))
    for k in np.unique(size):
        yield docs[size == k]


def _together(chain: Chain, docs: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Documents that go on together: those with about as many entities, or all where no table is by entity."""
    return _groups(docs) if chain.model.startswith("entity") else iter([docs])


def _with_counts(chain: Chain, width: int, docs: pd.DataFrame) -> pd.DataFrame:
    """(kind, ids, n) of a part's words and entities, numbered densely: n has a row of counts for each id. Entities that hold no token have zeros."""
    k_d, _ = chain.widths()
    word, cell, held, ents = (_flat(docs[c].to_list()) for c in ("word", "cell", "held", "ents"))
    seen = [(0, word, word, cell)]
    if chain.model.startswith("entity"):
        seen.append((1, ents, held[held >= 0], cell[held >= 0] - k_d))
    elif chain.model == "event":
        seen.append((1, ents, np.repeat(ents, _flat(docs.times.to_list())), _flat(docs.events.to_list())))
    rows = []
    for kind, every, of, z in seen:
        there = np.bincount(every)
        n = np.bincount(of * width + z, minlength=len(there) * width).reshape(-1, width)
        ids = np.flatnonzero(there)
        rows.append((kind, ids, n[ids]))
    return pd.DataFrame(rows, columns=["kind", "ids", "n"])


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers as the size of one and as many bytes each."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(x, kind).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"i{x[0]}", offset=1).astype(np.int64)


def _closed(docs: pd.DataFrame) -> list[bytes]:
    """What stays of a part's documents: ids, lengths, places, words, numbers of entities, entities, mentions; words and entities by their places among the part's, whose ids come last."""
    words, word = np.unique(_flat(docs.word.to_list()), return_inverse=True)
    names, ents = np.unique(_flat(docs.ents.to_list()), return_inverse=True)
    length, many = docs.pos.map(len).to_numpy(), docs.ents.map(len).to_numpy()
    places = np.diff(_flat(docs.pos.to_list()), prepend=0)
    return [_bytes(x) for x in (docs.doc_id.to_numpy(), length, places, word, many, ents, _flat(docs.times.to_list()), words, names)]


def _opened(body: list[bytes]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The documents of _closed, and the ids of the part's words and entities."""
    ids, length, places, word, many, ents, times, words, names = map(_numbers, body)
    docs = pd.DataFrame({"doc_id": ids})
    for name, flat, n in (("pos", np.cumsum(places), length), ("word", word, length), ("ents", ents, many), ("times", times, many)):
        docs[name] = pd.Series(_cut(flat, n), dtype=object)
    return docs, words, names


def _state_of(chain: Chain, docs: pd.DataFrame, state: list[bytes]) -> pd.DataFrame:
    cell, held, events = map(_numbers, state)
    length = docs.pos.map(len).to_numpy()
    mentions = np.array([t.sum() for t in docs.times], np.int64) if len(events) else np.zeros(len(docs), np.int64)
    return docs.assign(**{c: pd.Series(_cut(x, n), dtype=object) for c, x, n in (("cell", cell, length), ("held", held if len(held) else np.full(len(cell), -1), length), ("events", events, mentions))})


def _bytes_of(chain: Chain, docs: pd.DataFrame) -> list[bytes]:
    held = _flat(docs.held.to_list()) if chain.model.startswith("entity") else np.zeros(0, np.int64)
    return [_bytes(x) for x in (_flat(docs.cell.to_list()), held, _flat(docs.events.to_list()))]


def _rows(part: int, body: list[bytes], chains: list[Chain], width: int, states: list[pd.DataFrame | None], words: np.ndarray, names: np.ndarray, known: dict | None) -> pa.RecordBatch:
    """A part's row and its rows of counts. known: the ids that are listed, by configuration and kind (None: all)."""
    rows, most = [(part, body, [b for c, s in zip(chains, states, strict=True) for b in ((b"", b"", b"") if s is None else _bytes_of(c, s))], *[None] * 6)], max(1, CELLS // width)
    for i, (chain, docs) in enumerate(zip(chains, states, strict=True)):
        for r in _with_counts(chain, width, docs).itertuples() if docs is not None else ():
            ids, n, whole, alone = (words, names)[r.kind][r.ids], r.n, r.n.sum(0), 0
            if known is not None:
                listed = _found(known[i, r.kind][0], ids) >= 0
                ids, n, alone = ids[listed], n[listed], int((~listed).sum())
            for at in range(0, max(1, len(ids)), most):
                some = n[at : at + most].T
                rows.append((part, None, None, i, r.kind, ids[at : at + most], list(np.ascontiguousarray(some)), whole if at == 0 else None, alone if at == 0 else None))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _found(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each id among the sorted ones, -1 where it isn't there."""
    if not len(sorted_ids):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def _started(chains: list[Chain], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's documents are of one part."""
        got = [*batches]
        every = pa.Table.from_batches(got).to_pandas() if got else pd.DataFrame({"part": []})
        for part, docs in every.groupby("part"):
            docs = docs.iloc[np.argsort(-docs.pos.map(len).to_numpy(), kind="stable")]
            body = _closed(docs)
            docs, words, names = _opened(body)
            empty = docs.assign(**{c: [np.zeros(0, np.int64)] * len(docs) for c in ("cell", "held", "events")})
            states = [pd.concat([_Part(c, d, 0).start() for d in _together(c, empty)]).sort_index() for c in chains]
            yield _rows(int(part), body, chains, width, states, words, names, None)

    return run


def _swept_part(part: int, body: list[bytes], state: list[bytes], chains: list[Chain], width: int, sweep: int, live: list[int], totals: list[tuple], known: dict) -> pa.RecordBatch:
    """One sweep of a part. known: (ids, counts) by configuration and kind, of the ids that several parts have; others have the part's own counts."""
    docs, words, names = _opened(body)
    states = []
    for i, chain in enumerate(chains):
        if i not in live:
            states.append(None)
            continue
        now, (k_d, k_e) = _state_of(chain, docs, state[3 * i : 3 * i + 3]), chain.widths()
        tables = {}
        for r in _with_counts(chain, width, now).itertuples():
            ids, counts = known[i, r.kind]
            at = _found(ids, (words, names)[r.kind][r.ids])
            tables[r.kind] = r.n.copy()
            tables[r.kind][at >= 0] = counts[at[at >= 0]]
        of_entities = tables.get(1, np.zeros((0, width)))[:, : k_d if chain.model == "event" else max(1, k_e)].astype(float)
        parts = [_Part(chain, d, sweep).sweep_all(None, tables[0][:, : k_d + k_e], np.arange(len(names)), of_entities, totals[i]) for d in _together(chain, now)]
        states.append(pd.concat(parts).sort_index())
    return _rows(part, body, chains, width, states, words, names, known)


def _dealt(docs: DataFrame, tokens: Column, entities: Column) -> tuple[DataFrame, int]:
    """docs with `part`, and how many parts there are: parts of about PART_TOKENS tokens and at least as many as there are cores, each of documents of about one length and number of entities.

    A part takes as many steps as its longest document has tokens, so long documents lie together. Classes of documents follow each other on a line, each as long as its documents have tokens,
    and a document's place within its class is its hash; a part is a stretch of the line.
    """
    weight = (tokens + F.lit(DOCUMENT)).cast("long")
    kind = [F.ceil(F.log2(F.greatest(entities, F.lit(1)))).cast("int"), F.floor(F.log2(tokens + 1) * 2).cast("int")]
    sized = docs.select(*(k.alias(f"k{i}") for i, k in enumerate(kind)), weight.alias("w"), tokens.alias("t")).groupBy("k0", "k1").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    classes = sized.orderBy("k0", "k1").collect()  # some forty for each power of two of entities
    total, n = sum(r.w for r in classes), sum(r.t for r in classes)
    parts = max(-(-total // PART_TOKENS), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_TOKENS)), 1)
    starts = np.cumsum([0, *(r.w for r in classes)]).tolist()
    line = F.map_from_entries(F.array(*(F.struct(F.struct(F.lit(r.k0), F.lit(r.k1)), F.struct(F.lit(float(a)), F.lit(float(r.w)))) for a, r in zip(starts, classes, strict=False))))
    if not classes:
        return docs.withColumn("part", F.lit(0).cast("long")), 1
    at = line[F.struct(*kind)]
    inside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.withColumn("part", F.least(F.floor((at["col1"] + inside * at["col2"]) / F.lit(total / parts)), F.lit(parts - 1)).cast("long")), int(parts)


def packed(encoded: DataFrame, doc_entities: DataFrame | None) -> DataFrame:
    """(doc_id, pos, word, ents, times): documents as rows of arrays."""
    spots = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("word_id").cast("long").alias("word"))))
    docs = encoded.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(spots.alias("spots")).select("doc_id", "spots.pos", "spots.word")
    none = F.array().cast("array<long>")
    if doc_entities is None:
        return docs.select("*", none.alias("ents"), none.alias("times"))
    of_doc = F.array_sort(F.collect_list(F.struct(F.col("entity_id").cast("long").alias("ents"), F.col("cnt").cast("long").alias("times"))))
    lists = doc_entities.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(of_doc.alias("e")).select("doc_id", "e.ents", "e.times")
    return docs.join(lists, "doc_id", "full").withColumns({c: F.coalesce(c, none) for c in ("pos", "word", "ents", "times")})


def _counted(now: DataFrame, chains: list[Chain]) -> tuple[DataFrame, str, list[tuple]]:
    """(kind, config, id, n0, n1, ...): the cells of each word (kind 0), and the topics or events of each entity (kind 1), summed over the parts, of those that several parts have; their
    folder; and each configuration's sums and numbers of words and of entities, of all."""
    spark, width = now.sparkSession, max(sum(c.widths()) for c in chains)
    listed = now.filter("kind is not null")
    names = [f"n{k}" for k in range(width)]
    cells = listed.select("kind", "config", F.inline(F.arrays_zip(F.col("ids").alias("id"), *(F.get("n", F.lit(k)).alias(c) for k, c in enumerate(names)))))
    counts, path = cells.groupBy("kind", "config", "id").agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("parts")), fresh_path(spark, "chain-counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    sizes = [[np.zeros(width), np.zeros(width)] for _ in chains]
    many = [[0, 0] for _ in chains]
    for r in listed.groupBy("kind", "config").agg(*(F.sum(F.get("whole", F.lit(k))).alias(c) for k, c in enumerate(names)), F.sum("alone").alias("alone")).collect():
        sizes[r.config][r.kind], many[r.config][r.kind] = np.array([float(r[c]) for c in names]), r.alone
    for r in counts.groupBy("kind", "config").agg(F.count("*").alias("ids")).collect():
        many[r.config][r.kind] += r.ids
    totals = [(of_words[: sum(c.widths())], words, of_entities[: c.topics], entities) for c, (of_words, of_entities), (words, entities) in zip(chains, sizes, many, strict=True)]
    return counts.filter("parts > 1").drop("parts"), path, totals


def _tables(rows: pa.Table, chains: list[Chain]) -> dict:
    """(ids, counts) of each configuration and kind, by id, of rows (kind, config, id, n0, n1, ...)."""
    rows, found = rows.sort_by("id"), {}
    kind, config, ids = (rows[c].to_numpy() for c in ("kind", "config", "id"))
    n = [rows[c].to_numpy() for c in rows.column_names if c[0] == "n"]
    for i in range(len(chains)):
        for k in (0, 1):
            mine = np.flatnonzero((kind == k) & (config == i))
            found[i, k] = ids[mine], np.stack([x[mine] for x in n], 1)
    return found


@contextmanager
def _a_task_a_file(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside read each small file in a task of its own: few bytes are much work."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _sweep(spark: SparkSession, source: str, path: str, chains: list[Chain], it: int, live: list[int]) -> None:
    """One sweep of all parts in source, written to path. Parts stay where they lie, and the counts are sent to them; more than MOST_SENT are joined to the parts that need them, and parts are shuffled."""
    width = max(sum(c.widths()) for c in chains)
    now, again = (spark.read.schema(_STATE).parquet(source) for _ in range(2))
    counts, folder, totals = _counted(now, chains)
    parts = now.filter("kind is null").select("part", "body", "state")
    n, sent = counts.count() * width, None
    if n <= MOST_SENT:
        small = max(max(t[0].max(initial=0), t[2].max(initial=0)) for t in totals) < 2**31
        table = counts.select("kind", "config", "id", *(F.col(f"n{k}").cast("int" if small else "long").alias(f"n{k}") for k in range(width))).toArrow()
        sent = spark.sparkContext.broadcast(_tables(table, chains))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield _swept_part(*(batch.column(c)[i].as_py() for c in range(3)), chains, width, it, live, totals, sent.value)

        swept = parts.mapInArrow(run, _STATE)
    else:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            known = _tables(right, chains)
            made = [_swept_part(*(left[c][i].as_py() for c in ("part", "body", "state")), chains, width, it, live, totals, known) for i in range(left.num_rows)]
            return pa.Table.from_batches(made, _SCHEMA)

        needed = again.filter("kind is not null").select("part", "config", "kind", F.explode("ids").alias("id"))
        n = 1 + now.agg(F.max("part")).first()[0]
        brought = needed.join(counts, ["config", "kind", "id"]).select("part", "kind", "config", "id", *(f"n{k}" for k in range(width)))
        swept = parts.repartition(n, "part").groupBy("part").cogroup(brought.groupBy("part")).applyInArrow(both, _STATE)
    with _a_task_a_file(spark):
        swept.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if sent is not None:
        sent.destroy()
    removed(spark, folder)


def _sampled(rows: DataFrame, chains: list[Chain], it: int) -> DataFrame:
    """(config, iter, doc_id, pos, word_id, z, s, entity_id) of parts, for the configurations that have a sample at this sweep."""
    wanted = [i for i, c in enumerate(chains) if it in c.sample_iterations()]
    names = ["config", "iter", "doc_id", "pos", "word_id", "z", "s", "entity_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, length, places, word, _, _, _, words, entities = map(_numbers, batch.column(0)[r].as_py())
                doc, pos, word, state = np.repeat(ids, length), np.cumsum(places), words[word], batch.column(1)[r].as_py()
                for i in wanted:
                    cell, held, _ = map(_numbers, state[3 * i : 3 * i + 3])
                    s = (cell >= chains[i].topics).astype(np.int64)
                    held = np.where(held >= 0, entities[held], -1) if len(held) and len(entities) else np.full(len(cell), -1)
                    columns = (np.full(len(cell), it), doc, pos, word, cell - s * chains[i].topics, s, held)
                    for at in range(0, len(cell), CHUNK):
                        some = [x[at : at + CHUNK] for x in columns]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), i, np.int32)), *map(pa.array, some)], names)

    return rows.filter("kind is null").select("body", "state").mapInArrow(run, "config int, " + ", ".join(f"{c} long" for c in names[1:]))


def distributed_grid(encoded: DataFrame, doc_entities: DataFrame | None, chains: list[Chain], out: str | None = None) -> DataFrame:
    """over_documents of tokens (doc_id, pos, word_id) and documents' entities (doc_id, entity_id, cnt) as rows."""
    return over_documents(packed(encoded, doc_entities), chains, out)


def over_documents(docs: DataFrame, chains: list[Chain], out: str | None = None) -> DataFrame:
    """(config, iter, doc_id, pos, word_id, z, s, entity_id): the samples of approximate chains of any models over a corpus of any size, all in one plan.

    docs: (doc_id, pos, word, ents, times), the tokens' places and words and the entities and their mentions as arrays. config is the place in `chains`. All configurations share a part's row, so the corpus, its
    one shuffle and its passes. A part stays in its file from sweep to sweep, as bytes; it counts its own tokens, and counts of words and entities that other parts have too come to it. out: the folder of the run. A sweep there is whole or not there, so a run that was stopped goes on from its last sweep and ends with the same rows; equal seeds and corpora
    give equal rows. Sweeps that are no sample are deleted when the next is there. Without it the run has a folder of its own in the shared one.
    """
    spark, out = docs.sparkSession, out or fresh_path(docs.sparkSession, "chain")
    wanted, width = [set(c.sample_iterations()) for c in chains], max(sum(c.widths()) for c in chains)
    last = max(max(w) for w in wanted)
    path = lambda it: f"{out}/sweep={it:06d}"
    there = lambda it: exists(spark, f"{path(it)}/_SUCCESS")
    read = lambda it: spark.read.schema(_STATE).parquet(path(it))
    done = next((it for it in range(last, -1, -1) if there(it)), None)
    if done is None:
        folder = fresh_path(spark, "chain-documents")
        docs.write.option("compression", "zstd").parquet(folder)
        tokens, entities = F.size("pos"), F.size("ents") if any(c.model.startswith("entity") for c in chains) else F.lit(0)
        if any(c.model == "event" for c in chains):
            tokens = (tokens + F.aggregate("times", F.lit(0).cast("long"), lambda t, n: t + n)).cast("long")
        dealt, parts = _dealt(spark.read.schema(docs.schema).parquet(folder), tokens, entities)
        placed = dealt.repartitionById(parts, F.col("part").cast("int"))
        placed.mapInArrow(_started(chains, width), _STATE).write.mode("overwrite").option("compression", "zstd").parquet(path(0))
        removed(spark, folder)
        done = 0
    for it in range(done + 1, last + 1):
        _sweep(spark, path(it - 1), path(it), chains, it, [i for i, w in enumerate(wanted) if it <= max(w)])
        if not any(it - 1 in w for w in wanted):
            removed(spark, path(it - 1))
    return reduce(DataFrame.unionByName, [_sampled(read(it), chains, it) for it in sorted(set().union(*wanted))])


def distributed(encoded: DataFrame, doc_entities: DataFrame | None, chain: Chain, out: str | None = None) -> DataFrame:
    """(iter, doc_id, pos, word_id, z, s, entity_id): the samples of one approximate chain of any model; see distributed_grid."""
    return distributed_grid(encoded, doc_entities, [chain], out).drop("config")


def sample_mean(samples: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, k, value): the mean over the samples that were taken."""
    every = reduce(DataFrame.unionByName, samples)
    return every.groupBy(key, "k").agg((F.sum(value) / F.lit(len(samples))).alias(value))


def save_sample(rows: DataFrame, out: str, iteration: int) -> None:
    """Write one sample under iter=N."""
    rows.drop("iter").write.mode("overwrite").parquet(f"{out}/iter={iteration}")


def last_sample(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the latest sample, with its iteration."""
    every = spark.read.parquet(out)
    return every.filter(F.col("iter") == every.agg(F.max("iter")).first()[0])


def read_configurations(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Run configurations: numbers separated by commas, # for comments."""
    return spark.read.csv(path, schema=", ".join(f"{n} double" for n in names), comment="#", ignoreLeadingWhiteSpace=True)
