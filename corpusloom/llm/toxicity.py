"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters and digits, A-Z as a-z) and the first five bytes of longer words,
each present or not, hashed into BUCKETS. The machine adds a bias, a weight for each term and the
inner product of the latent vectors of each pair of terms, so a pair (an insult with a
group's name) can count for more than its parts do.

A term takes part if it tells the classes apart by itself, or in a pair: all pairs of terms that meet, frequent or not, are tested for
what they tell beyond their parts (`term_pairs`), so the parts of an exclusive-or take part though neither tells anything alone.

Fitting takes at most SAMPLE labelled rows (those with the smallest hashes of doc_id) and at most MOST_TERMS terms of them
together; both bounds are parameters. Scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import release_memory
from .sampling import hash_sample
from .shared import written
from .term_pairs import telling_pairs
from .words import PUNCTUATION, words_of

BUCKETS = 1 << 18
SAMPLE, MOST_TERMS, FACTORS = 20_000, 12_000_000, 8
#: Least likelihood-ratio statistic of a term by itself (about one in a thousand by chance), and of a pair beyond its parts: there are
#: millions of pairs, and rows of one group of copies share theirs.
SIGNIFICANT, PAIR_SIGNIFICANT = 11.0, 100.0


def _row_terms(column: pa.Array, pick: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows (first row, rows): the distinct (row, bucket) pairs in order. pick: bucket -> term or -1, to keep some only."""
    for w in words_of(column, PUNCTUATION):
        long = w.end - w.start > 5
        heads = w.span_hash(w.start[long], w.start[long] + 5) ^ np.uint64(0x5bd1e995)
        bucket = (np.concatenate([w.hash, heads]) >> np.uint64(64 - 18)).astype(np.int64)
        row = np.concatenate([w.row, w.row[long]]) - w.first_row
        if pick is not None:
            bucket = pick[bucket]
            row, bucket = row[bucket >= 0], bucket[bucket >= 0]
        pairs = np.unique(row * BUCKETS + bucket)
        yield w.first_row, w.n_rows, pairs // BUCKETS, pairs % BUCKETS


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, row, bucket in _row_terms(batch.column(2)):
            at = np.searchsorted(row, np.arange(n + 1)) * 4
            raw = bucket.astype("<i4").tobytes()
            found = pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.diff(at) // 4, pa.int32()), found], ["h", "y", "n", "terms"])


@dataclass
class Machine:
    pick: np.ndarray  # bucket -> term, -1 for the rest
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def margins(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        linear = np.bincount(row, self.weight[term], n)
        v = self.factors[term]
        pairs = np.zeros(n)
        for f in range(v.shape[1]):
            pairs += np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n)
        return self.bias + linear + pairs / 2

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for first, n, row, term in _row_terms(column, self.pick):
            out[first : first + n] = 1 / (1 + np.exp(-np.clip(self.margins(n, row, term), -30, 30)))
        return out


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _g_squared(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> np.ndarray:
    """Likelihood-ratio statistic of each term's presence in a of n_a rows of one class and b of n_b of the other."""
    h = _x_log_x
    return 2 * (h(a) + h(b) - h(a + b) + h(n_a - a) + h(n_b - b) - h(n_a + n_b - a - b) - h(np.float64(n_a)) - h(np.float64(n_b)) + h(np.float64(n_a + n_b)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


class _Batch:
    """Rows of one step: their terms by row, and the order that brings equal terms together."""

    def __init__(self, y: np.ndarray, terms: list[np.ndarray], rare: float):
        self.y, self.weight = y, np.where(y > 0, rare, 1.0)
        sizes = [len(t) for t in terms]
        self.row, self.rows = np.repeat(np.arange(len(terms)), sizes), np.concatenate([[0], np.cumsum(sizes)])
        self.term = np.concatenate(terms)
        self.order = np.argsort(self.term, kind="stable")
        self.used, first = np.unique(self.term[self.order], return_index=True)
        self.bounds = np.append(first, len(self.term))


def fit_machine(y: np.ndarray, terms: list[np.ndarray], factors: int = FACTORS, epochs: int = 30, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the logistic loss, in small batches, with an L2 pull on weights and factors."""
    pick = np.full(BUCKETS, -1, np.int64)
    n = len(y)
    if n == 0:
        return Machine(pick, -4.0, np.zeros(1), np.zeros((1, factors)))
    rate = (y.sum() + 0.5) / (n + 1)
    df = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for c in (0, 1):
        of_class = [t for t, k in zip(terms, y, strict=True) if k == c]
        for i in range(0, len(of_class), 512):
            df[c] += np.bincount(np.concatenate(of_class[i : i + 512]), minlength=BUCKETS)
    tell = _g_squared(df[1], df[0], y.sum(), n - y.sum())
    tell[df[0] + df[1] < 3] = 0
    chosen = np.union1d(np.flatnonzero(tell >= SIGNIFICANT), telling_pairs(y, terms, BUCKETS, PAIR_SIGNIFICANT))
    pick[chosen] = np.arange(len(chosen))
    rare = float(np.sqrt((1 - rate) / rate))  # errors on the rarer class count for more
    rng = np.random.default_rng(seed)
    size = max(1, len(chosen))
    m = Machine(pick, float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.01, (size, factors)))
    kept, order = [pick[t][pick[t] >= 0] for t in terms], rng.permutation(n)
    batches = [_Batch(y[part], [kept[j] for j in part], rare) for part in np.split(order, np.arange(64, n, 64))]
    g_b, g_w, g_v = 1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            v = m.factors[b.term]
            sums = _sums(v, b.rows)
            margin = m.bias + _sums(m.weight[b.term], b.rows) + ((sums * sums).sum(1) - _sums((v * v).sum(1), b.rows)) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - b.y) * b.weight
            each, used = error[b.row], b.used
            d_w = _sums(each[b.order], b.bounds) + 1e-3 * m.weight[used]
            d_v = _sums((each[:, None] * (sums[b.row] - v))[b.order], b.bounds) + 1e-3 * m.factors[used]
            d_b = error.sum()
            g_b, g_w[used], g_v[used] = g_b + d_b**2, g_w[used] + d_w**2, g_v[used] + d_v**2
            m.bias -= 0.1 * d_b / np.sqrt(g_b)
            m.weight[used] -= 0.1 * d_w / np.sqrt(g_w[used])
            m.factors[used] -= 0.03 * d_v / np.sqrt(g_v[used])
    return m


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text, modulo folds, equals fold; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_terms: int = MOST_TERMS, held_out: tuple[int, int] = (3, 1)) -> Machine:
    """The machine fitted on labelled documents outside the held-out fold; rows of labels with nulls tell nothing, any toxic one of several wins.

    Of the sampled rows, those of the lowest hashes are taken whose terms are at most most_terms together, so very long texts
    don't add up on the driver.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~in_fold(F.col("doc_id"), *held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    few = hash_sample(known, "doc_id", sample, known.count())
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    once = found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).coalesce(16)  # of repeated rows, one; as many as the sample holds
    terms = written(once.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(_terms, "h long, y int, n int, terms binary"), "toxicity-terms")
    sizes = terms.select("h", "n").toArrow()  # at most `sample` rows of two numbers
    h, n = sizes["h"].to_numpy(), sizes["n"].to_numpy()
    order = np.argsort(h, kind="stable")
    inside = order[np.cumsum(n[order].astype(np.int64)) <= most_terms]
    if len(inside) < len(h):
        terms = terms.filter(F.col("h") <= int(h[inside].max(initial=np.iinfo(np.int64).min)))
    found = terms.select("y", "terms").toArrow()
    rows = sorted(zip(found["y"].to_pylist(), found["terms"].to_pylist(), strict=True))
    del found
    machine = fit_machine(np.array([k for k, _ in rows], np.float64), [np.frombuffer(t, "<i4") for _, t in rows])
    del rows
    release_memory()
    return machine


def toxicity_column(machine: Machine, text: Column) -> Column:
    """The score of a text column, from 0 to 1; null and empty texts score as texts without a term."""

    def score(column: pa.Array) -> pa.Array:
        return pa.array(machine.score(column), pa.float64())

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Of several texts of one labelled id the first in code-point order is learned from; all are scored. Null and empty texts get the bias's score; repeated rows stay; null ids are in no fold and are scored; without labels every
    text gets one low score; an empty table gives an empty table; other columns are ignored.
    """
    machine = learn_toxicity(docs, labels)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), toxicity_column(machine, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold.

    Null and empty texts have the bias's score; repeated rows are judged alike; null ids are judged; an empty table gives an empty table;
    without labels nothing goes; other columns stay, whatever their names.
    """
    return docs.filter(toxicity_column(learn_toxicity(docs, labels), docs["text"]) < threshold)
