"""Terms that tell two classes apart only together with another term, searched among all pairs of terms that meet.

A pair's statistic is what the four cells of its two terms tell about the class beyond what both tell alone (twice the log-likelihood ratio). All pairs
that share rows are counted, whatever their frequency: each term's rows are put together and their other terms counted, the rarer term
of a pair first, so the work is the sum of squared row sizes. Tasks share the terms; the rows, a bounded sample, are sent to all of them.

Nothing that could reach the bound is left out: a pair tells no more than 2 n H(presence of its rarer term), which settles which terms can take part; and a pair that
meets in a handful of rows tells what its terms tell alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .memory import released

#: Bound of the sum of squared row sizes: rows beyond it, in an order by chance, are not searched for pairs.
MOST_PAIRS = 20_000_000_000
#: Rows that a pair must meet in, and tasks for each core.
TOGETHER, TASKS = 5, 4


def _x_log_x(most: int) -> np.ndarray:
    x = np.arange(most + 1, dtype=np.float64)
    return x * np.log(np.maximum(x, 1))


def _search(rows, first: int, step: int) -> np.ndarray:
    """Places of the terms first, first + step, ... and of their partners that reach the bound together."""
    y, ptr, idx, one, least = rows
    n, size = np.bincount(y, minlength=2), one.shape[1]
    h = _x_log_x(int(n.sum()))
    base = h[n.sum()] - h[n].sum()
    told = lambda a, b: h[a] + h[b] - h[a + b]
    alone = 2 * (told(*one) + told(n[0] - one[0], n[1] - one[1]) + base)
    mark = np.zeros(size, bool)
    at = np.flatnonzero(idx % step == first)
    if not len(at):
        return at
    at = at[np.argsort(idx[at], kind="stable")]
    row = np.searchsorted(ptr, at, side="right") - 1
    end, of_class = ptr[row + 1], y[row]
    cuts = np.flatnonzero(np.diff(idx[at], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
        a = idx[at[lo]]
        both = []
        for c in (0, 1):  # a row's terms stand in order of frequency: what follows a term is more frequent
            own = np.flatnonzero(of_class[lo:hi] == c) + lo
            met = [idx[p:q] for p, q in zip((at[own] + 1).tolist(), end[own].tolist(), strict=True)]
            both.append(np.bincount(np.concatenate(met), minlength=size) if met else np.zeros(size, np.int64))
        b = np.flatnonzero(both[0] + both[1] >= TOGETHER)
        if not len(b):
            continue
        x = [both[c][b] for c in (0, 1)]
        left = [one[c][a] - x[c] for c in (0, 1)]
        right = [one[c][b] - x[c] for c in (0, 1)]
        rest = [n[c] - one[c][a] - right[c] for c in (0, 1)]
        good = 2 * (told(*x) + told(*left) + told(*right) + told(*rest) + base) - alone[a] - alone[b] >= least
        mark[b[good]] = True
        mark[a] |= good.any()
    return np.flatnonzero(mark)


def telling_pairs(y: np.ndarray, terms: list[np.ndarray], buckets: int, least: float, most_pairs: int = MOST_PAIRS) -> np.ndarray:
    """Terms (0 to buckets - 1, a row's in any order, each once) that reach `least` in a pair, for rows of the classes y (0 or 1)."""
    order = np.random.default_rng(len(y)).permutation(len(y))
    sizes = np.array([len(terms[i]) for i in order], np.float64)
    taken = np.sort(order[np.cumsum(sizes**2) <= most_pairs])
    y, terms = np.asarray(y)[taken].astype(np.int64), [terms[i] for i in taken]
    n = len(y)
    one = np.zeros((2, buckets), np.int64)
    for i in range(0, n, 512):
        for c in (0, 1):
            some = [t for t, k in zip(terms[i : i + 512], y[i : i + 512], strict=True) if k == c]
            if some:
                one[c] += np.bincount(np.concatenate(some), minlength=buckets)
    df = one.sum(0)
    h = _x_log_x(n)
    able = np.flatnonzero(2 * (h[n] - h[df] - h[n - df]) >= least) if n else np.zeros(0, np.int64)
    able = able[np.argsort(df[able], kind="stable")]
    if len(able) < 2 or not 0 < y.sum() < n:
        return able[:0]
    place = np.full(buckets, -1, np.int32)
    place[able] = np.arange(len(able), dtype=np.int32)
    kept = [np.sort(p[p >= 0]) for p in (place[t] for t in terms)]
    ptr = np.concatenate([[0], np.cumsum([len(t) for t in kept])])
    rows = y, ptr, np.concatenate(kept), one[:, able], least
    del kept, terms
    spark = SparkSession.getActiveSession()
    if spark is None:
        return able[_search(rows, 0, 1)]
    tasks = TASKS * spark.sparkContext.defaultParallelism
    sent = spark.sparkContext.broadcast(rows)  # at most the sample's terms, four bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_search(sent.value, first, tasks), pa.int64())], ["place"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(released(run), "place long").distinct().toArrow()["place"].to_numpy()  # as many as there are buckets at most
    sent.destroy()
    return np.sort(able[found])
