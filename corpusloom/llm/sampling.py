"""Bounded samples and thresholds that stay bounded at any size: neither moves more rows than it keeps, but for a small factor."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of a batch that is sent to Python while small_batches holds.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_lock = threading.Lock()
_held: dict[int, tuple[int, dict[str, str | None]]] = {}  # by session: users, and the settings before the first of them


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside send few rows and bytes at once to Python: texts and sets are long, and a worker holds a batch several times over.

    Threads of one session may be inside together; the last one out restores the settings.
    """
    with _lock:
        users, before = _held.get(id(spark), (0, {}))
        if not users:
            before = {key: spark.conf.get(key, None) for key in BATCH}
            for key, value in BATCH.items():
                spark.conf.set(key, value)
        _held[id(spark)] = users + 1, before
    try:
        yield
    finally:
        with _lock:
            users, before = _held.pop(id(spark))
            if users > 1:
                _held[id(spark)] = users - 1, before
            else:
                for key, value in before.items():
                    if value is None:
                        spark.conf.unset(key)
                    else:
                        spark.conf.set(key, value)


def hash_sample(df: DataFrame, key: str, most: int, n: int, salt: int = 0) -> DataFrame:
    """At most `most` of the n rows of df, those whose keys hash lowest.

    Rows beyond a hash bound are dropped where they are read, so that about twice as many as wanted reach the top-n, not that
    many from every task.
    """
    h = F.xxhash64(key, F.lit(salt))
    if n > 2 * most:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * 2 * most / n) + 1)
    return df.orderBy(F.pmod(h, F.lit(1 << 31)), h, key).limit(most)


def at_least(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df with the highest counts, as many whole steps of about one per cent of the count as make at most `most` rows.

    Steps are counted first, which are some thousands however large counts are.
    """
    step = F.floor(F.log2(F.col(count)) * 64)
    taken, least = 0, None
    for r in df.filter(F.col(count) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if taken + r.n > most:
            break
        taken, least = taken + r.n, r.step
    return df.limit(0) if least is None else df.filter((F.col(count) > 0) & (step >= least))
