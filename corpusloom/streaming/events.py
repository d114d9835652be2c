"""Structured Streaming forms of the event operators.

Times are event times; watermarks are this library's addition (without one, unmatched calls would be kept
for ever). Each function takes a streaming DataFrame and gives one, or a started query where a sink is part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import calls as C
from ..operators import contacts as K
from ..operators import shares as H
from ..operators import social as S
from ..sources.readers import incremental
from ..sources.shared import written
from ..sources.sinks import VersionedTable, merge_batches, transactions
from ..sources.store import KeyedTable, Store, Transaction


def pair_calls(calls: DataFrame, equal: list[str], at: str = "ts", key: str = "id", tolerance: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """All pairs (key, other) of calls that agree in `equal` with times at most `tolerance` apart, each pair once, as a stream-stream interval join."""
    left = calls.withWatermark(at, late).select(*equal, F.col(key), F.col(at))
    right = left.select(*(F.col(c).alias(f"r_{c}") for c in [*equal, key, at]))
    near = F.col(f"r_{at}").between(F.col(at) - F.expr(f"INTERVAL {tolerance}"), F.col(at) + F.expr(f"INTERVAL {tolerance}"))
    same = [F.col(c) == F.col(f"r_{c}") for c in equal]
    on = near & (F.col(key) < F.col(f"r_{key}"))
    for c in same:
        on = on & c
    return left.join(right, on).select(F.col(key), F.col(f"r_{key}").alias("other"), F.col(at), F.col(f"r_{at}").alias("other_at"))


def running_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counters by key, for update mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("times"))


def windowed_counts(events: DataFrame, keys: list[str], at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counters by key and window; windows close when the watermark has passed them."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("times")).select(F.col("w.start").alias("start"), *keys, "times")


_EDGE = "src string, dst string, calls long, minutes double"


def call_edges(calls: DataFrame, tolerance_ms: int = 2000, keep_ms: int = 60_000) -> DataFrame:
    """Friend edges from call logs as they come: (src, dst, calls, minutes), in update mode, for each matched pair of logs.

    calls: (pair, device, other, seconds, at): `pair` is the unordered pair of numbers as text, `device` the caller, `at` the time in milliseconds. A log
    waits for its counterpart (same pair, other device, same seconds, at most the tolerance apart), and both
    directions are added. The watermark is keep_ms behind the latest log; once it has passed a pair's waiting logs, they go, also when the pair never speaks
    again, so state holds the last keep_ms only.
    """
    # one millisecond on: rows of the first watermark's own time, which is 0, would count as late
    timed = calls.withColumn("event_time", F.timestamp_millis(F.col("at").cast("long") + 1)).withWatermark("event_time", f"{keep_ms} milliseconds")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in state.get[0]] if state.exists else []
        edges: dict[tuple[str, str], list[float]] = {}
        if not state.hasTimedOut:
            for batch in batches:
                for device, other, seconds, at in batch.sort_values(["at", "device"])[["device", "other", "seconds", "at"]].itertuples(index=False):
                    match = next((w for w in waiting if w[0] != device and w[1] == seconds and abs(w[2] - at) <= tolerance_ms), None)
                    if match is None:
                        waiting.append((device, int(seconds), int(at)))
                        continue
                    waiting.remove(match)
                    for edge in ((device, other), (other, device)):
                        total = edges.setdefault(edge, [0, 0.0])
                        total[0] += 1
                        total[1] += seconds / 60.0
        passed = state.getCurrentWatermarkMs() - 1
        waiting = [w for w in waiting if w[2] + tolerance_ms >= passed]
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(passed + 2, min(w[2] for w in waiting) + tolerance_ms + 2))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(a, b, n, m) for (a, b), (n, m) in edges.items()], columns=["src", "dst", "calls", "minutes"])

    return timed.groupBy("pair").applyInPandasWithState(step, _EDGE, "waiting array<struct<device:string,seconds:long,at:long>>", "update", GroupStateTimeout.EventTimeTimeout)


def merge_shares(shares: DataFrame, target: VersionedTable, checkpoint: str, key: str = "id", fixed: tuple[str, ...] = ("city",)) -> StreamingQuery:
    """Shared contacts merged by key into a table: within a batch the last of a key counts, known fields replace, `fixed` ones never change."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        columns = [c for c in batch.columns if c not in (key, "ts")]
        latest = batch.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns))
        return latest if old is None else K.upsert(old, latest, [key], fixed=fixed)

    return shares.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge_batches(target, merge)).start()


def label_events(labels: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Label events (tagger, id, labels array, ts) to three tables of a store in one commit a batch: `log`, to which batches are added, `labels`, each contact's distinct ones, and
    `pairs`, tag pair counts. A reader of any version sees all three as of the same batch."""

    def add_labels(old, batch):
        new = batch.select("id", F.explode("labels").alias("label")).distinct()
        return new if old is None else old.unionByName(new).distinct()

    def add_pairs(old, batch):
        new = S.tag_pairs(batch.withColumn("event", F.monotonically_increasing_id()).select("event", F.explode("labels").alias("tag")), "event", "tag")
        return new if old is None else old.unionByName(new).groupBy("tag", "related_tag").agg(F.sum("value").alias("value"))

    run = transactions(store, {"labels": add_labels, "pairs": add_pairs}, {"log": lambda batch: batch})
    return labels.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def _once(store: Store, name: str, change: Callable[[Transaction, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: change(transaction, batch) and the batch's number in one commit; a batch that comes again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:

            def commit(t: Transaction) -> None:
                last = t.note(name)
                if (last is None or last < batch_id) and not batch.isEmpty():
                    change(t, batch)
                    t.set_note(name, batch_id)

            store.run(commit)
        finally:
            batch.unpersist()

    return run


def resolve_call_stream(calls: DataFrame, store: Store, checkpoint: str, tolerance: int = 2000, keep_ms: int | None = None, buckets: int = 16) -> StreamingQuery:
    """Call logs (id, device, number, seconds, at) resolved as they come, as `resolve_calls` does for all at once: ids rise from batch to batch.

    The store's tables `numbers` (device, number), `waiting` (logs) and `edges` (src, dst, calls, minutes) change in one commit a batch; edges are a keyed table, of which a batch rewrites
    the buckets it touches. keep_ms: waiting logs go when the latest log is that much later; None keeps them for ever.
    """
    edges = KeyedTable(store, "edges", ["src", "dst"], buckets)

    def change(t: Transaction, batch: DataFrame) -> None:
        numbers = t.read("numbers")
        known = batch.limit(0).select("device", "number") if numbers is None else numbers
        found = C.resolve_calls(batch, known, t.read("waiting"), tolerance)
        edges.merge(t, found.edges, lambda old, new: old.unionByName(new).groupBy("src", "dst").agg(F.sum("calls").alias("calls"), F.sum("minutes").alias("minutes")))
        t.append("numbers", found.learned.select("device", "number"))
        left = found.waiting
        if keep_ms is not None:
            left = left.filter(F.col("at") >= batch.agg(F.max("at")).first()[0] - keep_ms)
        t.write("waiting", left)

    return calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(_once(store, "calls", change)).start()


def share_stream(shares: DataFrame, store: Store, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Share events, as `share_contacts` takes them, merged into the store's keyed table `contacts` as they come; ids rise from batch to batch."""
    table = KeyedTable(store, "contacts", ["contact"], buckets)

    def change(t: Transaction, batch: DataFrame) -> None:
        changed, _ = H.share_contacts(table.read(t), batch)
        table.merge(t, written(changed, "shared"), lambda old, new: old.join(new.select("contact"), "contact", "left_anti").unionByName(new))

    return shares.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(_once(store, "shares", change)).start()


def upload_new(rows: DataFrame, store: Store, name: str, at: str = "at") -> int:
    """Append the rows after the store's mark to a table, and keep the latest row's `at` (a whole number) as the new mark, in one commit; gives the version.

    What failed before the commit left the mark where it was and is sent again; what was committed is not. Rows with a null `at` are never sent. Two uploads at once don't send a row twice.
    """

    def change(t: Transaction) -> None:
        mark = t.note(f"mark:{name}")
        new, latest = incremental(rows.filter(F.col(at).isNotNull()), at, mark)
        if latest is not None and latest != mark:
            t.append(name, new.filter(F.col(at) <= latest))  # the source may have grown since
            t.set_note(f"mark:{name}", latest)

    return store.run(change)
