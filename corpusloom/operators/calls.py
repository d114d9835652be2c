"""Call logs resolved to friends and numbers, as if they came one after another.

A log says that a device called a number, for how many seconds and when. In the order of ids, each call
* adds to the edge from its device to the number's owner, if both the device's number and the owner are known;
* else, if one of the two is known, finds the counterpart: the earliest log that waits, of another device, equally long, at most the tolerance apart in time, that the known owner
  made or that went to the device's known number. Both directions are added, the log no longer waits, and what the two logs say is learned: the caller's number is the one
  that the owner called, or the number belongs to the counterpart's device. A device keeps its first number and a number its first owner;
* else waits.

What a call does depends on earlier calls only. So all calls are judged at once against what the last round found, again and again until
nothing changes: after each round every chain of dependence is right one step further, and the result is that of the sequence. Rounds are joins on devices, numbers and time
bins; there are as many as the longest chain of learning has steps, not as there are calls. A round keeps the calls that found a counterpart, not all calls, and asks again from the first
call on that the last one changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


@dataclass
class Resolved:
    edges: DataFrame  # src, dst, calls, minutes
    learned: DataFrame  # device, number, id: of the call that taught it
    waiting: DataFrame  # logs without a counterpart


#: Facts, or calls with a counterpart, up to which they are sent to the calls; beyond, both are shuffled.
MOST_SENT = 1_000_000
COLUMNS = ["id", "device", "number", "seconds", "at"]


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_SENT else df


def _facts(known: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(device, own, own_since) and (number, owner, owner_since): what is known from the start or was taught, and by which call."""
    taught = matched.filter("accepted").select(F.col("teach_device").alias("device"), F.col("teach_number").alias("number"), F.col("id").alias("since"))
    facts = written(known.select("device", "number", F.lit(-(2**63)).cast("long").alias("since")).unionByName(taught), "call-facts")
    n = facts.count()
    of_device = facts.groupBy("device").agg(F.min_by("number", "since").alias("own"), F.min("since").alias("own_since")).withColumn("own_key", F.col("own").cast("string"))
    of_number = facts.groupBy("number").agg(F.min_by("device", "since").alias("owner"), F.min("since").alias("owner_since")).withColumn("owner_key", F.col("owner").cast("string"))
    return _sent(of_device, n), _sent(of_number, n)


def _judged(calls: DataFrame, of_device: DataFrame, of_number: DataFrame) -> DataFrame:
    """calls with own and owner as they are known before each call, and both as texts (own_key, owner_key)."""
    e = calls.join(of_device, "device", "left").join(of_number, "number", "left")
    return e.select(*calls.columns, *(F.when(F.col(f"{c}_since") < F.col("id"), F.col(x)).alias(x) for c in ("own", "owner") for x in (c, f"{c}_key")))


def _round(calls: DataFrame, matched: DataFrame, known: DataFrame, tolerance: int, settled: int | None) -> DataFrame:
    """The calls that find a counterpart, with friend, partner, and what they teach, judged by the last round's; those up to `settled` are as they were.

    Only those are kept from round to round: which calls are known or wait follows from the facts. Logs are looked for by those handles alone that some call asks for, and before the last
    call that does; they are counted, and up to MOST_SENT go to the calls, which then stay where they are. More deal the calls out by handle, time and duration.
    """
    of_device, of_number = _facts(known, matched)
    width = 4 * tolerance + 1
    bin_of = lambda x: F.floor(x / F.lit(width))
    before = matched.limit(0) if settled is None else matched.filter(F.col("id") <= settled)
    new = calls.filter(~F.col("waits")) if settled is None else calls.filter(~F.col("waits") & (F.col("id") > settled))
    asking = _judged(new, of_device, of_number).filter(F.col("own").isNull() != F.col("owner").isNull())
    asked = written(asking.groupBy("own", "owner").agg(F.max("id").alias("last")), "calls-asked")  # of facts
    made, went = (asked.filter(F.col(c).isNotNull()).select(F.col(c).alias(to), F.col("last").alias(f"last_{to}")) for c, to in (("owner", "device"), ("own", "number")))
    asking = asking.select(F.col("owner").isNotNull().alias("made"), F.coalesce("owner_key", "own_key").alias("key"), bin_of(F.col("at")).alias("bin"), "seconds", "id", "device", "number", "at")

    n, m = matched.count(), asked.count()
    status = matched.select(F.col("partner").alias("log"), F.col("id").alias("consumed"), F.lit(False).alias("found")).unionByName(matched.select(F.col("id").alias("log"), F.lit(None).cast("long").alias("consumed"), F.lit(True).alias("found")))
    status = status.groupBy("log").agg(F.min("consumed").alias("consumed"), F.max("found").alias("found"))
    is_asked = lambda to: F.coalesce(F.col("id") < F.col(f"last_{to}"), F.lit(False))
    near = calls.join(_sent(made, m), "device", "left").join(_sent(went, m), "number", "left").select(*calls.columns, is_asked("device").alias("by_device"), is_asked("number").alias("by_number")).filter("by_device or by_number")
    logs = _judged(near, of_device, of_number).filter(F.col("waits") | F.col("own").isNull() | F.col("owner").isNull())
    handle = lambda of: F.when(F.col(f"by_{of}"), F.struct(F.lit(of == "device").alias("made"), F.col(of).cast("string").alias("key")))  # logs that a device made, or that went to a number
    bins = F.array_distinct(F.transform(F.array(F.lit(-tolerance), F.lit(tolerance)), lambda d: bin_of(F.col("at") + d)))
    logs = logs.select(F.col("id").alias("log"), F.col("device").alias("log_device"), F.col("number").alias("log_number"), "seconds", F.col("at").alias("log_at"), F.array_compact(F.array(handle("device"), handle("number"))).alias("handles"), bins.alias("bins"))
    logs = logs.join(_sent(status, 2 * n), "log", "left").filter(~F.coalesce("found", F.lit(False)))
    logs = written(logs.drop("found"), "calls-logs")
    rows = 4 * logs.count()  # two handles and two bins at most
    logs = logs.withColumn("want", F.explode("handles")).withColumn("bin", F.explode("bins")).select("want.made", "want.key", "bin", "seconds", "log", "log_device", "log_number", "log_at", "consumed")
    logs = _sent(logs, rows)

    earlier = (F.col("log") < F.col("id")) & (F.abs(F.col("at") - F.col("log_at")) <= tolerance) & (F.col("log_device") != F.col("device")) & (F.col("consumed").isNull() | (F.col("consumed") >= F.col("id")))
    where = ["made", "key", "bin", "seconds"]
    found = asking.join(logs, where).filter(earlier).groupBy(*where, "id").agg(F.first("device").alias("device"), F.first("number").alias("number"), F.min(F.struct("log", "log_device", "log_number")).alias("m"))
    made = F.col("made")
    found = found.select(
        "id", "device", "seconds", F.col("m.log_device").alias("friend"), F.col("m.log").alias("partner"), F.when(made, F.col("device")).otherwise(F.col("m.log_device")).alias("teach_device"),
        F.when(made, F.col("m.log_number")).otherwise(F.col("number")).alias("teach_number"),
    )
    found = found.join(of_device.select(F.col("device").alias("teach_device"), "own_since"), "teach_device", "left").join(of_number.select(F.col("number").alias("teach_number"), "owner_since"), "teach_number", "left")
    first = (F.col("own_since").isNull() | (F.col("own_since") >= F.col("id"))) & (F.col("owner_since").isNull() | (F.col("owner_since") >= F.col("id")))
    return before.unionByName(found.select(matched.columns[:-1] + [first.alias("accepted")]))


def _settled(last: DataFrame, now: DataFrame) -> int | None:
    """The first call of which two rounds say something else. Calls up to it are right in the later one, as a call depends on earlier ones only. None: both say the same."""
    both = last.unionByName(now).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("friend", "partner", "accepted").alias("kinds"))
    return both.filter("n < 2 or kinds > 1").agg(F.min("id")).first()[0]


def resolve_calls(calls: DataFrame, known: DataFrame, waiting: DataFrame | None = None, tolerance: int = 2000, most_rounds: int = 200) -> Resolved:
    """Calls (id, device, number, seconds, at) resolved in the order of their ids, after the known (device, number) and the logs that wait from before.

    id: a long of its own for each call, greater than those of the waiting logs; at: milliseconds. Calls with a null in any of these are left out. Devices and numbers in `known` are there
    once each. An empty table gives empty ones.
    """
    calls = written(calls.select(COLUMNS).dropna(), "calls")
    every = calls.withColumn("waits", F.lit(False))
    if waiting is not None:
        every = every.unionByName(waiting.select(COLUMNS).withColumn("waits", F.lit(True)))
    known = written(known.select("device", "number"), "known-numbers")
    device, number = (F.lit(None).cast(calls.schema[c].dataType) for c in ("device", "number"))
    matched = calls.limit(0).select("id", "device", "seconds", device.alias("friend"), F.lit(None).cast("long").alias("partner"), device.alias("teach_device"), number.alias("teach_number"), F.lit(False).alias("accepted"))
    settled = None
    for _ in range(most_rounds):
        last, matched = matched, written(_round(every, matched, known, tolerance, settled), "calls-matched")
        settled = _settled(last, matched)
        if settled is None:
            break
    else:
        raise RuntimeError(f"calls did not settle in {most_rounds} rounds")
    e = _judged(every, *_facts(known, matched))
    both = F.col("own").isNotNull() & F.col("owner").isNotNull()
    ends = matched.select("device", "friend", "seconds").unionByName(matched.select(F.col("friend").alias("device"), F.col("device").alias("friend"), "seconds"))
    ends = e.filter(~F.col("waits") & both).select("device", F.col("owner").alias("friend"), "seconds").unionByName(ends)
    edges = ends.groupBy(F.col("device").alias("src"), F.col("friend").alias("dst")).agg(F.count("*").alias("calls"), F.sum(T.minutes(F.col("seconds"))).alias("minutes"))
    gone = matched.select(F.explode(F.array("id", "partner")).alias("id"))
    left = e.filter(F.col("waits") | ~both).select(COLUMNS).join(gone, "id", "left_anti")
    learned = matched.filter("accepted").select(F.col("teach_device").alias("device"), F.col("teach_number").alias("number"), "id")
    return Resolved(edges, learned, left)
