"""Tables that change together, keyed tables, and the streams that use them."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calls as C
from corpusloom.operators import shares as H
from corpusloom.sources import sinks as W
from corpusloom.sources.store import Conflict, KeyedTable, Store
from corpusloom.streaming import events as ST


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_two_writers_keep_both_or_one_is_refused(spark, tmp_path):
    one, other = (W.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.write(spark.range(1))
    a, b = one.read(), other.read()
    assert one.write(a.unionByName(spark.range(10, 11))) == 2
    with pytest.raises(Conflict):
        other.write(b.unionByName(spark.range(20, 21)))
    assert other.write(other.read().unionByName(spark.range(20, 21))) == 3
    assert numbers(one.read()) == [0, 10, 20]


def test_versions_are_made_once(spark, tmp_path):
    """Many writers at once: every version has one, and no append is lost."""
    store, failed = Store(spark, str(tmp_path / "s")), []

    def add(i):
        try:
            Store(spark, store.path).run(lambda t: t.append("rows", spark.range(i, i + 1)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and numbers(store.read("rows")) == list(range(6)) and store.latest() == 6


def test_transactions_change_tables_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.run(lambda t: (t.write("a", spark.range(2)), t.write("b", spark.range(3)), t.set_note("batch", 1)))
    held = store.begin()
    t = store.begin()
    t.write("a", t.read("b"))
    t.append("b", spark.range(7, 8))
    assert numbers(store.read("a")) == [0, 1] and t.commit() == 2
    assert numbers(store.read("a")) == [0, 1, 2] and numbers(store.read("b")) == [0, 1, 2, 7] and store.notes() == {"batch": 1}
    assert numbers(held.read("a")) == [0, 1] and numbers(store.read("b", 1)) == [0, 1, 2]  # a version stays as it was
    held.append("c", spark.range(1))  # it read a, which has changed since
    with pytest.raises(Conflict):
        held.commit()
    early = store.begin()
    store.run(lambda t: t.append("a", spark.range(9, 10)))
    early.write("c", spark.range(5, 6))  # leaves alone what the other changed
    assert early.commit() == 4 and numbers(store.read("c")) == [5] and numbers(store.read("a")) == [0, 1, 2, 9]
    tries = []

    def change(t):
        tries.append(1)
        rows = t.read("c")
        if len(tries) == 1:
            store.run(lambda u: u.append("c", spark.range(6, 7)))
        t.write("c", rows.unionByName(spark.range(8, 9)))

    store.run(change)
    assert numbers(store.read("c")) == [5, 6, 8] and len(tries) == 2 and store.begin().commit() == store.latest()


def test_a_version_that_was_begun_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), patience=0.1)
    store.run(lambda t: t.write("a", spark.range(1)))
    (tmp_path / "s" / "versions" / f"{2:012d}").write_text("")
    with pytest.raises(Conflict, match="begun"):
        store.read("a")


def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    table = KeyedTable(store, "t", ["k"], 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    last = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new)
    store.run(lambda t: table.merge(t, rows(*((i, "a") for i in range(200))), last))
    before = store.manifest(1)["tables"]["t"]
    store.run(lambda t: table.merge(t, rows((3, "b"), (500, "c")), last))
    after = store.manifest(2)["tables"]["t"]
    assert len(before) == len(after) == 8 and 6 <= len(set(before) & set(after)) < 8
    assert sorted(map(tuple, table.read(store.begin()).collect())) == sorted([(i, "b" if i == 3 else "a") for i in range(200)] + [(500, "c")])
    store.run(lambda t: table.merge(t, rows().limit(0), last))
    assert store.latest() == 2


def batches(spark, path, rows, schema, each):
    for i in range(0, len(rows), each):
        spark.createDataFrame(rows[i : i + each], schema).coalesce(1).write.parquet(str(path / f"b{i:05d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def calls_in_turn(calls, known, tolerance):
    """(edges, numbers, waiting) by the rules, one call after another."""
    number, owner = dict(known), {n: d for d, n in known}
    waiting, edges = [], {}

    def add(a, b, seconds):
        n, m = edges.get((a, b), (0, 0.0))
        edges[a, b] = n + 1, m + seconds / 60

    for e in sorted(calls):
        _, d, m, seconds, at = e
        own, friend = number.get(d), owner.get(m)
        if own is not None and friend is not None:
            add(d, friend, seconds)
            continue
        fits = lambda w: w[3] == seconds and abs(w[4] - at) <= tolerance and w[1] != d and (w[1] == friend if friend is not None else own is not None and w[2] == own)  # noqa: B023, E731
        log = next((w for w in waiting if fits(w)), None)
        if log is None:
            waiting.append(e)
            continue
        waiting.remove(log)
        add(d, log[1], seconds)
        add(log[1], d, seconds)
        device, new = (d, log[2]) if own is None else (log[1], m)
        if device not in number and new not in owner:
            number[device], owner[new] = new, device
    return {k: (n, round(x, 6)) for k, (n, x) in edges.items()}, number, sorted(waiting)


CALLS = "id long, device long, number long, seconds long, at long"


def some_calls(seed, n=160, devices=9):
    draw = random.Random(seed)
    return [(i, draw.randrange(devices), draw.randrange(devices + 2), draw.randrange(2), i * 300 + draw.randrange(-400, 400)) for i in range(n)]


def test_calls_equal_the_sequence(spark):
    calls, known = some_calls(1), [(0, 0), (1, 1), (2, 2)]
    got = C.resolve_calls(spark.createDataFrame([*calls, (None, 1, 1, 1, 1), (900, None, 1, 1, 1)], CALLS), spark.createDataFrame(known, "device long, number long"), tolerance=1500)
    edges, number, waiting = calls_in_turn(calls, known, 1500)
    assert {(r.src, r.dst): (r.calls, round(r.minutes, 6)) for r in got.edges.collect()} == edges and edges
    assert dict(known) | {r.device: r.number for r in got.learned.collect()} == number and len(number) > 3
    assert sorted(map(tuple, got.waiting.collect())) == waiting


def test_a_round_of_calls_writes_what_was_found(spark, monkeypatch):
    """Calls are written once; rounds write facts and calls with a counterpart, not all calls."""
    calls, rows = some_calls(1) + [(1000 + i, 500 + i, 700 + i, 0, i) for i in range(500)], {}
    keep = C.written
    monkeypatch.setattr(C, "written", lambda df, name: rows.setdefault(name, []).append(keep(df, name)) or rows[name][-1])
    C.resolve_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "device long, number long"), tolerance=1500)
    counts = [df.count() for dfs in rows.values() for df in dfs]
    assert counts[0] == len(calls) and max(counts[1:]) < 160


def test_logs_that_no_call_asks_for_stay_out_of_the_join(spark, monkeypatch):
    """Calls of unknown devices to a known number wait by the hundred, but only what the number's owner did is asked for."""
    calls, rows, keep = [(0, 0, 8, 1, 0)] + [(i, 5 + i % 50, 0, i % 3, i * 10) for i in range(1, 300)], {}, C.written
    monkeypatch.setattr(C, "written", lambda df, name: rows.setdefault(name, []).append(keep(df, name)) or rows[name][-1])
    got = C.resolve_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(0, 0)], "device long, number long"), tolerance=1500)
    edges, number, waiting = calls_in_turn(calls, [(0, 0)], 1500)
    assert {(r.src, r.dst): (r.calls, round(r.minutes, 6)) for r in got.edges.collect()} == edges and len(edges) > 1
    assert sorted(map(tuple, got.waiting.collect())) == waiting
    assert rows["calls-logs"][0].count() == 1 and max(df.count() for df in rows["calls-asked"]) <= 2


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_rounds_ask_again_from_the_first_call_that_changed(spark, monkeypatch, sent):
    monkeypatch.setattr(C, "MOST_SENT", sent)
    calls, known, settled, find = some_calls(7, 120), [(0, 0), (1, 1), (2, 2)], [], C._settled
    monkeypatch.setattr(C, "_settled", lambda last, now: settled.append(find(last, now)) or settled[-1])
    got = C.resolve_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(known, "device long, number long"), tolerance=1500)
    edges, number, waiting = calls_in_turn(calls, known, 1500)
    assert {(r.src, r.dst): (r.calls, round(r.minutes, 6)) for r in got.edges.collect()} == edges
    assert dict(known) | {r.device: r.number for r in got.learned.collect()} == number and sorted(map(tuple, got.waiting.collect())) == waiting
    assert len(settled) > 3 and settled[-1] is None and settled[:-1] == sorted(settled[:-1])


def test_call_stream_equals_the_sequence(spark, tmp_path):
    """Batches cut the sequence anywhere; a batch that comes again changes nothing."""
    calls, known = some_calls(3, 60), [(0, 0), (1, 1), (2, 2)]
    store = Store(spark, str(tmp_path / "store"))
    store.run(lambda t: t.write("numbers", spark.createDataFrame(known, "device long, number long")))
    ST.resolve_call_stream(batches(spark, tmp_path / "in", calls, CALLS, 30), store, str(tmp_path / "c"), 1500, buckets=4).awaitTermination()
    edges, number, waiting = calls_in_turn(calls, known, 1500)
    found = KeyedTable(store, "edges", ["src", "dst"]).read(store.begin())
    assert {(r.src, r.dst): (r.calls, round(r.minutes, 6)) for r in found.collect()} == edges
    assert {r.device: r.number for r in store.read("numbers").collect()} == number and sorted(map(tuple, store.read("waiting").select("id", "device", "number", "seconds", "at").collect())) == waiting
    version = store.latest()
    ST._once(store, "calls", lambda t, b: 1 / 0)(spark.createDataFrame(calls[:3], CALLS), 0)
    assert store.latest() == version


SHARES = "id long, device string, number string, name string, email string, address string, city string, labels array<string>, groups array<string>"


def some_shares(seed, n=60):
    draw = random.Random(seed)
    pick = lambda name, k: draw.choice([None, *(f"{name}{i}" for i in range(k))])
    return [(i, f"d{draw.randrange(3)}", pick("n", 9), pick("x", 4), pick("e", 9), pick("a", 2), pick("c", 3), draw.choice([None, ["u", "v"], ["v"], []]), draw.choice([None, ["g"], ["h", "g"]])) for i in range(n)]


def contacts_in_turn(shares):
    """Contacts by the rules, one share after another, in a plain list."""
    found = []
    for i, device, number, name, email, address, city, labels, groups in shares:
        c = next((c for c in found if number is not None and c["number"] == number), None)
        c = c or next((c for c in found if email is not None and c["email"] == email), None)
        if c is None:
            c = {"contact": i, "email": None, "name": None, "number": None, "address": None, "city": city, "is_public": False, "labels": [], "groups": []}
            found.append(c)
        c |= {k: v for k, v in {"name": name, "email": email, "number": number, "address": address}.items() if v is not None}
        for key, new in (("labels", labels), ("groups", groups)):
            for x in new or []:
                if (device, x) not in c[key]:
                    c[key].append((device, x))
        c["is_public"] = c["is_public"] or groups is None
    return sorted((tuple(c[k] if k not in ("labels", "groups") else tuple(c[k]) for k in ("contact", "email", "name", "number", "address", "city", "is_public", "labels", "groups")) for c in found), key=str)


def contact_rows(df):
    return sorted(((*tuple(r)[:7], tuple(map(tuple, r.labels)), tuple(map(tuple, r.groups))) for r in df.select("contact", "email", "name", "number", "address", "city", "is_public", "labels", "groups").collect()), key=str)


def test_shares_equal_the_sequence(spark):
    """In one batch, and in two."""
    shares = some_shares(1)
    want = contacts_in_turn(shares)
    frame = lambda rows: spark.createDataFrame(rows, SHARES)
    assert contact_rows(H.share_contacts(None, frame(shares))[0]) == want
    first = H.share_contacts(None, frame(shares[:25]))[0]
    changed, rest = H.share_contacts(first, frame(shares[25:]))
    assert contact_rows(changed.unionByName(rest)) == want
    assert contact_rows(H.share_contacts(None, frame(shares[:0]))[0]) == []


def test_shares_of_one_component_meet_whatever_join_is_chosen(spark):
    """Rows of one component stay in one task where a join is found small enough to broadcast only as it runs."""
    shares = [(*s[:3], f"name{s[0]}", s[4] and f"{s[0] % 40}{s[4]}", *s[5:]) for s in some_shares(3, 3000)]
    shares = [(*s[:2], s[2] and f"{s[0] % 40}{s[2]}", *s[3:]) for s in shares]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "4000", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1000000", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame = lambda rows: spark.createDataFrame(rows, SHARES).repartition(8)
        assert contact_rows(H.share_contacts(None, frame(shares))[0]) == contacts_in_turn(shares)
        first = H.share_contacts(None, frame(shares[:2000]))[0]
        changed, rest = H.share_contacts(first, frame(shares[2000:]))
        assert contact_rows(changed.unionByName(rest)) == contacts_in_turn(shares)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_share_stream_equals_the_sequence(spark, tmp_path):
    shares, store = some_shares(5, 30), Store(spark, str(tmp_path / "store"))
    ST.share_stream(batches(spark, tmp_path / "in", shares, SHARES, 15), store, str(tmp_path / "c"), 4).awaitTermination()
    assert contact_rows(KeyedTable(store, "contacts", ["contact"]).read(store.begin())) == contacts_in_turn(shares)


def test_ties_go_through_chains(spark):
    rows = [(i, str(i // 2), str((i + 1) // 2)) for i in range(200)] + [(500, None, None), (501, "500", None), (502, None, "500")]
    got = dict(map(tuple, H.tied(spark.createDataFrame(rows, "k long, a string, b string"), "k", "a", "b").collect()))
    want, changed = {r[0]: r[0] for r in rows}, True
    while changed:
        changed = False
        for x in rows:
            for y in rows:
                if (x[1] is not None and x[1] == y[1]) or (x[2] is not None and x[2] == y[2]):
                    low = min(want[x[0]], want[y[0]])
                    changed |= want[x[0]] != low or want[y[0]] != low
                    want[x[0]] = want[y[0]] = low
    assert got == want


def test_old_versions_read_as_they_were(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(3):
        store.run(lambda t, i=i: t.append("x", spark.range(i, i + 1).withColumn("extra", F.lit(i))))
    assert [store.read("x", v).count() for v in (1, 2, 3)] == [1, 2, 3] and store.read("y") is None


def test_upload_keeps_its_mark(spark, tmp_path, monkeypatch):
    store, log = Store(spark, str(tmp_path / "s")), lambda *at: spark.createDataFrame([(x,) for x in at], "at long")
    assert ST.upload_new(log(), store, "log") == 0 and store.read("log") is None
    assert ST.upload_new(log(3, 1, None), store, "log") == 1
    again = Store(spark, store.path)
    assert ST.upload_new(log(1, 3, 5, 4), again, "log") == 2 and ST.upload_new(log(1, 3, 5, 4), again, "log") == 2
    assert numbers(store.read("log")) == [1, 3, 4, 5] and store.notes() == {"mark:log": 5}
    publish, tries = Store._publish, []

    def beaten(self, *a):  # another upload of the same rows comes first
        tries.append(1)
        if len(tries) == 1:
            ST.upload_new(log(5, 7), store, "log")
        return publish(self, *a)

    monkeypatch.setattr(Store, "_publish", beaten)
    ST.upload_new(log(5, 7, 8), again, "log")
    assert numbers(store.read("log")) == [1, 3, 4, 5, 7, 8] and store.notes() == {"mark:log": 8}
