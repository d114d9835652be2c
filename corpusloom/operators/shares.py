"""Shared contacts: each share event finds its contact by number, else by email, else makes one, one event after another.

Only events and contacts that are tied by numbers or emails can touch each other. They are found as connected components, the components are dealt to tasks, and each task
reads its events in order, holding the contacts of one component at a time: memory is bounded by a component's contacts, not by its events. Rows of one component
are in one task, as what an event finds depends on what the events before it changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .components import components

FIELDS = ("name", "email", "number", "address")
#: Contacts that a task sends on together.
BATCH = 2000
_TAG = "array<struct<device:string,label:string>>"
CONTACTS = f"contact long, email string, name string, number string, address string, city string, is_public boolean, labels {_TAG}, groups {_TAG}"


def _first_value(key: str, *names: str) -> Column:
    """The name of a row's first value, or one of the row's own where it has none."""
    return F.coalesce(*(F.when(F.col(n).isNotNull(), F.xxhash64(F.lit(n), F.col(n).cast("string"))) for n in names), F.xxhash64(F.lit("row"), F.col(key)))


def grouped(rows: DataFrame, key: str, *names: str, rounds: int = 60) -> DataFrame:
    """rows with a column root: rows that share a value in one of the columns, directly or through others, have one root. Null values tie nothing.

    Values are nodes, and a row ties its own: pairs of values are far fewer and narrower than rows, and a value that very many rows share is one node. Values are named by
    64-bit hashes; should two ever share a name, their rows have one root as well. Rows come in no order, and rows of one root from many partitions.
    """
    values = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.xxhash64(F.lit(n), F.col(n).cast("string"))) for n in names)))
    edges = rows.select(values.alias("v")).filter("size(v) > 1").select(F.col("v")[0].alias("u"), F.explode(F.slice("v", 2, len(names))).alias("v"))
    least = components(edges, rounds).filter("node <> root").withColumnRenamed("root", "__least")
    named = rows.withColumn("node", _first_value(key, *names))
    return named.join(least, "node", "left").withColumn("root", F.coalesce("__least", "node")).drop("node", "__least")


def tied(rows: DataFrame, key: str, *names: str, rounds: int = 60) -> DataFrame:
    """(key, root): rows that are tied as `grouped` has it get one root, their least key."""
    roots = written(grouped(rows.select(key, *names), key, *names, rounds=rounds).select(key, "root"), "tied")
    return roots.join(roots.groupBy("root").agg(F.min(key).alias("least")), "root").select(key, F.col("least").alias("root"))


class _Book:
    """The contacts of one component."""

    def __init__(self):
        self.rows: dict[int, dict] = {}
        self.by: dict[str, dict[str, set[int]]] = {"number": {}, "email": {}}

    def put(self, contact: int, **values) -> None:
        row = self.rows.setdefault(contact, {"contact": contact, "is_public": False, "labels": [], "groups": [], **dict.fromkeys((*FIELDS, "city"))})
        for name in self.by:
            if values.get(name) is not None and values[name] != row[name]:
                if row[name] is not None:
                    self.by[name][row[name]].discard(contact)
                self.by[name].setdefault(values[name], set()).add(contact)
        row.update(values)

    def find(self, name: str, value: str | None) -> int | None:
        found = self.by[name].get(value) if value is not None else None
        return min(found) if found else None

    def share(self, e) -> None:
        contact = self.find("number", e.number)
        if contact is None:
            contact = self.find("email", e.email)
        if contact is None:
            contact = e.contact
            self.put(contact, city=e.city)
        self.put(contact, **{f: getattr(e, f) for f in FIELDS if getattr(e, f) is not None})
        row = self.rows[contact]
        for name, new in (("labels", e.labels), ("groups", e.groups)):
            tags = [(t["device"], t["label"]) for t in ([] if new is None else new)]
            row[name] = row[name] + [t for t in dict.fromkeys(tags) if t not in set(row[name])]
        row["is_public"] = bool(row["is_public"] or e.groups is None)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contacts after their component's events; rows come by component, known contacts before events, events in order."""
    names = [c.split()[0] for c in CONTACTS.replace("struct<device:string,label:string>", "x").split(", ")]
    root, book, done = None, _Book(), []

    def rows(found: list[dict]) -> pd.DataFrame:
        tags = lambda x: [{"device": d, "label": t} for d, t in x]
        return pd.DataFrame([{**r, "labels": tags(r["labels"]), "groups": tags(r["groups"])} for r in found], columns=names)

    for batch in batches:
        for e in batch.itertuples(index=False):
            if e.root != root:
                done += book.rows.values()
                root, book = e.root, _Book()
                if len(done) >= BATCH:
                    yield rows(done)
                    done = []
            if e.known:
                tags = lambda x: [(t["device"], t["label"]) for t in x] if x is not None else []
                book.put(e.contact, is_public=bool(e.is_public), city=e.city, labels=tags(e.labels), groups=tags(e.groups), **{f: getattr(e, f) for f in FIELDS})
            else:
                book.share(e)
    yield rows(done + [*book.rows.values()])


def share_contacts(contacts: DataFrame | None, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, gone_by): the contacts that the shares made or touched, and those of `contacts` that no share could reach.

    shares: (id, device, number, name, email, address, city, labels, groups), ids in order and greater than all contacts; labels and groups are arrays of strings, null groups make
    the contact public. A new contact has its event's id. Known fields replace old ones, nulls don't, the city never changes; labels and groups are added once each, in order, with the device
    that gave them. Of several contacts with one email the first is found. Both results have the columns of CONTACTS and together are the contacts from then on.
    """
    spark = shares.sparkSession
    text = lambda c: F.col(c).cast("string").alias(c)
    tags = lambda c: F.transform(c, lambda x: F.struct(F.col("device").cast("string").alias("device"), x.cast("string").alias("label"))).alias(c)
    events = shares.select(F.lit(False).alias("known"), F.col("id").cast("long").alias("contact"), *map(text, ("email", "name", "number", "address", "city")), F.lit(None).cast("boolean").alias("is_public"), tags("labels"), tags("groups"))
    old = spark.createDataFrame([], CONTACTS) if contacts is None else contacts
    rows = grouped(written(events.unionByName(old.withColumn("known", F.lit(True))), "shares"), "contact", "number", "email")
    if contacts is None:
        reached, rest = rows, old
    else:
        rows = written(rows, "shares-tied")
        asked = rows.filter("not known").select("root").distinct()
        reached = rows.join(asked, "root", "left_semi")
        rest = rows.filter("known").join(asked, "root", "left_anti").select([f.name for f in old.schema.fields])
    # Written before they are dealt out: behind a join on the root Spark takes the join's partitions for those asked for, and adaptive execution may then read them otherwise.
    dealt = written(reached, "shares-reached").repartition("root").sortWithinPartitions("root", F.desc("known"), "contact")
    return dealt.mapInPandas(_fold, CONTACTS), rest
