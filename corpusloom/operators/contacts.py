"""Contacts: look-ups, visibility, entity rows, sections, groups, and changes applied as change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .ids import with_dense_id

#: Mimetypes of entity rows, and the data columns that make up each kind's display string with their separator.
KINDS = {
    "name": (" ", ("data1", "data2", "data3")),
    "address": (",", ("data1", "data2", "data3", "data4")),
    "job": ("\n", ("data1", "data2", "data3")),
    "phone": ("", ("data1",)), "email": ("", ("data1",)), "tag": ("", ("data1",)), "group": ("", ("data1",)),
    "note": ("", ("data1",)), "website": ("", ("data1",)), "nickname": ("", ("data1",)),
}

#: Type and label that an insert adds to a row, by kind.
INSERT_LABELS = {"phone": ("custom", "phone"), "email": ("custom", "email"), "website": ("custom", "website"), "nickname": ("custom", "nickname"), "address": ("home", None), "job": ("work", None)}


def look_up(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values (null never equals)."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in equal.items())))


def unique_look_up(df: DataFrame, **equal) -> DataFrame:
    """At most one row; more than one is an error when the query runs."""
    found = look_up(df, **equal)
    only = F.when(F.count("*").over(W.partitionBy(F.lit(0))) > 1, F.raise_error("more than one row")).otherwise(F.lit(True))
    return found.limit(2).withColumn("__only", only).filter("__only").drop("__only")


def visible_to(is_public: Column, labels: Column, groups: Column, viewer: Column, viewer_labels: Column) -> Column:
    """Public, or labelled by the viewer, or in a group that equals one of the viewer's labels (device and text). Null groups or labels match nothing."""
    labelled = F.exists(labels, lambda x: x["device_id"] == viewer)
    grouped = F.arrays_overlap(groups, viewer_labels)
    return F.coalesce(is_public, F.lit(False)) | F.coalesce(labelled, F.lit(False)) | F.coalesce(grouped, F.lit(False))


def tagged_by(labels: Column, device: Column) -> Column:
    return F.coalesce(F.exists(labels, lambda x: x["device_id"] == device), F.lit(False))


def has_phone(phones: Column, number: Column) -> Column:
    """Whether a number is among the phones, hyphens aside."""
    return F.exists(phones, lambda p: T.phone(p) == T.phone(number))


def favourites(contacts: DataFrame, starred: Column, deleted: Column) -> DataFrame:
    """Contacts that are starred and not deleted; nulls are neither."""
    return contacts.filter(F.coalesce(starred, F.lit(False)) & ~F.coalesce(deleted, F.lit(False)))


def for_insert(rows: DataFrame) -> DataFrame:
    """Entity rows with the type and label that an insert gives their kind (columns `type` and `label`; null where it gives none)."""
    kind = F.col("mimetype")
    given = lambda i: reduce(lambda e, k: F.when(kind == k[0], F.lit(k[1][i]).cast("string")).otherwise(e), INSERT_LABELS.items(), F.lit(None).cast("string"))
    return rows.withColumn("type", given(0)).withColumn("label", given(1))


def equal_values(rows: DataFrame, others: DataFrame, ignored: tuple[str, ...] = ("raw_id",)) -> DataFrame:
    """The rows that equal one of the others in all values but the ignored ones; nulls equal nulls."""
    on = [c for c in rows.columns if c not in ignored]
    right = others.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct()
    return rows.join(right, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), "left_semi")


def display(rows: DataFrame) -> DataFrame:
    """Entity rows (raw_id, mimetype, data1, ...) with `shown`, the kind's display string."""
    kind = F.col("mimetype")
    shown = reduce(lambda e, k: F.when(kind == k[0], T.join_parts(k[1][0], *(T.or_empty(F.col(c)) for c in k[1][1]))).otherwise(e), KINDS.items(), F.lit(""))
    return rows.withColumn("shown", shown)


def contacts_of(rows: DataFrame) -> DataFrame:
    """(raw_id, name, phones, tags, groups) from entity rows; without a name there is no contact. Arrays are sorted."""
    shown = display(rows.filter(F.col("mimetype").isin("name", "phone", "tag", "group")))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("mimetype") == kind, F.col("shown"))))
    out = shown.groupBy("raw_id").agg(
        F.max(F.when(F.col("mimetype") == "name", F.col("shown"))).alias("name"), of("phone").alias("phones"), of("tag").alias("tags"), of("group").alias("groups")
    )
    return out.filter(F.length("name") > 0)


def entity_lists(rows: DataFrame) -> DataFrame:
    """(raw_id, mimetype, entities): the non-empty entities of each kind, sorted."""
    return display(rows).filter("shown <> ''").groupBy("raw_id", "mimetype").agg(F.array_sort(F.collect_list("shown")).alias("entities"))


def first_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in an ascending order; one aggregation, so a hot key is combined before the shuffle."""
    first = F.min_by(F.struct(*(c for c in df.columns if c != key)), F.struct(*order)).alias("__first")
    return df.groupBy(key).agg(first).select(key, "__first.*")


def last_wins(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key the values of its last row; one aggregation."""
    last = F.max_by(F.struct(*values), order).alias("__last")
    return df.groupBy(key).agg(last).select(key, *(F.col(f"__last.{v}").alias(v) for v in values))


def in_sections(contacts: DataFrame, name: str = "name", key: str = "id") -> DataFrame:
    """contacts with section, item and position: sections in order, names in a section by lower case, then key.

    item counts a section's names from 1; position is the place in a list in which each section begins with a header (the first
    header is 0). Names are numbered over the whole order, so a section with most of the names is no window of its own.
    """
    keyed = contacts.withColumn("section", T.name_section(F.col(name))).withColumn("__rank", T.section_order(F.col("section"))).withColumn("__lower", F.lower(name))
    numbered = with_dense_id(keyed, "__at", "__rank", "section", "__lower", name, key)
    starts = numbered.groupBy("section", "__rank").agg(F.min("__at").alias("__start"))  # some forty sections
    starts = starts.select("section", "__start", F.row_number().over(W.orderBy("__rank", "section")).alias("__headers"))
    out = numbered.join(F.broadcast(starts), "section")
    return out.withColumn("item", F.col("__at") - F.col("__start") + 1).withColumn("position", F.col("__at") + F.col("__headers")).drop("__rank", "__lower", "__at", "__start", "__headers")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_null: bool = True, fixed: tuple[str, ...] = ()) -> DataFrame:
    """old with new's rows inserted or merged by key. New nulls leave old values (keep_null); columns in `fixed` never change once set.

    Keys are unique in both; one full outer join.
    """
    joined = old.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in fixed:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif keep_null:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def count_up(counters: DataFrame, seen: DataFrame, keys: list[str], name: str = "times", first: int = 1) -> DataFrame:
    """Counters with occurrences added. A new key's first occurrence counts `first` (a local counter starts at 0, a server's at 1)."""
    added = seen.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = counters.join(added, keys, "full_outer")
    n, old = F.coalesce(F.col("__n"), F.lit(0)), F.col(name)
    return joined.select(*keys, F.when(old.isNull(), n - 1 + F.lit(first)).otherwise(old + n).cast("long").alias(name))


class ChangeSet:
    """Inserts, updates and deletes that are collected, may be taken back, and are applied at once; applying empties the set."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.changes: list[tuple[str, DataFrame, DataFrame | None]] = []

    def insert(self, rows: DataFrame) -> int:
        return self._add("insert", rows, None)

    def update(self, old: DataFrame, new: DataFrame) -> int:
        """Rows equal to those of `old` go, and those of `new` come."""
        return self._add("update", old, new)

    def delete(self, rows: DataFrame) -> int:
        return self._add("delete", rows, None)

    def _add(self, kind: str, rows: DataFrame, new: DataFrame | None) -> int:
        self.changes.append((kind, rows, new))
        return len(self.changes) - 1

    def remove(self, at: int) -> None:
        del self.changes[at]

    def apply(self, to: DataFrame) -> DataFrame:
        """The table after all changes, in order. Deletes match on all columns; nulls match nothing."""
        for kind, rows, new in self.changes:
            if kind in ("delete", "update"):
                to = to.join(rows.select(self.columns).distinct(), self.columns, "left_anti")
            if kind in ("insert", "update"):
                to = to.unionByName((new if new is not None else rows).select(self.columns))
        self.changes.clear()
        return to


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Without the rows for which the condition is true; rows for which it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def insert_group(groups: DataFrame, *new: tuple) -> DataFrame:
    """groups with new ones, given as rows of its columns."""
    return groups.unionByName(groups.sparkSession.createDataFrame(list(new), groups.schema))


def update_groups(groups: DataFrame, which: Column, **values) -> DataFrame:
    """groups with the given columns changed where `which` is true, by id or by label; where it is null rows stay."""
    hit = F.coalesce(which, F.lit(False))
    return groups.withColumns({c: F.when(hit, F.lit(v).cast(groups.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete_group(groups: DataFrame, members: DataFrame, label: Column, members_too: bool = True) -> tuple[DataFrame, DataFrame]:
    """(groups, members) without a group; clearing a name leaves the memberships (members_too False)."""
    gone = groups.filter(label).select("group_id")
    kept = groups.join(gone, "group_id", "left_anti")
    return kept, members.join(gone, "group_id", "left_anti") if members_too else members
