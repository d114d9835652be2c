"""Sinks: reports, text files, XML, atomic tables and idempotent stream batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .store import Store, Transaction


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text, one value a line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_matrix(wide: DataFrame, path: str, digits: int = 10) -> None:
    """A matrix as CSV: numbers with fixed digits, a comma after each."""
    cells = [F.concat(F.format_string(f"%.{digits}f", F.col(f"`{c}`").cast("double")), F.lit(",")) for c in wide.columns]
    wide.select(F.concat(*cells).alias("value")).write.mode("overwrite").text(path)


def write_ids(df: DataFrame, id_col: str, name: str, path: str) -> None:
    """Names (documents, words, entities) as text in ascending order of their ids."""
    df.repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.col(name).alias("value")).write.mode("overwrite").text(path)


def corpus_report(stats: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, counts in descending order)."""
    return stats, counts.orderBy(F.desc("cnt"), "token")


def xml_rows(df: DataFrame, root: str, columns: list[str]) -> Column:
    """One XML element a row with an element for each column; nulls are empty elements, reserved characters are escaped."""
    return F.concat(F.lit(f"<{root}>"), *(T.xml_element(c, F.col(c).cast("string")) for c in columns), F.lit(f"</{root}>"))


class VersionedTable:
    """A table whose every write is a new version, so readers see the old or the new whole.

    A write after a read goes on from the version that was read: if another writer has published since, it is refused with Conflict. A write without a read replaces what is there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)
        self._seen: Transaction | None = None

    def write(self, df: DataFrame) -> int:
        """Write all rows, then publish them. Returns the version."""
        t, self._seen = self._seen, None
        if t is None:
            return self.store.run(lambda t: t.write("rows", df))
        t.write("rows", df)
        return t.commit()

    def read(self) -> DataFrame | None:
        self._seen = self.store.begin()
        return self._seen.read("rows")


class BatchLog:
    """A table that only grows: each batch of a stream is a folder of its own, and one that comes again after a failure replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)


def merge_batches(target: VersionedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a table once: a batch that comes again after a failure is left out. Another writer's version in between is merged with."""
    return transactions(target.store, {"rows": merge})


def transactions(store: Store, merges: dict[str, Callable[[DataFrame | None, DataFrame], DataFrame]], appends: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that changes several tables in one commit a batch: merges make a table from the old one (None at first) and the batch, appends add rows.

    The batch's number is committed with the tables, so a batch that comes again after a failure changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:

            def change(t: Transaction) -> None:
                last = t.note("batch_id")
                if last is not None and last >= batch_id:
                    return
                for name, rows in (appends or {}).items():
                    t.append(name, rows(batch))
                for name, merge in merges.items():
                    t.write(name, merge(t.read(name), batch))
                t.set_note("batch_id", batch_id)

            store.run(change)
        finally:
            batch.unpersist()

    return run
