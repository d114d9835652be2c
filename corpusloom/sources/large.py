"""Readers of large files: one file is read by many tasks.

Spark's text source cuts a file at byte ranges and goes on to the next mark, so the mark between records is the line separator. What needs a file's order (the number of a record,
groups of lines, pairs of titles and bodies) takes it from the range's place in the file and the row's place in the range; only counts a range are added up in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written


def marked(spark: SparkSession, path: str, mark: str = "\n") -> DataFrame:
    """(name, ord, text): the pieces between marks of each file under path, with their numbers from 0. A mark at a file's end ends its last piece."""
    rows = spark.read.option("lineSep", mark).text(path)
    meta = F.col("_metadata")
    rows = rows.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    rows = written(rows, "marked")  # row numbers hold as long as the rows do
    return _numbered(rows, F.lit(1), "ord").select("path", "name", "ord", "text")


def _numbered(rows: DataFrame, count, name: str) -> DataFrame:
    """rows with the sum of `count` over the rows before, in their file."""
    inside = W.partitionBy("path", "start").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("path", "start").agg(F.sum(count).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    joined = rows.join(ranges.select("path", "start", before.alias("before")), ["path", "start"])
    return joined.withColumn(name, F.col("before") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop("before")


def file_documents(spark: SparkSession, path: str, separator: str = "{") -> DataFrame:
    """(name, ord, text): as split_documents over whole files: the non-empty pieces between separators, numbered without the empty ones."""
    rows = spark.read.option("lineSep", separator).text(path)
    meta = F.col("_metadata")
    rows = rows.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")).filter(F.col("text") != "")
    return _numbered(written(rows, "file-documents"), F.lit(1), "ord").select("name", F.col("ord").cast("int").alias("ord"), "text")


def file_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(name, record, fields): as records over whole files: each file's lines in groups of `size`; a last, shorter group is left out."""
    rows = marked(spark, path).withColumn("record", F.floor(F.col("ord") / size))
    fields = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])  # of `size` lines
    return rows.groupBy("path", "name", "record").agg(fields.alias("fields")).filter(F.size("fields") == size).select("name", F.col("record").cast("int").alias("record"), "fields")


def file_sgml(spark: SparkSession, path: str, least: int = 150, end_mark: str = "Reuter") -> DataFrame:
    """(name, ord, title, body): as split_sgml over whole files: the n-th TITLE with the n-th BODY of a file.

    A piece ends where a body does; titles and bodies are numbered by themselves, so one without its counterpart shifts the pairs as it does in the whole file. Titles don't hold the end of a body.
    """
    rows = spark.read.option("lineSep", "</BODY>").text(path)
    meta = F.col("_metadata")
    rows = rows.select(meta["file_path"].alias("path"), meta["file_name"].alias("name"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"), (meta["file_size"]).alias("size"))
    whole = T.between_tags(F.concat("text", F.lit("</BODY>")), "BODY")
    rows = rows.select("path", "name", "start", "at", T.between_tags(F.col("text"), "TITLE").alias("titles"), whole.alias("bodies"))
    rows = written(rows, "sgml")
    numbered = _numbered(_numbered(rows, F.size("titles"), "first_title"), F.size("bodies"), "first_body")
    titles = numbered.select("path", "first_title", F.posexplode("titles").alias("i", "title")).select("path", (F.col("first_title") + F.col("i")).alias("ord"), "title")
    bodies = numbered.select("path", "name", "first_body", F.posexplode("bodies").alias("i", "body")).select("path", "name", (F.col("first_body") + F.col("i")).alias("ord"), "body")
    pairs = bodies.join(titles, ["path", "ord"], "left")
    at = F.instr("body", end_mark)
    pairs = pairs.withColumn("body", F.when(at > 1, F.substring(F.col("body"), F.lit(1), at - 1)).otherwise(F.col("body")))
    return pairs.filter(F.length("body") > least).select("name", F.col("ord").cast("int").alias("ord"), F.lower("title").alias("title"), "body")
