"""Document sources: each reads or reshapes text into rows. Readers are plain functions and are found by name in READERS."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): each plain file of a folder, whole; empty files have no row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def whole_text(docs: DataFrame) -> DataFrame:
    """Lines joined by one blank."""
    return docs.withColumn("text", T.one_line(F.col("text")))


def news_article(docs: DataFrame) -> DataFrame:
    """The fourth line (three are headers), without a dateline; fewer lines give an empty text."""
    return docs.withColumn("text", T.strip_dateline(F.coalesce(T.line(F.col("text"), 4), F.lit(""))))


def titled_article(docs: DataFrame) -> DataFrame:
    """The second line (the first is the title); without one an empty text."""
    return docs.withColumn("text", F.coalesce(T.line(F.col("text"), 2), F.lit("")))


#: Readers by name: functions from (.., text) to (.., text).
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"whole": whole_text, "news": news_article, "titled": titled_article}


def read_documents(spark: SparkSession, path: str, reader: str = "whole") -> DataFrame:
    return READERS[reader](files(spark, path))


def split_sgml(docs: DataFrame, key: str, least: int = 150, end_mark: str = "Reuter") -> DataFrame:
    """(key, ord, title, body): TITLE and BODY pairs; a body ends at the mark (if not at its start); shorter bodies than least + 1 go; titles in lower case."""
    pairs = F.arrays_zip(T.between_tags(F.col("text"), "TITLE").alias("title"), T.between_tags(F.col("text"), "BODY").alias("body"))
    rows = docs.select(key, F.posexplode(pairs).alias("ord", "p")).select(key, "ord", F.lower("p.title").alias("title"), F.col("p.body").alias("body"))
    at = F.instr("body", end_mark)
    rows = rows.withColumn("body", F.when(at > 1, F.substring(F.col("body"), F.lit(1), at - 1)).otherwise(F.col("body")))
    return rows.filter(F.length("body") > least)


def split_documents(docs: DataFrame, key: str, separator: str = r"\{") -> DataFrame:
    """(key, ord, text): the non-empty pieces between separators."""
    return docs.select(key, F.posexplode(T.pieces(F.col("text"), separator)).alias("ord", "text"))


def abstract(docs: DataFrame) -> DataFrame:
    """Text up to the introduction; the upper-case title is looked for first."""
    return docs.withColumn("text", T.before_marker(F.col("text"), "INTRODUCTION", "Introduction"))


def body_text(docs: DataFrame) -> DataFrame:
    """Text before the acknowledgements, else before the references."""
    return docs.withColumn("text", T.before_marker(F.col("text"), "ACKNOWLEDGEMENTS", "Acknowledgements", "REFERENCES", "References"))


def lines(spark: SparkSession, path: str, lower: bool = False, unique: bool = False) -> DataFrame:
    """(line) of text files; lower: in lower case; unique: each once."""
    out = spark.read.text(path).select((F.lower("value") if lower else F.col("value")).alias("line"))
    return out.distinct() if unique else out


def records(docs: DataFrame, key: str, size: int) -> DataFrame:
    """(key, record, fields): each text's lines in groups of `size`; a last, shorter group is left out."""
    rows = F.split("text", "\n")
    n = F.floor(F.size(rows) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return docs.select(key, F.posexplode(F.transform(at, lambda i: F.slice(rows, i * size + 1, size))).alias("record", "fields"))


def tag_map(docs: DataFrame, key: str) -> DataFrame:
    """(key, tag, related): two-line records, a tag and its `related,count,` list as a map."""
    return records(docs, key, 2).select(key, F.col("fields")[0].alias("tag"), T.pair_map(F.col("fields")[1]).alias("related"))


def tag_seeds(docs: DataFrame, key: str) -> DataFrame:
    """(key, tag, freq, cooccur): three-line records."""
    f = F.col("fields")
    return records(docs, key, 3).select(key, f[0].alias("tag"), f[1].try_cast("int").alias("freq"), T.pair_map(f[2]).alias("cooccur"))


def place(answers: DataFrame, xml: str = "xml") -> DataFrame:
    """answers with `place`, `CC:City` from a geocoding answer, null unless both are there."""
    country = F.xpath_string(F.col(xml), F.lit("//address_component[type='country'][1]/short_name"))
    city = F.xpath_string(F.col(xml), F.lit("//address_component[type='locality'][1]/long_name"))
    return answers.withColumn("place", F.when((country != "") & (city != ""), F.concat_ws(":", country, city)))


def search_results(answers: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """(key, ord, name, phone, email, labels, people): results by their children's places; from the fifth on they are persons.

    The XML is parsed once into arrays of children, as text in the order of the results.
    """
    parsed = F.from_xml(F.col(xml), "result array<struct<name:string,phone:string,email:string,labels:string,person:array<string>>>")
    r = answers.select(key, F.posexplode(parsed["result"]).alias("ord", "r"))
    return r.select(key, "ord", "r.name", "r.phone", "r.email", "r.labels", F.coalesce("r.person", F.array().cast("array<string>")).alias("people"))


def incremental(rows: DataFrame, at: str, mark) -> tuple[DataFrame, object]:
    """(new rows, new mark): rows after the mark, and the latest time among them (the old mark without any)."""
    new = rows if mark is None else rows.filter(F.col(at) > F.lit(mark))
    latest = new.agg(F.max(at)).first()[0]
    return new, mark if latest is None else latest


def catalog(spark: SparkSession, folder: str, kinds: dict[str, str]) -> Callable[[str], DataFrame]:
    """All rows of a kind by name: a function from a kind's name to its table."""
    return lambda kind: spark.read.parquet(f"{folder}/{kinds[kind]}.parquet")


def requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of events, one JSON line each, as files come in."""
    return spark.readStream.schema(schema).json(path)
