"""Corpus preparation: tokens, counts, pruning, vocabulary, encoding and statistics.

Everything is in long form, one row a token; counts are aggregations and dimension tables join back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .ids import with_dense_id

#: A short list of function words that topics don't need; callers may pass their own.
STOP_WORDS = tuple("a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you".split())


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", pattern: str = T.WORDS, least: int = 2, most: int | None = None, carried: Iterable[str] = ()) -> DataFrame:
    """(key, pos, token): kept tokens in lower case, pos counting all matches of the pattern from 0. carried: narrow columns of the document that each token takes along."""
    raw = docs.select(key, *carried, F.posexplode(T.words(F.col(text), pattern)).alias("pos", "raw"))
    return raw.filter(T.is_token(F.col("raw"), least, most)).select(key, "pos", F.lower("raw").alias("token"), *carried)


#: A step of a tokenizer chain: a token to what becomes of it, null to drop it.
Step = Callable[[Column], Column]


def lower() -> Step:
    return F.lower


def with_letters(least: int = 2, most: int | None = None) -> Step:
    """Only tokens with a letter, of a length within bounds."""
    return lambda t: F.when(T.is_token(t, least, most), t)


def without_words(words: Iterable[str]) -> Step:
    """Tokens that are none of the words. For a list; a table of stop words is an anti-join (without_stop_words)."""
    stop = list(words)
    return lambda t: F.when(~t.isin(stop), t)


#: The chain of topic corpora: with letters, in lower case, without function words.
CHAIN = (with_letters(), lower(), without_words(STOP_WORDS))


def chained(docs: DataFrame, *steps: Step, text: str = "text", key: str = "doc_id", pattern: str = T.WORDS) -> DataFrame:
    """(key, pos, token): matches of the pattern after all steps, in order; a token that a step drops reaches no later one. pos counts all matches from 0."""

    def run(raw: Column) -> Column:
        for step in steps:
            raw = step(raw)  # nulls stay null
        return raw

    spots = F.transform(T.words(F.col(text), pattern), lambda w, i: F.struct(i.alias("pos"), run(w).alias("token")))
    return docs.select(key, F.inline(F.filter(spots, lambda s: s["token"].isNotNull())))


def token_counts(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, cnt, df): occurrences, and documents with the token, of tokens in any order. Documents are counted from per-document counts, in two shuffles."""
    per_doc = toks.groupBy("token", key).agg(F.count("*").alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("cnt"), F.count("*").alias("df"))


def text_counts(docs: DataFrame, text: str = "text", pattern: str = T.WORDS, least: int = 2, most: int | None = None) -> DataFrame:
    """As token_counts(tokens(docs, ...)) where each row is a document of its own.

    A document's tokens and its distinct tokens both come as rows, told apart by a flag, so one aggregation with partial sums is the only shuffle and its
    map side holds tokens, not pairs of tokens and documents.
    """
    low = docs.select(F.transform(T.words(F.col(text), pattern), F.lower).alias("t"))
    both = F.array(*(F.struct(t.alias("t"), F.lit(first).alias("first")) for t, first in ((F.col("t"), False), (F.array_distinct("t"), True))))
    pairs = low.select(F.inline(both))
    rows = pairs.select(F.explode("t").alias("token"), "first").filter(T.is_token(F.col("token"), least, most))
    return rows.groupBy("token").agg(F.count_if(~F.col("first")).alias("cnt"), F.count_if("first").alias("df"))


def stop_list(spark, words=STOP_WORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "token string")


def without_stop_words(counts: DataFrame, stops: DataFrame) -> DataFrame:
    return counts.join(stops, "token", "left_anti")


def without_top(counts: DataFrame, n: int) -> DataFrame:
    """Without the n most frequent tokens (ties: by token). The n rows are found by a distributed top-n."""
    top = counts.orderBy(F.desc("cnt"), "token").limit(n).select("token")
    return counts.join(top, "token", "left_anti")


def frequent_documents(counts: DataFrame, n_docs: int, percent: int) -> DataFrame:
    """Tokens in at most percent * n_docs / 100 documents (whole numbers)."""
    return counts.filter(F.col("df") <= percent * n_docs // 100)


def vocabulary(counts: DataFrame, min_count: int = 5, top: int = 0) -> DataFrame:
    """(word_id, token, cnt, df): tokens of sufficient count, without the top ones; ids by descending count, then token.

    The counts are written once: the top ones, the range bounds of the ids and the rows all come from them.
    """
    kept = written(counts.filter(F.col("cnt") >= min_count), "token-counts")
    kept = without_top(kept, top) if top else kept
    return with_dense_id(kept, "word_id", F.desc("cnt"), F.col("token"))


#: Words of a vocabulary up to which it is sent to the tokens (about 100 MB); beyond, both are shuffled.
MOST_SENT = 1_000_000


def encode(toks: DataFrame, vocab: DataFrame, key: str = "doc_id", carried: Iterable[str] = ()) -> DataFrame:
    """(key, pos, word_id) of tokens in the vocabulary, and the carried columns; others are dropped and positions stay.

    The vocabulary goes to the tokens, so a document's tokens stay together, and what is counted by document later is counted where it is.
    """
    words = vocab.select("token", "word_id")
    if vocab.count() <= MOST_SENT:
        words = F.broadcast(words)
    return toks.join(words, "token").select(key, "pos", "word_id", *carried)


def decode(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    return encoded.join(vocab.select("word_id", "token"), "word_id")


def packed(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words): each document's ids in order as an array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word_id")))
    return encoded.groupBy(key).agg(F.transform(ordered, lambda x: x["word_id"]).alias("words"))


def corpus_stats(toks: DataFrame, docs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row: n_docs, n_tokens, n_unique and n_entities."""
    by_token = toks.groupBy("token").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_unique"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    out = n_docs.join(F.broadcast(by_token))
    n = entities.agg(F.count("*").alias("n_entities")) if entities is not None else None
    out = out.withColumn("n_entities", F.lit(0).cast("long")) if n is None else out.join(F.broadcast(n))
    return out.select("n_docs", "n_tokens", "n_unique", "n_entities")


def resample(docs: DataFrame, draws: int, seed: int, key: str = "doc_id") -> DataFrame:
    """`draws` documents with replacement, as documents 0, 1, ... (draw_id); the same document may come again. Without documents there are no draws.

    A draw is the hash of the seed and its number, modulo the documents in order of their keys, so it doesn't depend on partitions.
    """
    numbered = with_dense_id(docs, "__drawn", key)
    n = numbered.count()
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw_id").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = docs.sparkSession.range(draws if n else 0).select(F.col("id").alias("draw_id")).withColumn("__drawn", hashed % F.lit(max(1, n)))
    return drawn.join(numbered, "__drawn").drop("__drawn")
