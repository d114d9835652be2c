"""Topic-model statistics from token assignments.

Assignments are rows (doc_id, pos, word_id, z[, s, entity_id]); every count is an aggregation of them. Dense results join keys
with the K topics as an array that is exploded, never keys with keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def arithmetic_assignments(encoded: DataFrame, topics: int) -> DataFrame:
    """Reproducible assignments z = (31 doc + 17 pos + 7 word) mod K, for checks without a sampler."""
    return encoded.withColumn("z", F.pmod(31 * F.col("doc_id") + 17 * F.col("pos").cast("long") + 7 * F.col("word_id"), F.lit(topics)))


def random_assignments(encoded: DataFrame, topics: int, seed: int) -> DataFrame:
    """Uniform starting topics; a row's topic depends on the seed and its key only, so a lost task draws the same again."""
    return encoded.withColumn("z", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "pos"), F.lit(topics)))


def entity_lists(doc_entities: DataFrame) -> DataFrame:
    """(doc_id, entities): each document's entities in order as an array of (entity_id, upto), upto: the mentions of it and of those before it. A few a document, so that tokens can carry it."""
    lists = doc_entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", F.col("cnt").cast("long").alias("cnt")))).alias("e"))
    upto = F.transform("e", lambda x, i: F.struct(x["entity_id"].alias("entity_id"), F.aggregate(F.slice("e", 1, i + 1), F.lit(0).cast("long"), lambda t, y: t + y["cnt"]).alias("upto")))
    return lists.select("doc_id", upto.alias("entities"))


def switched(assigned: DataFrame, most: int | None = None) -> DataFrame:
    """Tokens with their document's `entities` (see entity_lists): the switch s = (doc + pos) mod 2 (0 without entities), and the entity of the token, each repeated by mentions, where s is 1.

    most: how many entities a document has at most, if that is known; each then is a plain comparison.
    """
    both = assigned.withColumn("s", F.when(F.col("entities").isNull(), F.lit(0)).otherwise(F.pmod(F.col("doc_id") + F.col("pos"), F.lit(2))).cast("long"))
    spot = F.pmod(F.col("pos"), F.element_at("entities", -1)["upto"])
    if most is None:
        held = F.get(F.filter("entities", lambda x: x["upto"] > spot), F.lit(0))["entity_id"]
    else:
        each = [F.get("entities", F.lit(i)) for i in range(most)]
        held = F.coalesce(*(F.when(x["upto"] > spot, x["entity_id"]) for x in each))
    return both.withColumn("entity_id", F.when(F.col("s") == 1, held)).drop("entities")


def with_entities(assigned: DataFrame, doc_entities: DataFrame) -> DataFrame:
    """Adds entities (each repeated by mentions, in order), the switch s = (doc + pos) mod 2 (0 without entities), and the entity of the token where s is 1."""
    return switched(assigned.join(entity_lists(doc_entities), "doc_id", "left"))


#: Topics up to which counts are sums over each topic in one aggregation; beyond, topics are counted as rows and gathered.
WIDE = 64


def topic_counts(assigned: DataFrame, key: str) -> DataFrame:
    """(key, k, n): how often each topic occurs with each key."""
    return assigned.groupBy(key, F.col("z").alias("k")).agg(F.count("*").alias("n"))


def topic_vectors(assigned: DataFrame, key: str, topics: int, where: Column | None = None) -> DataFrame:
    """(key, n, size): each key's counts of the K topics as an array in topic order, and their sum. where: rows that count; keys without any have zeros."""
    counts = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if topics <= WIDE:
        each = F.array(*(F.count_if((F.col("z") == k) & counts) for k in range(topics)))
        return assigned.groupBy(key).agg(each.alias("n"), F.count_if(counts).alias("size"))
    cells = assigned.groupBy(key, F.col("z").alias("k")).agg(F.count_if(counts).alias("n"))
    gathered = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by_k"), F.sum("n").alias("size"))  # at most K entries
    return gathered.select(key, F.transform(_topics(topics), lambda k: F.coalesce(F.element_at("by_k", k), F.lit(0).cast("long"))).alias("n"), "size")


def _topics(topics: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(topics - 1).cast("long"))


def for_keys(vectors_: DataFrame, keys: DataFrame, key: str, topics: int) -> DataFrame:
    """Count vectors of all keys; those that have none get zeros."""
    joined = keys.select(key).join(vectors_, key, "left")
    return joined.select(key, F.coalesce("n", F.array_repeat(F.lit(0).cast("long"), topics)).alias("n"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def shares(vectors_: DataFrame, topics: int, prior: float, name: str) -> DataFrame:
    """Count vectors with `name`, the array of (n + prior) / (size + K prior)."""
    return vectors_.withColumn(name, F.transform("n", lambda n: (n + F.lit(prior)) / (F.col("size") + F.lit(topics * prior))))


def word_shares(vectors_: DataFrame, vocab: DataFrame, topics: int, beta: float, name: str = "phi", key: str = "word_id") -> DataFrame:
    """(key, name): for every word the array of (n + beta) / (topic size + V beta)."""
    size = vocab.count()
    totals = vectors_.select(F.posexplode("n").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # K rows
    found = {r.k: r.n for r in totals}
    margins = F.array(*(F.lit(float(found.get(k, 0))) for k in range(topics)))
    every = for_keys(vectors_, vocab, key, topics)
    return every.select(key, F.zip_with("n", margins, lambda n, t: (n + F.lit(beta)) / (t + F.lit(size * beta))).alias(name))


def by_topic(vectors_: DataFrame, key: str, name: str) -> DataFrame:
    """(key, k, name): an array over topics as rows."""
    return vectors_.select(key, F.posexplode(name).alias("k", name)).withColumn("k", F.col("k").cast("long"))


def top(counts: DataFrame, within: list[str], by: Column, tie: str, n: int) -> DataFrame:
    """Rows ranked 1 to n within groups, by descending value, then ascending tie."""
    rank = F.row_number().over(W.partitionBy(*within).orderBy(by.desc(), tie))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def event_report(counts: DataFrame, key: str, n: int) -> DataFrame:
    """(event, total, rank, key, n): the n keys of highest counts of each event, from counts (key, k, n), and the event's total over all keys."""
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))  # as many as events
    best = top(counts, ["k"], F.col("n"), key, n).join(F.broadcast(totals), "k")
    return best.select(F.col("k").alias("event"), "total", F.col("rank").cast("long").alias("rank"), key, "n")


def topic_report(assigned: DataFrame, vocab: DataFrame, beta: float, n: int) -> DataFrame:
    """(k, total, rank, word_id, token, n, prob, z): each topic's size and its n most frequent words (ties: by id), with the smoothed probability of a word in the topic, and how far its
    count is from what its share of the corpus suggests, in standard deviations."""
    counts = topic_counts(assigned, "word_id")
    sizes = counts.groupBy("k").agg(F.sum("n").alias("total"))  # as many as topics
    best = top(counts, ["k"], F.col("n"), "word_id", n)
    words = counts.groupBy("word_id").agg(F.sum("n").alias("in_all")).join(F.broadcast(best.select("word_id").distinct()), "word_id")  # n words a topic at most
    whole = sizes.agg(F.sum("total")).first()[0] or 0
    rows = best.join(F.broadcast(sizes), "k").join(words, "word_id").join(vocab.select("word_id", "token"), "word_id")
    prob = (F.col("n") + F.lit(beta)) / (F.col("total") + F.lit(beta * vocab.count()))
    z = T.z_score(F.col("n"), F.col("total"), F.col("in_all"), F.lit(float(whole)))
    return rows.select("k", "total", F.col("rank").cast("long").alias("rank"), "word_id", "token", "n", prob.alias("prob"), z.alias("z"))


def as_matrix(long: DataFrame, row: str, topics: int, value: str) -> DataFrame:
    """One row for each key and one column `topic k` for each topic."""
    wide = long.groupBy(row).pivot("k", list(range(topics))).agg(F.first(value))
    return wide.select(row, *(F.col(str(k)).alias(f"topic {k}") for k in range(topics)))


def dot(a: Column | str, b: Column | str, topics: int) -> Column:
    """Sum of products of two arrays over topics, in topic order."""
    if topics <= WIDE:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        total = F.lit(0.0)
        for k in range(topics):
            total = total + F.get(a, F.lit(k)) * F.get(b, F.lit(k))
        return total
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


#: Numbers of words by topics up to which they are sent to the tokens (64 MB); beyond, both are shuffled.
MOST_SENT = 8_000_000


def to_tokens(by_word: DataFrame, words: int | None, topics: int) -> DataFrame:
    """A table of arrays over topics by word, marked to be sent to the tokens if so many words are few enough (None: unknown)."""
    return F.broadcast(by_word) if words is not None and words * topics <= MOST_SENT else by_word


def pair_counts(tokens: DataFrame, name: str = "n") -> DataFrame:
    """(doc_id, word_id, name): tokens counted by document and word. They are dealt out by document, once, so what comes by document joins in place."""
    return tokens.select("doc_id", "word_id").repartition("doc_id").groupBy("doc_id", "word_id").agg(F.count("*").alias(name))


def log2_likelihood(tokens: DataFrame, theta: DataFrame, phi: DataFrame, topics: int, words: int | None = None) -> DataFrame:
    """One row: the sum over tokens of log2 of the sum over topics of theta times phi, for theta (doc_id, theta) and phi (word_id, phi) as arrays.

    Tokens are first counted by (document, word). words: how many words phi has, if that is known.
    """
    mixed = pair_counts(tokens).join(theta.select("doc_id", "theta"), "doc_id").join(to_tokens(phi.select("word_id", "phi"), words, topics), "word_id")
    return mixed.agg(F.sum(F.col("n") * F.log2(dot("theta", "phi", topics))).alias("log2_likelihood"))


def conditional(assigned: DataFrame, topics: int, alpha: float, beta: float, vocabulary_size: int) -> DataFrame:
    """(doc_id, word_id, z, at, weights): the unnormalised probability of each topic for a token given all other assignments (a snapshot).

    Tokens of one document, word and topic have the same weights and are one row, `at` their positions. A document's rows and counts stay together;
    words' counts come to them as arrays. The token itself is taken off its own topic's counts.
    """
    held = assigned.select("doc_id", "word_id", "z", "pos").repartition("doc_id")
    cells = held.groupBy("doc_id", "word_id", "z").agg(F.collect_list("pos").alias("at"))
    joined = cells.join(topic_vectors(held, "doc_id", topics).select("doc_id", F.col("n").alias("of_doc")), "doc_id")
    of_word = topic_vectors(assigned, "word_id", topics).select("word_id", F.col("n").alias("of_word"))
    joined = joined.join(to_tokens(of_word, vocabulary_size, topics), "word_id")
    totals = {r.k: r.n for r in assigned.groupBy(F.col("z").alias("k")).agg(F.count("*").alias("n")).collect()}  # K rows

    def weight(k: Column, total: Column) -> Column:
        own, at = (F.col("z") == k).cast("long"), k.cast("int")
        return (F.get("of_word", at) - own + F.lit(beta)) / (total - own + F.lit(vocabulary_size * beta)) * (F.get("of_doc", at) - own + F.lit(alpha))

    each = [F.lit(totals.get(k, 0)).cast("long") for k in range(topics)]
    if topics <= WIDE:
        weights = F.array(*(weight(F.lit(k), total) for k, total in enumerate(each)))
    else:
        weights = F.zip_with(_topics(topics), F.array(*each), weight)
    return joined.select("doc_id", "word_id", "z", "at", weights.alias("weights"))


def uniform(doc_id: Column, pos: Column) -> Column:
    """A fixed number in [0, 1) for each token, for checks without a generator."""
    return F.pmod(doc_id * 7919 + pos.cast("long") * 104729, F.lit(10007)) / F.lit(10007.0)
