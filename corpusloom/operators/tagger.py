"""Named entities by a first-order tag model: counts of tags that follow each other and of words and shapes of each tag, and the best path through a document.

Learned from annotated tokens (doc, pos, token, label), such as `entities.annotate_listed` gives for a list of names: words that the list lacks are tagged by their shape
and their neighbours. Counts are aggregations over all tokens. Documents are rows of arrays from the start: a vocabulary of known size goes to them, and tokens are dealt out
only for one beyond it. The best paths of some documents are found together, one place of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .entities import entity_type

#: Labels by their state: none, other, person, location, organisation.
LABELS = (-1, 0, 1, 2, 3)
SHAPES = ("lower", "capital", "upper", "mixed")
#: Weight of a word's shape against its own count, and of every step between tags beside those that were seen.
BACK_OFF, STEP = 2.0, 0.5
#: Words up to which a vocabulary is sent to the documents (about 150 MB), and words of documents whose paths are found together.
MOST_SENT, TOGETHER = 8_000_000, 1_000_000


@dataclass
class Model:
    words: DataFrame  # token, scores: log probability under each label, of tokens that were learned from
    shapes: np.ndarray  # the same for other tokens, by shape
    start: np.ndarray
    steps: np.ndarray  # log probability of a label (column) after another (row)


def shape(token: Column) -> Column:
    """The place in SHAPES of a token's letters."""
    return F.when(token.rlike("^[a-z]+$"), 0).when(token.rlike("^[A-Z][a-z]+$"), 1).when(token.rlike("^[A-Z]+$"), 2).otherwise(3)


def unsure(annotated: DataFrame) -> DataFrame:
    """annotated with null labels for words without one that don't look like plain words: a list of names lacks names, and what it lacks says nothing of words that are none."""
    return annotated.withColumn("label", F.when((F.col("label") >= 0) | (shape(F.col("token")) == 0), F.col("label")))


def word_lists(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, words): every ASCII word of each text, in order. Null and empty texts have none."""
    return docs.select(key, T.words(F.col(text), "[A-Za-z]+").alias("words"))


def numbered(lists: DataFrame, numbers: DataFrame, key: str = "doc_id", most: int = MOST_SENT) -> DataFrame:
    """(key, words, found) of lists (key, words) with unique long keys: found has the number of each word in numbers (token, number), null for words without one.

    numbers has each token once. Up to `most` rows go to the documents, which then stay where they are; more are joined to the tokens.
    """
    table = written(numbers.select("token", F.col("number").cast("long").alias("number")), "numbers")
    if table.count() > most:
        spots = lists.select(key, F.posexplode_outer("words").alias("pos", "token")).join(table, "token", "left")
        back = spots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "number"))).alias("x"))  # of one document
        back = back.withColumn("x", F.filter("x", lambda x: x["pos"].isNotNull()))
        return back.select(key, F.col("x.token").alias("words"), F.col("x.number").alias("found"))
    rows = table.toArrow().combine_chunks()  # bounded by `most`
    sent = lists.sparkSession.sparkContext.broadcast((rows["token"].combine_chunks().cast(pa.string()), rows["number"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, value = sent.value
        value = np.append(value, 0)
        for batch in batches:
            words = batch.column(1)
            at = pc.index_in(words.values, value_set=tokens)
            missing = pc.is_null(at).to_numpy(zero_copy_only=False)
            found = pa.array(value[pc.fill_null(at, len(value) - 1).to_numpy()], pa.int64(), mask=missing)
            yield pa.RecordBatch.from_arrays([batch.column(0), words, pa.ListArray.from_arrays(words.offsets, found)], [key, "words", "found"])

    return lists.select(F.col(key).cast("long").alias(key), "words").mapInArrow(run, f"{key} long, words array<string>, found array<long>")


def listed_labels(lists: DataFrame, names: DataFrame, key: str = "doc_id", most: int = MOST_SENT) -> DataFrame:
    """(key, words, labels) of lists (key, words): unsure(annotate_listed(docs, names)) as arrays."""
    typed = names.groupBy("token").agg(F.max(entity_type(F.col("type"))).alias("number"))
    found = numbered(lists, typed, key, most)
    labels = F.zip_with("words", "found", lambda w, x: F.when((x >= 0) | (shape(w) == 0), F.coalesce(x, F.lit(-1)).cast("int")))
    return found.select(key, "words", labels.alias("labels"))


def _state(label: Column) -> Column:
    return F.when(label.isNotNull(), F.greatest(F.array_position(F.array(*map(F.lit, LABELS)), label), F.lit(1)) - 1).cast("int")


def learn(annotated: DataFrame, key: str = "doc_id") -> Model:
    """A model of all annotated tokens whose label isn't null. Tokens of a document have places of their own; unknown labels count as none. Without tokens all labels are alike."""
    rows = annotated.select(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos"), "token", _state(F.col("label")).alias("state"))
    lists = rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "state"))), lambda x: x["state"]).alias("s"))  # of one document
    return _learned(lists, rows.select("token", "state"))


def learn_lists(labelled: DataFrame) -> Model:
    """The same of documents as arrays (words, labels), which stay where they are: only counts of words and of pairs of labels are dealt out."""
    lists = labelled.select("words", F.transform("labels", _state).alias("s"))
    return _learned(lists.select("s"), lists.select(F.inline(F.arrays_zip(F.col("words").alias("token"), F.col("s").alias("state")))))


def _learned(lists: DataFrame, rows: DataFrame) -> Model:
    """The model of states: lists has each document's in order (s), rows each token's (token, state)."""
    k = len(LABELS)
    pairs = lists.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(k)), F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0)))).alias("a"), F.col("s").alias("b"))).alias("p")).filter("p.a is not null and p.b is not null").groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    steps = np.full((k + 1, k), STEP)
    for r in pairs.collect():  # a row for each two labels
        steps[r.a, r.b] += r.n
    steps = np.log(steps / steps.sum(1, keepdims=True))
    counts = written(rows.filter("state is not null").groupBy("token").agg(F.array(*(F.count_if(F.col("state") == i) for i in range(k))).alias("n")).withColumn("shape", shape(F.col("token"))), "tag-counts")
    by_shape, kinds = np.zeros((len(SHAPES), k)), np.ones(len(SHAPES))
    for r in counts.select("shape", F.posexplode("n").alias("i", "n")).groupBy("shape", "i").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():  # a row a shape and label
        by_shape[r["shape"], r.i], kinds[r["shape"]] = r.n, r.kinds + 1
    total = by_shape.sum(0)
    share = (by_shape + 0.5) / (total + 0.5 * len(SHAPES))
    each = BACK_OFF * share / kinds[:, None]  # of a shape's mass, what one of its words has
    other = F.array(*(F.array(*map(F.lit, row)) for row in each.tolist()))
    learned = F.zip_with(F.zip_with("n", F.get(other, F.col("shape")), lambda n, e: n + e), F.array(*map(F.lit, (total + BACK_OFF).tolist())), lambda x, t: F.log(x / t))
    return Model(counts.select("token", learned.alias("scores")), np.log(each / (total + BACK_OFF)), steps[k], steps[:k])


def best_paths(scores: list[np.ndarray], start: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """The most probable states of each sequence, for log scores (places, states); of equal paths the one with the smaller states from the end."""
    order = np.argsort([-len(s) for s in scores], kind="stable")
    length = np.array([len(scores[i]) for i in order], np.int64)
    n, most, k = len(order), int(length.max(initial=0)), len(start)
    if not most:
        return [np.zeros(0, np.int64) for _ in scores]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    back, best = np.zeros((len(flat), k), np.int8), np.empty((n, k))
    live = int(np.searchsorted(-length, 0))
    best[:live] = start + flat[first[:live]]
    for t in range(1, most):
        live = int(np.searchsorted(-length, -t))
        at = first[:live] + t
        ways = best[:live, :, None] + steps
        back[at] = ways.argmax(1)
        best[:live] = ways.max(1) + flat[at]
    out, state = np.zeros(len(flat), np.int64), best.argmax(1)
    for t in range(most - 1, -1, -1):
        live = int(np.searchsorted(-length, -t))
        at = first[:live] + t
        out[at] = state[:live]
        if t:
            state[:live] = back[at, state[:live]]
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for i, a, m in zip(order, first, length, strict=True):
        paths[i] = out[a : a + m]
    return paths


def tag_lists(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", most: int = MOST_SENT) -> DataFrame:
    """(key, words, labels): every ASCII word of texts with unique long keys, with the labels of the best path, as arrays. Null and empty texts have none.

    Words with the same scores have one number, so a word goes to the documents with a number and the scores of the numbers beside it.
    """
    kinds = written(model.words.select("scores").distinct().withColumn("number", F.monotonically_increasing_id()), "tag-scores")
    found = numbered(word_lists(docs, text, key), model.words.join(kinds, "scores").select("token", "number"), key, most)
    rows = kinds.orderBy("number").toArrow()  # at most one of each count of a word under each label
    ids, known = rows["number"].to_numpy(), np.array(rows["scores"].to_pylist(), float).reshape(-1, len(LABELS))
    sent = docs.sparkSession.sparkContext.broadcast((ids, np.concatenate([known, model.shapes])))
    start, steps, labels = model.start, model.steps, np.array(LABELS, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = sent.value
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            number, shapes = batch.column(2).values, batch.column(3).values.to_numpy()
            at = np.where(pc.is_null(number).to_numpy(zero_copy_only=False), len(ids) + shapes, np.searchsorted(ids, pc.fill_null(number, 0).to_numpy()))
            done = 0
            while done < batch.num_rows:
                end = max(done + 1, int(np.searchsorted(offsets, offsets[done] + TOGETHER, "right")) - 1)
                spots = offsets[done : end + 1]
                paths = best_paths([scores[at[a:b]] for a, b in zip(spots, spots[1:], strict=False)], start, steps)
                best = pa.ListArray.from_arrays(pa.array(spots - spots[0], pa.int32()), pa.array(labels[np.concatenate([np.zeros(0, np.int64), *paths])]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, end - done), batch.column(1).slice(done, end - done), best], [key, "words", "labels"])
                done = end

    shaped = found.select(F.col(key).cast("long").alias(key), "words", "found", F.transform("words", shape).alias("shapes"))
    return shaped.mapInArrow(run, f"{key} long, words array<string>, labels array<int>")


def tag(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, token, label): tag_lists with a row a word."""
    rows = tag_lists(docs, model, text, key).select(key, F.posexplode(F.arrays_zip("words", "labels")).alias("pos", "x"))
    return rows.select(key, "pos", F.col("x.words").alias("token"), F.col("x.labels").alias("label"))
