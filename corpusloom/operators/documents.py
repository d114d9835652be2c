"""Documents as rows of arrays for the samplers: places and numbers of words, and entities with their mentions.

Words and entities of known number go to the documents, which stay where their text is; tokens and mentions are dealt out as rows only beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C
from . import entities as E
from .samplers import packed

#: Words and entities together up to which they are sent to the documents (about 150 MB).
MOST_SENT = 8_000_000


def _numbered(lists: pa.ListArray, names: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the place and the id of each item that is among the names."""
    offsets = lists.offsets.to_numpy()
    at = pc.index_in(lists.values, value_set=names)
    there = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))[there - offsets[0]] if len(there) else there
    return row, there - offsets[row], ids[pc.fill_null(at, 0).to_numpy()[there]] if len(there) else there


def _lists(row: np.ndarray, rows: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), pa.array(values, pa.int64()))


def _counted(row: np.ndarray, ids: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) of each row's distinct ids in order; most: those of the highest counts (ties: by id)."""
    width = int(ids.max(initial=0)) + 1
    both, times = np.unique(row * width + ids, return_counts=True)
    row, ids = both // width, both % width
    if most is None:
        return row, ids, times
    order = np.lexsort((ids, -times, row))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - np.searchsorted(row, row[order])
    return row[rank < most], ids[rank < most], times[rank < most]


def listed(docs: DataFrame, vocab: DataFrame, entities: DataFrame | None = None, most: int | None = None, sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, pos, word, ents, times) of docs (doc_id, text) with unique long keys: places and numbers of the tokens in vocab, and the entities of the set with how often each is mentioned.

    most: how many entities a document keeps, those of most mentions (None: all). Documents without tokens and entities are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if vocab.count() + (entities.count() if entities is not None else 0) > sent:
        mentions = E.mentions_in(E.mention_lists(docs)) if entities is not None else None
        return packed(C.encode(C.tokens(docs), vocab), None if mentions is None else E.document_entities(mentions, entities, most))
    key = lambda kind, value: F.concat(kind.cast("string"), F.lit(":"), value)
    table = vocab.select("token", F.col("word_id").cast("long").alias("id")).toArrow().combine_chunks()  # bounded by `sent`
    names = None if entities is None else entities.select(key(F.col("type"), F.col("value")).alias("name"), F.col("entity_id").cast("long").alias("id")).toArrow().combine_chunks()  # bounded likewise
    strings = lambda t, c: (pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], pa.string())).cast(pa.string())
    both = docs.sparkSession.sparkContext.broadcast((strings(table, "token"), table["id"].to_numpy(), *((strings(names, "name"), names["id"].to_numpy()) if names is not None else (pa.array([], pa.string()), np.zeros(0, np.int64)))))
    none = F.array().cast("array<string>")
    lists = docs.select("doc_id", F.transform(T.words(F.col("text")), F.lower).alias("tokens"), none.alias("names"))
    if entities is not None:
        found = E.mention_lists(docs.select(F.struct("doc_id", "text").alias("doc"), "text"), key="doc")
        lists = found.select("doc.doc_id", F.transform(T.words(F.col("doc.text")), F.lower).alias("tokens"), F.zip_with("type", "value", key).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, word_ids, names, entity_ids = both.value
        for batch in batches:
            n = batch.num_rows
            row, pos, word = _numbered(batch.column(1), tokens, word_ids)
            of, _, ids = _numbered(batch.column(2), names, entity_ids)
            of, ids, times = _counted(of, ids, most)
            made = pa.RecordBatch.from_arrays([batch.column(0), _lists(row, n, pos), _lists(row, n, word), _lists(of, n, ids), _lists(of, n, times)], ["doc_id", "pos", "word", "ents", "times"])
            yield made.filter(pa.array(np.bincount(row, minlength=n) + np.bincount(of, minlength=n) > 0))

    return lists.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<long>" for c in ("pos", "word", "ents", "times")))
