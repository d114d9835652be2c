"""Token ids as ORC files in ascending id order, and their digest.

Each row of a file is a document: its id, the file's number (`shard`, ascending with the
ids), the tokens of the shard before it, and its ids as a list of integers, which ORC
stores run-length encoded in stripes with a row index and a Bloom filter on the id.
Readers take stripes in parallel; `doc_id = n` skips files and stripes by their
statistics and Bloom filters.

One range shuffle moves the texts; a file holds one range of ids, so a source or key with
a third of the rows changes nothing, while one id repeated without end fills one file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoder import encoder, slices
from .memory import released
from .sampling import small_batches

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}
SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, input_ids array<int>"


def _encode(path: str, end_id: int, white_space: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard, start = encoder(path, white_space), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            for part in slices(texts):
                raw = [ids + end for ids in tok.ids(part)]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                values = pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, pa.py_buffer(b"".join(raw))])
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
                size = len(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, size), pa.array(np.full(size, shard, np.int32)), pa.array(start + bounds[:-1]), pa.array(n), ids],
                    ["doc_id", "shard", "shard_start", "n_tokens", "input_ids"],
                )
                start += int(bounds[-1])
                done += size

    return released(run)


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, white_space: bool = False) -> None:
    """Write every row's ids and the end id to ORC files under `out`.

    Null and empty texts hold the end id alone; null ids come first; repeated rows stay, next to each other; an
    empty table writes no rows; columns but doc_id and text are ignored. white_space: whether the tokenizer
    gives tokens for white space itself (byte-level ones do).
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(_encode(tokenizer_path, end_id, white_space), SCHEMA).write.options(**ORC_OPTIONS).orc(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4")
        n = np.diff(at).astype(np.int64)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"]
        )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows: doc_id, shard, shard_start, n_tokens, input_ids. A folder without rows gives none."""
    return spark.read.schema(SCHEMA).orc(out)


def token_file_digest(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before it. Only the shards' totals, a row
    for each file, are added up in order. Null ids have rows, and repeated ones one each; files without rows give an empty table.
    """
    rows = read_token_files(spark, out)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    seen = rows.select("doc_id", "shard", "shard_start", "input_ids").mapInArrow(released(_digest), "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return seen.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
