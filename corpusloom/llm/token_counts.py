"""Token counts through a digest cache.

The cache is a Parquet table (digest, n_tokens) in a folder of the caller's choice. A
digest covers the tokenizer's version and the text's bytes, so a new tokenizer
never meets old counts. Only texts whose digest has no stored count are encoded,
each distinct one once, and their counts are appended.

Texts are compared as they are (null as empty): a byte-level tokenizer counts
spaces and case, so no coarser normal form keeps its counts.

Shuffles: texts that miss, once, after copies within a task are dropped; digests
for the final join. One text with a third of the rows leaves a row from each task
for encoding, and the join splits its partition (an adaptive skew join).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .encoder import encoder, slices
from .memory import released
from .sampling import small_batches

_CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and its library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest() + ":" + tokenizers.__version__


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest this task has not seen. The set is emptied at a million digests; later copies meet after the shuffle."""
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.take(pa.array(new, pa.int64()))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path, white_space=True)
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            if len(seen) > 1_000_000:  # a copy that comes later is encoded again, and its count stored twice
                seen.clear()
            counts = [n for part in slices(batch.column(1).to_pylist()) for n in tok.counts(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return released(run)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and tokens; repeated rows stay; null ids stay; an empty table gives an
    empty table; other columns are ignored. The cache folder need not exist. Two runs that
    append at once may store a digest twice with one value; reading takes one.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.lit(tokenizer_version(tokenizer_path) + "\n"), text), 256))
    keyed = docs.select(docs[id_col].alias(id_col), digest.alias("digest"), text.alias("text"))

    def cache() -> DataFrame | None:
        try:
            return spark.read.schema(_CACHE).parquet(cache_path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    missing = keyed.select("digest", "text")
    if (stored := cache()) is not None:
        missing = missing.join(stored.select("digest"), "digest", "left_anti")
    distinct = missing.mapInArrow(_first_of_each, "digest binary, text string").repartition("digest")
    with small_batches(spark):
        distinct.mapInArrow(_encode(tokenizer_path), _CACHE).write.mode("append").parquet(cache_path)

    counts = cache().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = keyed.select(id_col, "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
