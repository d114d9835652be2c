"""Incremental, reversible removal of lines that many documents share.

A line's key is the line without white space at its ends and with A-Z in lower case, named by its MD5 digest. An index of a corpus holds

* exact reference counts: an append-only table of (digest, doc_id, delta), a row for each key of a document, +1 where a document came and
  -1 where it went; a key's documents are those whose deltas sum to more than none;
* of the keys that are repeated at the moment, that is found in `least` documents or more, their exact counts and largest documents;
* a cuckoo filter for each shard with those keys. Fingerprints can be
  taken out again, and only those are taken out that the exact counts say are inside, so an index after insertions and deletions is the one that
  the documents still there would have made.

Documents are judged by their lines' keys: those that a filter has not are certainly not repeated and go no further; only hits meet the exact counts, which
name the largest document of each key and undo false hits. Filters travel to the keys, not keys to one place: the rows of a shard are dealt to
as many tasks as its size asks for, behind a copy of the shard's filter, so a line in a third of all documents is no hot key.

A batch counts when its row in `commits` is written, after all of its files; what a failed batch left is not read. One writer at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import released
from .sampling import small_batches
from .shared import fresh_path, written
from .words import as_binary, mix

SPACE = b" \t\n\x0b\x0c\r"
SLOTS, FULL = 4, 0.9
#: Repeated keys of a shard, at most twice as many, and rows that are probed behind one copy of a filter.
SHARD_KEYS, PROBED = 1 << 15, 1 << 15


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets. Keys are rows of two 64-bit integers, no row twice.

    A key that was inserted is always found, others once in about 2^13. Takes any number of keys: `build` doubles the table until all have a place.
    """

    def __init__(self, table: np.ndarray, n: int):
        self.table, self.n = table, n

    @staticmethod
    def build(keys: np.ndarray) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * FULL < len(keys):
            buckets *= 2
        while True:
            made = CuckooFilter(np.zeros((buckets, SLOTS), np.uint16), 0)
            if made.insert(keys):
                return made
            buckets *= 2

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of each key; either bucket and the fingerprint give the other."""
        fp = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.table) - 1)
        a = keys[:, 0] & mask
        return fp, a.astype(np.int64), (a ^ (mix(fp.astype(np.uint64)) & mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(keys)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray, kicks: int = 500) -> bool:
        """Whether all keys found a place; if not, the filter must be built anew from its keys."""
        fp, a, b = self.places(keys)
        mask = np.uint64(len(self.table) - 1)
        at, chance = a.copy(), np.random.default_rng(len(keys))
        for turn in range(kicks):
            if not len(fp):
                self.n += len(keys)
                return True
            if turn == 1:
                at = (at.astype(np.uint64) ^ (mix(fp.astype(np.uint64)) & mask)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at)  # those that want one bucket take its free slots in turn
            free = self.table[at] == 0
            fits = nth < free.sum(1)
            slot = np.argmax(free.cumsum(1) > nth[:, None], axis=1)
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at, nth = fp[~fits], at[~fits], nth[~fits]
            if turn and len(fp):  # one of each bucket drives out a fingerprint, which goes to its other bucket
                one = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                slot = chance.integers(0, SLOTS, len(one))
                out = self.table[at[one], slot]
                self.table[at[one], slot] = fp[one]
                fp[one] = out
                at[one] = (at[one].astype(np.uint64) ^ (mix(out.astype(np.uint64)) & mask)).astype(np.int64)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are inside. A key that isn't is an error."""
        for fp, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                where = np.flatnonzero(self.table[bucket] == fp)
                if len(where):
                    self.table[bucket, where[0]] = 0
                    break
            else:
                raise ValueError("a key that was never inserted can't be deleted")
        self.n -= len(keys)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def from_bytes(raw: bytes, n: int) -> CuckooFilter:
        return CuckooFilter(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy(), n)


def line_keys(text: bytes, shortest: int) -> list[bytes]:
    """The digest of each line's key, empty for keys of fewer than `shortest` code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()  # of bytes: A-Z alone
        long = len(key) >= shortest and (key.isascii() or len(key.decode(errors="replace")) >= shortest)
        out.append(hashlib.md5(key, usedforsecurity=False).digest() if long else b"")
    return out


def _refs(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_binary(batch.column(1))
            for doc_id, text in zip(ids, texts, strict=True):
                keys = [k for k in dict.fromkeys(line_keys(text.as_py(), shortest)) if k]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.full(len(keys), doc_id, np.int64))], ["digest", "doc_id"])

    return released(run)


def _pairs(digests: pa.Array) -> np.ndarray:
    """Digests as rows of two integers."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, filter, n, digest, doc_id), a part's filter before its keys: the keys that the filter has."""
    part, inside = None, None
    for batch in batches:
        parts, filters = batch.column(0).to_numpy(), batch.column(1)
        cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else []
        for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True):
            if parts[a] != part:
                part, inside = parts[a], None
            while a < b and filters[int(a)].is_valid:
                inside = CuckooFilter.from_bytes(filters[int(a)].as_py(), batch.column(2)[int(a)].as_py())
                a += 1
            if inside is None or a == b:
                continue
            rows = batch.slice(a, b - a)
            hit = pa.array(inside.contains(_pairs(rows.column(3))))
            yield pa.RecordBatch.from_arrays([rows.column(3).filter(hit), rows.column(4).filter(hit)], ["digest", "doc_id"])


def _changed(key: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
    """The filter of a shard after its changes (digest, whether it belongs inside now). A filter that is full is null: it is made anew from the exact counts."""
    if not changes.num_rows:
        return old
    keys, now = _pairs(changes["digest"].combine_chunks()), changes["now"].to_numpy()
    full = False
    if old.num_rows:
        f = CuckooFilter.from_bytes(old["filter"][0].as_py(), old["n"][0].as_py())
        f.delete(keys[~now])
        full = not f.insert(keys[now])
    else:
        f = CuckooFilter.build(keys[now])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([None if full else f.to_bytes()], pa.binary()), "n": pa.array([f.n], pa.int64())})


class LineIndex:
    """An index of documents' lines in a folder that driver and executors share.

    shortest: code points that a key needs to take part; least: documents that make it a repeated one. Rows without an id, and null texts, hold no
    references; repeated rows of one id are one document with the lines of all. A document that is added again stays one document.
    """

    def __init__(self, spark: SparkSession, path: str, shortest: int = 20, least: int = 3):
        self.spark, self.path, self.shortest, self.least = spark, path, shortest, least
        self.commits: list[tuple[int, str, str, str, int]] = []  # batch, refs, repeated, filters, shards
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            self.commits = sorted((r.batch, r.refs, r.repeated, r.filters, r.shards) for r in spark.read.parquet(f"{path}/commits").collect())

    REFS, REPEATED, FILTERS = "digest binary, doc_id long, delta long", "digest binary, documents long, last long", "shard int, filter binary, n long"

    @property
    def shards(self) -> int:
        return self.commits[-1][4] if self.commits else 0

    def refs(self) -> DataFrame:
        """(digest, doc_id, delta) of all batches."""
        return self.spark.read.schema(self.REFS).parquet(*[c[1] for c in self.commits]) if self.commits else self.spark.createDataFrame([], self.REFS)

    def repeated(self) -> DataFrame:
        """(digest, documents, last) of the keys that are repeated at the moment."""
        return self.spark.read.schema(self.REPEATED).parquet(self.commits[-1][2]) if self.commits else self.spark.createDataFrame([], self.REPEATED)

    def filters(self) -> DataFrame:
        return self.spark.read.schema(self.FILTERS).parquet(self.commits[-1][3]) if self.commits else self.spark.createDataFrame([], self.FILTERS)

    @staticmethod
    def _living(refs: DataFrame) -> DataFrame:
        """(digest, doc_id) of documents that are there."""
        return refs.groupBy("digest", "doc_id").agg(F.sum("delta").alias("delta")).filter("delta > 0").select("digest", "doc_id")

    def counts(self, refs: DataFrame | None = None) -> DataFrame:
        """(digest, documents, last): exact reference counts, last the largest document."""
        return self._living(self.refs() if refs is None else refs).groupBy("digest").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last"))

    def keys(self, docs: DataFrame) -> DataFrame:
        """(digest, doc_id) of documents' keys."""
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).filter("doc_id is not null and text is not null")
        with small_batches(self.spark):
            return texts.mapInArrow(_refs(self.shortest), "digest binary, doc_id long")

    def add(self, docs: DataFrame) -> DataFrame:
        """Insert documents; gives their (digest, doc_id), written."""
        keys = written(self.keys(docs), "line-keys")
        self._commit(keys.distinct().select("digest", "doc_id", F.lit(1).cast("long").alias("delta")))
        return keys

    def remove(self, ids: DataFrame) -> None:
        """Take out the documents of a column doc_id; unknown and null ids change nothing."""
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        held = self.refs().join(gone, "doc_id", "left_semi").groupBy("digest", "doc_id").agg(F.sum("delta").alias("delta"))
        self._commit(held.filter("delta > 0").select("digest", "doc_id", (-F.col("delta")).alias("delta")))

    def _sharded(self, df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))

    def _commit(self, change: DataFrame) -> None:
        batch = self.commits[-1][0] + 1 if self.commits else 1
        refs_at, repeated_at, filters_at = (f"{self.path}/{kind}/{uuid.uuid4().hex}" for kind in ("refs", "repeated", "filters"))
        change.select("digest", "doc_id", "delta").write.parquet(refs_at)
        new = self.spark.read.schema(self.REFS).parquet(refs_at)
        before = self.repeated()
        if not self.commits:  # a row each is a document each
            repeated = new.groupBy("digest").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last")).filter(F.col("documents") >= self.least)
        else:  # the counts of the keys that this batch touches are made anew; hot keys are split by the adaptive skew join, as what follows deals by document too
            touched = written(new.select("digest").distinct(), "line-touched")
            every = self.refs().join(touched, "digest", "left_semi").unionByName(new).repartition("digest", "doc_id")
            after = self.counts(every).filter(F.col("documents") >= self.least)
            repeated = before.join(touched, "digest", "left_anti").unionByName(after)
        repeated.select("digest", "documents", "last").write.parquet(repeated_at)
        repeated = self.spark.read.schema(self.REPEATED).parquet(repeated_at)
        inside = repeated.count()
        shards = max(1, self.shards)
        while shards * SHARD_KEYS * 2 < inside:
            shards *= 2
        all_of = self._sharded(repeated.select("digest", F.lit(True).alias("now")), shards)
        none = self.spark.createDataFrame([], self.FILTERS)
        if shards != self.shards:  # the first batch, or more keys than the shards are for: all are dealt anew
            made = self._filters(none, all_of)
        else:
            come = repeated.join(before, "digest", "left_anti").select("digest", F.lit(True).alias("now"))
            gone = before.join(repeated, "digest", "left_anti").select("digest", F.lit(False).alias("now"))
            made = written(self._filters(self.filters(), self._sharded(come.unionByName(gone), shards)), "line-filters")
            full = [r.shard for r in made.filter("filter is null").select("shard").collect()]
            if full:
                made = made.filter("filter is not null").unionByName(self._filters(none, all_of.filter(F.col("shard").isin(full))))
        made.write.parquet(filters_at)
        commit = (batch, refs_at, repeated_at, filters_at, shards)
        self.spark.createDataFrame([commit], "batch long, refs string, repeated string, filters string, shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.commits.append(commit)

    def _filters(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """Shards' filters after changes (shard, digest, now): a shard's changes are at most its keys."""
        return old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_changed, self.FILTERS)

    def hits(self, keys: DataFrame) -> DataFrame:
        """The rows (digest, doc_id) whose keys the filters have: all repeated keys, and a false one now and then."""
        if not self.commits:
            return keys.limit(0)
        sizes = self._sharded(keys, self.shards).groupBy("shard").agg(F.ceil(F.count("*") / PROBED).cast("int").alias("parts"))
        sizes = written(sizes, "line-parts")
        most = sizes.agg(F.max("parts")).first()[0]
        if most is None:
            return keys.limit(0)
        part = lambda of: (F.col("shard").cast("long") * most + of).alias("part")
        copies = self.filters().join(sizes, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(part(F.col("copy")), "filter", "n", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("doc_id"))
        rows = self._sharded(keys, self.shards).join(F.broadcast(sizes), "shard") if self.shards <= 100_000 else self._sharded(keys, self.shards).join(sizes, "shard")
        rows = rows.select(part(F.pmod(F.xxhash64("doc_id"), F.col("parts"))), F.lit(None).cast("binary").alias("filter"), F.lit(None).cast("long").alias("n"), "digest", "doc_id")
        led = copies.unionByName(rows).repartition("part").sortWithinPartitions("part", F.col("filter").isNull())
        return led.mapInArrow(released(_probe), "digest binary, doc_id long")

    def dropped(self, keys: DataFrame) -> DataFrame:
        """(doc_id, digests) of documents that lose lines: keys that are repeated, by their exact counts, in all but their largest document."""
        hits = written(self.hits(keys), "line-hits").distinct()
        lost = hits.join(self.repeated(), "digest").filter(F.col("doc_id") != F.col("last"))
        return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))

    def kept(self, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """(doc_id, text, n_lines, n_dropped) of each row: what is left of its lines, in order. keys: what `add` gave for these documents, if at hand.

        Null texts are empty ones, of one empty line. Rows without an id stay whole.
        """
        lost = written(self.dropped(written(self.keys(docs), "line-keys") if keys is None else keys), "line-lost")
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        known = texts.filter("doc_id is not null").join(lost, "doc_id", "left")
        rows = known.unionByName(texts.filter("doc_id is null").withColumn("digests", F.lit(None).cast("array<binary>")))
        with small_batches(self.spark):
            return rows.mapInArrow(_without(self.shortest), "doc_id long, text string, n_lines long, n_dropped long")


def _without(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = as_binary(batch.column(1)), batch.column(2)
            out, lines, gone = [], [], []
            for i, text in enumerate(texts):
                raw = text.as_py()
                n = raw.count(b"\n") + 1
                lost = set(lists[i].as_py()) if lists[i].is_valid else None
                if lost:
                    stay = [line for line, key in zip(raw.split(b"\n"), line_keys(raw, shortest), strict=True) if key not in lost]
                    raw = b"\n".join(stay)
                out.append(raw)
                lines.append(n)
                gone.append(n - len(stay) if lost else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    return released(run)


def line_dedup(docs: DataFrame, shortest: int = 20, least: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of each row of a table by an index of that table."""
    index = LineIndex(docs.sparkSession, fresh_path(docs.sparkSession, "line-index"), shortest, least)
    return index.kept(docs, index.add(docs))
