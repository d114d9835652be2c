"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are runs of words (letters and digits, A-Z as a-z, so punctuation and case don't
matter). Seeds are windows of `tile` words (of all words, where an item has fewer), hashed by a rolling polynomial; documents join items on
seeds, and seeds that follow each other in both make runs. In each joined pair the longest common run of unmarked words is marked, again
and again, until none of `tile` words is left; tiles may lie in any order. An item is found in a document when
tiles cover the share `coverage` of its words. Words of a tile are compared one by one, so a chance hit of a window's hash finds nothing.

A document's pairs are tiled where it is read, so documents aren't shuffled. Items are met in blocks of at most BLOCK_WORDS words (or one
longer item), AT_ONCE blocks a pass, whose texts are sent to all tasks and indexed there, once a worker. A benchmark of any size takes as many passes over the documents as
that makes, one after another: the driver holds the texts of one pass at a time and no index.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written
from .words import PUNCTUATION, Words, shingles, words_of

TILE, COVERAGE, BLOCK_WORDS, AT_ONCE = 5, 0.5, 500_000, 4
#: Pairs of equal seeds that are held at once; a text and an item that repeat one word have a great many.
PAIRS = 1_000_000

#: Runs of equal seeds: row, item, place in the text less that in the item, place in the item, seeds. One array each.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _joined(runs: Runs) -> Runs:
    """The runs in order, those that go on in one another made one."""
    order = np.lexsort((runs[3], runs[2], runs[1], runs[0]))
    row, item, shift, place, n = (x[order] for x in runs)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] != place[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return row[first], item[first], shift[first], place[first], np.add.reduceat(n, first) if len(first) else n


class ItemIndex:
    """Seeds of a block of items by their number of words, each sorted by hash. The seeds of an item of fewer than `tile` words have all of them."""

    def __init__(self, ids: list[int], texts: list[str | None], tile: int):
        self.ids, self.length = ids, np.zeros(len(ids), np.int64)
        self.words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)  # each item's word hashes
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for w in words_of(pa.array(texts, pa.string()), PUNCTUATION):
            self.length[w.first_row : w.first_row + w.n_rows] = w.counts()
            self.words[w.first_row : w.first_row + w.n_rows] = np.split(w.hash, w.bounds()[1:-1])
            least = np.minimum(w.counts(), tile)
            for k in np.unique(least[least > 0]).tolist():
                first, h = shingles(w, k)
                own = least[w.row[first] - w.first_row] == k
                first, row = first[own], w.row[first[own]]
                parts.setdefault(k, []).append((h[own], row, first - w.bounds()[row - w.first_row]))
        self.least = np.minimum(self.length, tile)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, found in parts.items():
            h, item, place = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((place, item, h))
            self.seeds[k] = h[order], item[order], place[order]

    def runs(self, w: Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, shifts, places in the item, seeds) of the runs of each row and item that share seeds."""
        bounds = w.bounds()
        for k, (seed, item_of, place_of) in self.seeds.items():
            first, h = shingles(w, k)
            lo = np.searchsorted(seed, h)
            inside = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == h)
            if not len(inside):
                continue
            lo, first, h = lo[inside], first[inside], h[inside]
            n = np.searchsorted(seed, h, side="right") - lo
            found, total, a = None, np.cumsum(n), 0
            while a < len(n):  # as many places of the text as make PAIRS pairs, one at least
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
                m = n[a:b]
                at = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                row = np.repeat(w.row[first[a:b]], m)
                place = np.repeat(first[a:b] - bounds[w.row[first[a:b]] - w.first_row], m)
                more = _joined((row, item_of[at], place - place_of[at], place_of[at], np.ones(len(at), np.int64)))
                found = more if found is None else _joined(tuple(np.concatenate(x) for x in zip(found, more, strict=True)))
                a = b
            row, item, *rest = found
            cuts = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
                yield int(row[a]), int(item[a]), *(x[a:b] for x in rest)


def tiles(shift: np.ndarray, place: np.ndarray, seeds: np.ndarray, tile: int, words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words) from runs of seeds: the longest match first, then the earliest in the item, then in the text."""
    heap = list(zip((-(seeds - 1 + tile)).tolist(), place.tolist(), (place + shift).tolist(), strict=True))
    heapq.heapify(heap)
    used_p: set[int] = set()
    used_q: set[int] = set()
    out = []
    while heap and words - len(used_q) >= tile:
        n, y, x = heapq.heappop(heap)
        n = -n
        free = [y + i not in used_q and x + i not in used_p for i in range(n)]
        if all(free):
            used_p.update(range(x, x + n))
            used_q.update(range(y, y + n))
            out.append((x, y, n))
            continue
        begin = None
        for i in range(n + 1):
            if i < n and free[i]:
                begin = i if begin is None else begin
            elif begin is not None:
                if i - begin >= tile:
                    heapq.heappush(heap, (-(i - begin), y + begin, x + begin))
                begin = None
    return out


def _found(index: ItemIndex, coverage: float, w: Words) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(row, item, covered words, tiles) of the pairs that reach the coverage."""
    bounds = w.bounds()
    for row, item, shift, place, seeds in index.runs(w):
        tile, words = int(index.least[item]), int(index.length[item])
        change = np.bincount(place, minlength=words + 1) - np.bincount(place + seeds - 1 + tile, minlength=words + 1)
        if (np.cumsum(change)[:words] > 0).sum() < coverage * words:
            continue  # tiles cover no more than all matches do together
        text = w.hash[bounds[row - w.first_row] : bounds[row - w.first_row + 1]]
        cut = [(x, y, n) for x, y, n in tiles(shift, place, seeds, tile, words) if (text[x : x + n] == index.words[item][y : y + n]).all()]
        covered = sum(n for _, _, n in cut)
        if cut and covered >= coverage * words:
            yield row, item, covered, cut


#: A pass: its name, and ids and texts of each of its blocks.
Blocks = tuple[str, list[tuple[list[int], list[str]]]]
_kept: tuple[tuple[str, int], list[ItemIndex]] | None = None  # by this worker, of the last pass that it worked on


def _indexes(sent: Broadcast[Blocks], tile: int) -> list[ItemIndex]:
    global _kept
    name, blocks = sent.value
    if _kept is None or _kept[0] != (name, tile):
        _kept = None
        _kept = (name, tile), [ItemIndex(ids, texts, tile) for ids, texts in blocks]
    return _kept[1]


def _pairs(blocks: Broadcast[Blocks], tile: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(blocks, tile)
        for batch in batches:
            ids, rows = batch.column(0), []
            for w in words_of(batch.column(1), PUNCTUATION):
                for index in indexes:
                    rows += [(ids[r].as_py(), index.ids[i], c, int(index.length[i]), len(cut), max(n for _, _, n in cut)) for r, i, c, cut in _found(index, coverage, w)]
            kinds = [pa.int64()] * 6
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "covered", "item_words", "n_tiles", "longest"])

    return run


def _clean(blocks: Broadcast[Blocks], tile: int, coverage: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(blocks, tile)
        for batch in batches:
            bad = np.zeros(batch.num_rows, bool)
            for w in words_of(batch.column(text_at), PUNCTUATION):
                for index in indexes:
                    for row, *_ in _found(index, coverage, w):
                        bad[row] = True
            yield batch.filter(pa.array(~bad)) if bad.any() else batch

    return run


def passes(benchmark: DataFrame, block_words: int | None = None, at_once: int = AT_ONCE) -> Iterator[Broadcast[Blocks]]:
    """The items' texts in passes of at most `at_once` blocks, each read when it is asked for; items without a word are left out.

    Items are numbered within hash classes by running length in counted words, so a block is one class's next block_words words (or one longer item). Blocks
    are written once, by block, so that each is read alone.
    """
    block_words = BLOCK_WORDS if block_words is None else block_words
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumn("words", F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long")).filter("words > 0")
    total = items.agg(F.sum("words")).first()[0] or 0
    if total <= block_words * at_once:  # one pass: a block of all
        rows = items.select("item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, [([r.item_id for r in rows], [r.text for r in rows])]))
        return
    classes = int(-(-total // (1 << 22)))  # each of a few million words
    sized = items.withColumn("class", F.pmod(F.xxhash64("item_id", "text"), F.lit(classes)))
    running = W.partitionBy("class").orderBy("item_id", "text").rowsBetween(W.unboundedPreceding, 0)
    sized = sized.withColumn("block", ((F.sum("words").over(running) - 1) / block_words).cast("long")).drop("words")
    sized = written(sized, "benchmark-blocks", "class", "block")
    names = sized.select("class", "block").distinct().orderBy("class", "block").toLocalIterator()
    while group := list(islice(names, at_once)):
        blocks = []
        for b in group:
            rows = sized.filter((F.col("class") == b["class"]) & (F.col("block") == b["block"])).orderBy("item_id", "text").collect()
            blocks.append(([r.item_id for r in rows], [r.text for r in rows]))
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, blocks))


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered, item_words, n_tiles, longest) of each document and item found in it; clean documents have no row.

    Null and empty texts hold nothing; items of fewer than `tile` words are found whole; pairs name an item, so those without an id have none; repeated rows
    of either table give repeated pairs; of equally long matches the earliest in the item counts, then in the text; texts and items that repeat
    one word are tiled like others, in bounded memory; empty tables give no pairs; other columns are ignored.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    kind = "doc_id long, item_id long, covered long, item_words long, n_tiles long, longest long"
    out, last = [], None
    for blocks in passes(benchmark.filter("item_id is not null")):
        if last is not None:  # there are more passes: each is written before the next is read
            out.append(written(last, "benchmark-pairs"))
        last = texts.mapInArrow(_pairs(blocks, tile, coverage), kind)
    if out:
        out.append(written(last, "benchmark-pairs"))
    elif last is not None:
        out.append(last)
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], kind)


def decontaminate(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, in which no item is found, be it with or without an id.

    Null and empty texts stay; repeated rows are judged alike; without items all rows stay; an empty table gives an empty table; other
    columns stay, whatever their names.
    """
    names, text_at = docs.columns, docs.columns.index("text")
    kept = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names that need quotes don't pass through Python
    first = True
    for blocks in passes(benchmark):
        if not first:
            kept = written(kept, "benchmark-kept")
        first, kept = False, kept.mapInArrow(_clean(blocks, tile, coverage, text_at), kept.schema)
    return kept.toDF(*names)
