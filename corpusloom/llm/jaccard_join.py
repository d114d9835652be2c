"""Size-aware n-gram Jaccard join, and the groups that its links form.

A document's set holds the hashes of its distinct word shingles. Documents of one set are one class; classes meet by
one of two ways, chosen by set size:

* light: a set of at most `boundary` shingles lists all subsets of the size that any linked pair must share, and
  classes meet on equal subsets;
* heavy: larger sets go to inverted lists of their prefix: the share of shingles that one of two linked sets can't
  do without, common shingles last, so a passage of many documents makes no long list.

The boundary minimises subsets listed plus list entries scanned, from the size histogram. Classes
that meet are compared by parity bitmaps, whose differing bits never exceed the sets' difference, and what
passes is verified on whole sets.

Long lists come from groups of near copies. Only pairs with the list's first class are verified at once. Lists of one
first class are then one cluster; clusters whose classes lie in more than one group are compared again, those outside
the cluster's main group against all, in blocks. So no list's pairs are all emitted, and none is lost between groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.names import every, unused
from ..operators.ids import with_dense_id
from .components import components
from .memory import released
from .sampling import at_least, small_batches
from .shared import written
from .words import PLACES, lists, mix, shingles, words_of

WORDS, THRESHOLD = 4, 85  # per cent
#: Lists up to SMALL classes are paired in full. Shingles in the prefixes of more documents than that count as common; at most COMMON of them, the most frequent.
SMALL, COMMON, BLOCK = 8, 500_000, 512
#: Rows of a narrow table that are sent to all tasks, after they have been counted; larger tables are joined by a shuffle.
SENT = 1_000_000
#: Largest boundary that is considered.
MOST_LIGHT = 20


def least_overlap(a, b, percent: int = THRESHOLD):
    """Shared shingles that sets of sizes a and b need: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n, percent: int = THRESHOLD):
    return n - (percent * n + 99) // 100 + 1


def light_tags(n: int, percent: int = THRESHOLD) -> list[tuple[int, int]]:
    """(size of the smaller set, subset size) for which a set of n shingles lists its subsets."""
    return [(a, int(least_overlap(a, a, percent))) for a in range(-(-percent * n // 100), n + 1) if a * 100 >= percent * n]


def light_cost(n: int, percent: int = THRESHOLD) -> int:
    return sum(comb(n, c) for _, c in light_tags(n, percent))


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row bounds, hashes): each row's distinct shingle hashes in ascending order."""
    for w in words_of(column):
        first, h = shingles(w, k)
        row = w.row[first] - w.first_row
        count, at = w.counts(), w.bounds()
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):  # the whole sequence as one, told apart from shingles by its length
            total = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                there = count[few] > i
                total[there] += w.hash[at[few[there]] + i] * PLACES[i]
            h, row = np.concatenate([h, mix(total ^ (count[few].astype(np.uint64) << np.uint64(56)))]), np.concatenate([row, few])
        order = np.argsort(h)
        order = order[np.argsort(row[order].astype(np.uint16 if w.n_rows < 1 << 16 else np.int64), kind="stable")]
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield w.first_row, w.n_rows, np.searchsorted(row, np.arange(w.n_rows + 1)), h


def _class_of(bounds: np.ndarray, h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each row's set (0 for empty ones); names of different salts are independent."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(np.array([0xA5A5A5A55A5A5A5A + salt], np.uint64))), dtype=np.uint64)])
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix((sums[bounds[1:]] - sums[bounds[:-1]]) * np.uint64(3) + n), np.uint64(0)).view(np.int64)


def _take_prefix(bounds: np.ndarray, h: np.ndarray, common: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's prefix in the order: not common before common, then by hash."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    if common is not None and len(common):
        late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        key = row * 2 + late
        order = np.argsort(key.astype(np.uint16 if len(n) < 1 << 15 else np.int64), kind="stable")
        h = h[order]
    rank = np.arange(len(h)) - bounds[row]
    keep = rank < prefix_size(n, percent)[row]
    return row[keep], h[keep]


def parity_bits(bounds: np.ndarray, h: np.ndarray) -> list[bytes]:
    """For each row, as many bits as the power of two that is twice its set's size or just above, and 64 at least: whether an odd number of hashes fall on each."""
    n = np.diff(bounds)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(n)), n)
    place = at[row] + ((h >> np.uint64(20)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=at[-1]) & 1, bitorder="little").tobytes()
    at = (at // 8).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer folded to the shorter."""
    p, q = (np.frombuffer(v, np.uint8) for v in sorted((x, y), key=len))
    q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)
    return int(np.bitwise_count(p ^ q).sum())


def _describe(k: int, percent: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, bounds, h in sets_of(batch.column(1), k):
                row, prefix = _take_prefix(bounds, h, None, percent)
                at = np.searchsorted(row, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(np.diff(bounds)), pa.array(_class_of(bounds, h, salt)), pa.array(_class_of(bounds, h, -1)), lists(prefix.view(np.int64), at, pa.int64()), pa.array(parity_bits(bounds, h), pa.binary())],
                    ["doc_id", "n", "class", "check", "prefix", "bits"],
                )

    return run


def _subset_keys(h: np.ndarray, percent: int) -> Iterator[int]:
    for a, c in light_tags(len(h), percent):
        if c:
            salted = mix(h ^ np.uint64(a * 0x9E37 + 0x1234567))
            for some in combinations(salted.tolist(), c):
                yield sum(some) & 0xFFFFFFFFFFFFFFFF


def _entries(common, boundary: int, k: int, percent: int, salt: int):
    """(h, class, n) of inverted lists and subset keys, once for each class that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        reach = -(-percent * (boundary + 1) // 100)
        for batch in batches:
            for _, _, bounds, h in sets_of(batch.column(0), k):
                name, n = _class_of(bounds, h, salt), np.diff(bounds)
                new = np.zeros(len(n), bool)
                for i, c in enumerate(name.tolist()):
                    if n[i] and c not in seen:
                        seen.add(c)
                        new[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                row, prefix = _take_prefix(bounds, h, common.value, percent)
                keep = new[row] & (n[row] >= max(reach, 2 if boundary else 1))
                row, prefix = row[keep], prefix[keep]
                light_row, light = [], []
                for i in np.flatnonzero(new & (n <= boundary)):
                    keys = list(_subset_keys(h[bounds[i] : bounds[i + 1]], percent))
                    light += keys
                    light_row += [i] * len(keys)
                row = np.concatenate([row, np.array(light_row, np.int64)])
                keys = np.concatenate([prefix, mix(np.array(light, np.uint64))])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(name[row]), pa.array(n[row])], ["h", "class", "n"])

    return run


def _meet(percent: int):
    """Pairs of sorted list entries (h, class, n), and the entries of long lists; reads lists as a stream, however long.

    Rows out: (first, a, na, b, nb); first is null for a pair, b null for a class of a long list, and then first is the list's first class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []  # the list's first classes, up to SMALL + 1
        now = last = None
        out: list[tuple] = []

        def pair(x, y):
            if min(x[1], y[1]) * 100 >= percent * max(x[1], y[1]):
                out.append((None, *min(x, y), *max(x, y)))

        def close():
            if 1 < len(held) <= SMALL:
                for x, y in combinations(held, 2):
                    pair(x, y)

        for batch in batches:
            h, c, n = (batch.column(i).to_numpy() for i in range(3))
            single = np.ones(len(h), bool)  # lists of one entry inside the batch say nothing
            single[:-1] &= h[:-1] != h[1:]
            single[1:] &= h[1:] != h[:-1]
            if len(h):
                single[0] = single[-1] = False
            keep = ~single
            for x in zip(h[keep].tolist(), c[keep].tolist(), n[keep].tolist(), strict=True):
                if x[0] != now:
                    close()
                    held, now, last = [x[1:]], x[0], x[1]
                elif x[1] != last:
                    last = x[1]
                    if len(held) <= SMALL:
                        held.append(x[1:])
                        if len(held) == SMALL + 1:
                            out.extend((held[0][0], *y, None, None) for y in held)
                            for y in held[1:]:
                                pair(held[0], y)
                    else:
                        out.append((held[0][0], *x[1:], None, None))
                        pair(held[0], x[1:])
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        close()
        yield _rows(out)

    def _rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["first", "a", "na", "b", "nb"])

    return run


def _sets(k: int, salt: int):
    """(class, set) rows of (text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, bounds, h in sets_of(batch.column(0), k):
                raw, at = h.tobytes(), (bounds * 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(_class_of(bounds, h, salt)), pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["class", "set"])

    return run


def _near(percent: int):
    """Pairs (a, b, na, nb, x, y) whose bitmaps x and y leave them a chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = na + nb - 2 * least_overlap(na, nb, percent)
            apart = [bits_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                o = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * o >= percent * (len(p) + len(q) - o))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Links of a block: its outsiders against all its members of other groups."""
    import pandas as pd

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["outside", "class"], ascending=[False, True]).drop_duplicates("class").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in block["set"]]
        size = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
        group, out = block["root"].to_numpy().copy(), []
        for i in np.flatnonzero(block["outside"].to_numpy()):
            if (group == group[i]).all():
                break
            mine = sets[i]
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            o = np.add.reduceat(hit.astype(np.int64), starts)
            for j in np.flatnonzero((100 * o >= percent * (size + size[i] - o)) & (group != group[i])):
                if group[j] != group[i]:
                    out.append((block["class"][i], block["class"][j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def choose_boundary(histogram: dict[int, int], per_entry: float, percent: int = THRESHOLD) -> int:
    """The set size up to which subsets cost less than list entries, of which each costs itself and what it meets."""
    best, least, x_cost = 0, None, 0.0
    heavy = lambda n: int(prefix_size(n, percent)) * (1 + per_entry)
    total = sum(heavy(n) * c for n, c in histogram.items() if n)
    for x in range(MOST_LIGHT + 1):
        reach = -(-percent * (x + 1) // 100)
        x_cost += light_cost(x, percent) * histogram.get(x, 0) if x else 0
        cost = x_cost + total - sum(heavy(n) * histogram.get(n, 0) for n in range(1, reach))
        if least is None or cost < least:
            best, least = x, cost
    return best


def _narrow(table: DataFrame, name: str) -> DataFrame:
    """A table of a few numbers a row, written to files of ordinary size, not one for each task that had a few of its rows."""
    return written(table.hint("rebalance"), name)


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, sent to all tasks if it has at most SENT rows."""
    return F.broadcast(table) if table.count() <= SENT else table


def jaccard_groups(docs: DataFrame, k: int = WORDS, percent: int = THRESHOLD, boundary: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class) of every row.

    Null texts and texts without a word are empty sets, which link with nothing and are their own component; texts of fewer
    than k words are one shingle; repeated rows are members of one class; a row without an id never names a
    component, and where all rows of a set have none, they have no links and a null component; an empty table
    gives an empty table; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, k, percent, boundary)


def _groups(docs: DataFrame, k: int, percent: int, boundary: int | None, salt: int = 1) -> DataFrame:
    """Every Python stage runs inside, by a written table.

    A set's name has 64 bits, and a second name of another salt tells whether two sets share it; then all are named anew.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    described = written(texts.mapInArrow(released(_describe(k, percent, salt)), "doc_id long, n long, class long, check long, prefix array<long>, bits binary"), "jaccard-sets")
    members = described.select("doc_id", "n", "class")
    named = written(described.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), (F.min("check") == F.max("check")).alias("one")), "jaccard-named")
    if named.filter("not one").limit(1).count():
        return _groups(docs, k, percent, boundary, salt + 1)
    named = named.select("class", "rep")

    met_by, n = Observation(), F.col("count")
    counts = described.select(F.explode("prefix").alias("h")).groupBy("h").count()
    counts = counts.observe(met_by, F.sum(F.when(n <= SMALL, n * n)).alias("squares"), F.sum(F.when(n <= SMALL, n)).alias("entries"))
    frequent = at_least(_narrow(counts.filter(n > SMALL), "jaccard-common"), "count", COMMON).select("h").toArrow()
    common = np.sort(frequent.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) if frequent.num_rows else np.zeros(0, np.uint64)
    if boundary is None:
        sizes = {r.n: r["count"] for r in members.filter(F.col("n") <= 2 * MOST_LIGHT).groupBy("n").count().collect()}
        boundary = choose_boundary(sizes, (met_by.get["squares"] or 1) / (met_by.get["entries"] or 1), percent)
    sent = spark.sparkContext.broadcast(common)  # of at most COMMON hashes

    entries = texts.select("text").mapInArrow(released(_entries(sent, boundary, k, percent, salt)), "h long, class long, n long")
    met = entries.repartition("h").sortWithinPartitions("h", "class").mapInArrow(released(_meet(percent)), "first long, a long, na long, b long, nb long")
    met = _narrow(met, "jaccard-met")
    clusters = written(met.filter("first is not null").select("first", F.col("a").alias("class")).distinct(), "jaccard-clusters")
    pairs = written(met.filter("first is null").select("a", "b", "na", "nb").distinct(), "jaccard-pairs")

    of_pairs = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "jaccard-paired")
    bits = written(described.select("class", "bits").join(_small(of_pairs), "class", "left_semi").dropDuplicates(["class"]), "jaccard-bits")
    near = pairs.join(bits.select(F.col("class").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("class").alias("b"), F.col("bits").alias("y")), "b")
    pairs = _narrow(near.select("a", "b", "na", "nb", "x", "y").mapInArrow(released(_near(percent)), "a long, b long"), "jaccard-near")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(clusters.select("class")).distinct()
    reps = written(wanted.join(named, "class").filter("rep is not null"), "jaccard-reps")
    ids = _small(written(reps.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-ids"))
    sets = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(released(_sets(k, salt)), "class long, set binary")
    sets = written(sets.dropDuplicates(["class"]), "jaccard-verify")

    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("x")), sets.select(F.col("class").alias("b"), F.col("set").alias("y"))
    seconds = written(pairs.select("b").distinct(), "jaccard-seconds")
    right = right.join(_small(seconds), "b", "left_semi")
    links = left.join(_small(pairs), "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(released(_verify(percent)), "a long, b long")
    links = _narrow(links, "jaccard-links")

    def grouped(edges: DataFrame) -> DataFrame:
        by_rep = edges.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("class").alias("b"), F.col("rep").alias("v")), "b")
        return components(by_rep.select("u", "v"))

    roots = grouped(links)
    rooted = clusters.join(reps, "class").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("first", "class", F.coalesce("root", "rep").alias("root"))
    rooted = written(rooted, "jaccard-rooted")
    parts = rooted.groupBy("first", "root").count()
    main = parts.groupBy("first").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("groups"), F.sum("count").alias("size"), (F.sum("count") - F.max("count")).alias("n_out")).filter("groups > 1")
    if main.limit(1).count():
        blocks = rooted.join(main, "first").withColumn("outside", F.col("root") != F.col("main"))
        of = lambda c: F.pmod(F.xxhash64("class"), F.ceil(F.col(c) / BLOCK))
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / BLOCK) - 1))
        here = blocks.select("first", "class", "root", F.lit(False).alias("outside"), each("n_out").alias("i"), of("size").alias("j"))
        out = blocks.filter("outside").select("first", "class", "root", F.lit(True).alias("outside"), of("n_out").alias("i"), each("size").alias("j"))
        both = sets.join(_small(written(here.unionByName(out), "jaccard-blocks")), "class").select("first", "i", "j", "class", "root", "outside", "set")
        more = both.groupBy("first", "i", "j").applyInPandas(_compare(percent), "a long, b long")
        roots = grouped(links.unionByName(_narrow(more, "jaccard-more")))

    all_roots = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("root", "rep").alias("component_id"))
    result = members.join(all_roots, "class", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "class")


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """One row of docs, all columns, of each component: that of the least id, rows without an id last. Texts without a word all stay.

    Repeated rows are copies; an empty table gives an empty table; other columns stay, whatever their names.
    """
    rows, ids = docs.agg(F.count("*"), F.countDistinct(docs["doc_id"].cast("long"))).first()
    key, numbered = "doc_id", docs
    if rows > ids:  # repeated or null ids don't name rows
        key = unused(docs, "__row")
        numbered = with_dense_id(docs, key, docs["doc_id"].cast("long").asc_nulls_last(), docs["text"].asc())
    groups = jaccard_groups(numbered.select(F.col(key).alias("doc_id"), "text"), k, percent)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return numbered.join(gone, key, "left_anti").select(every(docs))
