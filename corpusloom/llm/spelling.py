"""Spelling variants of a vocabulary: words one edit apart, without a pair of words in any table.

Every word stands in one group for each of its places, of all words that differ from it at most at that place (position, prefix,
suffix). A group keeps its size and its two foremost words, so each of its words learns how many replacements it has there and which is the
foremost other one. Every word with a code point taken out meets the vocabulary: that word is one deletion away, and the word met learns how many
longer ones it has and the foremost. All of that is one shuffle by key, and one that adds up what each word has learned.

Words are numbered by falling count, then in code-point order, so a smaller number is the foremost. Keys are four polynomial residues in two
integers each (about 124 bits), made by prefix sums: a word of any length costs rows in proportion to its length, and no row holds a piece of text.
A group has at most as many words as an alphabet has letters, and a word met by deletions at most as many as there are insertions into it, so no key is hot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ids import with_dense_id
from .memory import released
from .sampling import small_batches
from .shared import written

#: Distinct words that a task holds before it sends their counts on, code points of words that it makes keys of at once, and of text that it splits at once.
HELD, PIECE, TEXT = 200_000, 1 << 16, 1 << 20
#: Fixed primes below 2^31 and a base for each: residues' products fit in 64 bits.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1103515245, 1299721, 69069, 1664525], np.uint64)
WILDCARD, WORD, DELETION = 0, 1, 2


def _runs(text: str, runs: re.Pattern, between: re.Pattern) -> Counter[str]:
    """How often each run is in a text, which is read in slices that end between runs."""
    found: Counter[str] = Counter()
    a = 0
    while a < len(text):
        end = between.search(text, a + TEXT)
        b = end.start() if end else len(text)
        found.update(runs.findall(text, a, b))
        a = b
    return found


def _words(least: int, period: int):
    runs, between = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}"), re.compile("[^A-Za-zÀ-ÿ]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in _runs(text.as_py(), runs, between).items():
                    low = word.encode().lower()  # of bytes: A-Z alone
                    h = zlib.crc32(low, key)
                    if h % period == 0:
                        at = h % len(word)
                        low = (word[:at] + word[at + 1 :]).encode().lower()
                        if len(word) <= least:
                            continue
                    if low not in held:
                        size += len(low)
                    held[low] += n
                if len(held) >= HELD or size >= 16 * HELD:
                    yield _counts(held)
                    held, size = Counter(), 0
        yield _counts(held)

    return released(run)


def _counts(held: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = 6, count: int = 5, period: int = 199) -> DataFrame:
    """(word, n): words of at least `least` code points that occur at least `count` times in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where the unsigned crc32 of `<doc_id>:<word>` is divisible by `period`,
    the word's code point at that crc32 modulo its length is left out. Null texts have no words; without an id a document's id is empty; repeated rows count each.
    """
    texts = docs.select(docs["doc_id"].cast("string").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        parts = texts.mapInArrow(_words(least, period), "word string, n long")
        return written(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count), "spelling-vocabulary")


def _powers(n: int) -> np.ndarray:
    """(4, n): the first n powers of each base, by doubling."""
    out = np.ones((4, max(n, 1)), np.uint64)
    made = 1
    step = BASES.copy()
    while made < n:
        more = min(made, n - made)
        out[:, made : made + more] = out[:, :more] * step[:, None] % PRIMES[:, None]
        made, step = made + more, step * step % PRIMES
    return out


def _inverse() -> np.ndarray:
    return np.array([pow(int(b), -1, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)


def _pack(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers from four residues below 2^31."""
    return ((h[0] << np.uint64(31)) | h[1]).astype(np.int64), ((h[2] << np.uint64(31)) | h[3]).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, place, k1, k2, rank): each word's own key, those of its deletions, and those of its wildcard groups."""
    p, inverse = PRIMES[:, None], _inverse()[:, None]
    powers = _powers(1 << 10)

    def rows(kind: int, place, h, rank) -> pa.RecordBatch:
        k1, k2 = _pack(h)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), kind, np.int32)), pa.array(np.broadcast_to(place, k1.shape).astype(np.int64)), pa.array(k1), pa.array(k2), pa.array(np.broadcast_to(rank, k1.shape).astype(np.int64))], ["kind", "place", "k1", "k2", "rank"])

    for batch in batches:
        words, ranks = batch.column(0), batch.column(1).to_numpy()
        first = 0
        while first < len(ranks):
            last, size, some = first, 0, []
            while last < len(ranks) and size < PIECE:
                some.append(words[last].as_py())
                size += len(some[-1])
                last += 1
            rank, first = ranks[first:last], last
            points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.uint64)
            length = np.array([len(x) for x in some], np.int64)
            start = np.concatenate([[0], np.cumsum(length)])
            of = np.repeat(np.arange(len(some)), length)
            at = np.arange(len(points)) - start[of]
            if length.max() + 1 > powers.shape[1]:
                powers = _powers(int(length.max()) + 1)
            terms = points * powers[:, at] % p  # code points are below 2^21
            sums = np.concatenate([np.zeros((4, 1), np.uint64), np.cumsum(terms, axis=1)], axis=1)
            whole = (sums[:, start[1:]] - sums[:, start[:-1]]) % p
            yield rows(WORD, length, whole, rank)
            for a in range(0, len(points), PIECE):
                b = min(a + PIECE, len(points))
                w = of[a:b]
                before = (sums[:, a:b] - sums[:, start[w]]) % p
                after = (sums[:, start[w + 1]] - sums[:, a + 1 : b + 1]) % p
                yield rows(WILDCARD, (at[a:b] << 32) | length[w], (before + after) % p, rank[w])
                new = at[a:b] == 0
                new[1:] |= points[a + 1 : b] != points[a : b - 1]
                if a:
                    new[0] |= points[a] != points[a - 1]
                yield rows(DELETION, length[w[new]] - 1, (before[:, new] + after[:, new] * inverse) % p, rank[w[new]])


def variants(vocab: DataFrame, ratio: int = 5, most_steps: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary of distinct words (word, n).

    Near words differ by one inserted, deleted or replaced code point. form: the near word of largest n, the smallest in code-point order among equals, if its n is at
    least `ratio` times the word's; else null, and form_n too. root: where the forms end; the word itself without a form. n_near: 0 for words without near ones.
    Counts rise by `ratio` from form to form, so chains have few steps; ratio must be 2 or more. Null or empty words are left out. An empty vocabulary gives none.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: chains of forms could have no end")
    numbered = with_dense_id(vocab.filter("word is not null and word <> ''").select("word", F.col("n").cast("long").alias("n")), "rank", F.desc("n"), F.asc("word"))
    numbered = written(numbered.select("word", "n", "rank"), "spelling-words")
    with small_batches(vocab.sparkSession):
        keys = numbered.select("word", "rank").mapInArrow(released(_keys), "kind int, place long, k1 long, k2 long, rank long")
        # a wildcard group has its own place, so kinds never share a group but words and deletions of one length
        group = W.partitionBy("wild", "place", "k1", "k2").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        kind = F.col("kind")
        seen = keys.withColumn("wild", kind == WILDCARD).select(
            "rank", "kind", F.count("*").over(group).alias("size"), F.first("rank").over(group).alias("top"), F.nth_value("rank", 2).over(group).alias("next"),
            F.max(F.when(kind == WORD, F.col("rank"))).over(group).alias("met"), F.min(F.when(kind == DELETION, F.col("rank"))).over(group).alias("longer"),
        )
        other = F.when(F.col("top") == F.col("rank"), F.col("next")).otherwise(F.col("top"))
        learned = seen.filter((F.col("size") > 1) & ((kind == WILDCARD) | F.col("met").isNotNull())).select(
            "rank", F.when(kind == DELETION, 1).otherwise(F.col("size") - 1).alias("near"), F.when(kind == WILDCARD, other).when(kind == WORD, F.col("longer")).otherwise(F.col("met")).alias("best")
        )
        near = written(learned.groupBy("rank").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best")), "spelling-near")
    counts = numbered.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    words = numbered.join(near.join(counts, "best"), "rank", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    words = words.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form_rank"), F.when(is_form, F.col("best_n")).alias("form_n"))
    words = written(words, "spelling-forms")
    linked = words.filter("form_rank is not null")
    roots = written(linked.select("rank", F.col("form_rank").alias("root_rank")), "spelling-roots")
    for _ in range(most_steps):  # each step doubles how far a word sees
        onward = roots.select(F.col("rank").alias("root_rank"), F.col("root_rank").alias("onward"))
        after = written(roots.join(onward, "root_rank", "left").select("rank", F.coalesce("onward", "root_rank").alias("root_rank"), F.col("onward").isNotNull().alias("moved")), "spelling-roots")
        roots = after.select("rank", "root_rank")
        if after.filter("moved").isEmpty():
            break
    name = lambda key, alias: words.select(F.col("rank").alias(key), F.col("word").alias(alias))
    named = linked.select("rank", "form_rank").join(roots, "rank").join(name("form_rank", "form"), "form_rank").join(name("root_rank", "root"), "root_rank").select("rank", "form", "root")
    return words.join(named, "rank", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 6, count: int = 5, period: int = 199, ratio: int = 5) -> DataFrame:
    """`variants` of the `vocabulary` of all documents. Columns but doc_id and text are ignored."""
    return variants(vocabulary(docs, least, count, period), ratio)
