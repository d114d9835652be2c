"""Document likelihood over all subword segmentations.

The vocabulary is that of an existing subword file. Its stored scores rank the pieces; the ranks
give starting probabilities, which two expectation steps over all training words re-estimate (every
segmentation of a word counts by its share of the word's probability). A document is a run of words, each
spelled by any sequence of pieces of which the first carries the word mark, and an end piece. Its probability is
the sum over all segmentations, computed by a forward recursion in log space.

Scale: words are counted over all documents by a partial, then a shuffled aggregation; the recursion runs once
for each distinct word. Documents add up values of frequent words from a table of at most HEAD words; only
their other words are shuffled to meet the vocabulary's values. Nothing that grows with the
corpus reaches the driver or every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import at_least
from .shared import written
from .words import mix, power_tables, words_of

#: Frequent words whose values every task holds.
HEAD = 200_000
#: The word mark; words of twelve bytes that one recursion holds; the bytes from which a word is taken by itself.
MARK, STEP, LONG = "▁".encode(), 8_000, 256
LN10 = math.log(10)


def read_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file (byte pieces as their byte) and their starting log-probabilities.

    Scores of a merge-trained file are negative ranks, so the r-th best piece starts at 1/(r+2.7), by Zipf's law as Mandelbrot has it.
    Pieces with an inner word mark and bytes A-Z can't occur and are left out; a byte that is also a piece counts as two pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        p = bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).encode().lower()
        if MARK in p[1:] or (model.is_byte(i) and p.isupper()):
            continue
        pieces.append(p)
        scores.append(-1e6 if model.is_byte(i) else model.get_score(i))
    order = np.argsort(-np.array(scores), kind="stable")
    logp = np.empty(len(pieces))
    logp[order] = -np.log(np.arange(len(pieces)) + 2.7)
    merged: dict[bytes, float] = {}
    for p, x in zip(pieces, logp, strict=True):  # pieces that differ in case only are one here
        merged[p] = np.logaddexp(merged[p], x) if p in merged else x
    names = sorted(merged)
    out = np.array([merged[p] for p in names])
    return names, out - np.logaddexp.reduce(out)


class Lattice:
    """Forward (and backward) recursion over many words at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp, self.longest = logp, max(map(len, pieces))
        hashes = self._hashes(b"".join(pieces), np.cumsum([0, *map(len, pieces)]))
        self.order = np.argsort(hashes)
        self.hash = hashes[self.order]
        self.bits = 22
        top = (self.hash >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())

    @staticmethod
    def _sums(text: np.ndarray) -> np.ndarray:
        up, _ = power_tables(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        return sums

    @staticmethod
    def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = power_tables(len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def _hashes(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        return self._span(self._sums(np.frombuffer(raw, np.uint8)), at[:-1], at[1:])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where none."""
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int32)
        for k in range(self.deepest):
            here = np.flatnonzero(at + k < stop)
            here = here[self.hash[at[here] + k] == h[here]]
            out[here] = self.order[at[here] + k]
        return out

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, piece table) of words of one byte length: table[w, i, l-1] is the piece at bytes i to i+l of the marked word, or -1."""
        size = np.array([len(x) for x in words], np.int64) + len(MARK)
        for n in np.unique(size[size <= LONG]):
            which = np.flatnonzero(size == n)
            step = max(1, STEP * 12 // int(n))
            for a in range(0, len(which), step):
                part = which[a : a + step]
                text = np.frombuffer(b"".join(MARK + words[i] for i in part), np.uint8)
                sums, base = self._sums(text), np.arange(len(part))[:, None] * n
                table = np.full((len(part), n, min(self.longest, n)), -1, np.int32)
                for size_l in range(1, min(self.longest, n) + 1):
                    i = np.arange(n - size_l + 1)
                    start = (base + i).ravel()
                    table[:, : len(i), size_l - 1] = self._find(self._span(sums, start, start + size_l)).reshape(len(part), -1)
                yield part, table

    def _forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = np.where(table >= 0, self.logp[table], -np.inf)
        w, n, longest = table.shape
        alpha = np.full((w, n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            k = np.arange(max(0, j - longest), j)
            x = alpha[:, k] + logs[:, k, j - k - 1]
            top = x.max(1)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                alpha[:, j] = safe + np.log(np.exp(x - safe[:, None]).sum(1))
        return alpha, logs

    def _steps(self, word: bytes) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
        """For one long word: (end, starts, pieces) of the pieces that end at each byte, a stretch at a time."""
        text = np.frombuffer(MARK + word, np.uint8)
        sums = self._sums(text)

        def found():
            for a in range(1, len(text) + 1, 4096):
                ends = np.arange(a, min(len(text) + 1, a + 4096))
                starts = ends[:, None] - np.arange(1, self.longest + 1)
                inside = starts >= 0
                pieces = np.full(starts.shape, -1, np.int32)
                pieces[inside] = self._find(self._span(sums, starts[inside], np.broadcast_to(ends[:, None], starts.shape)[inside]))
                for e, s, p in zip(ends.tolist(), starts, pieces, strict=True):
                    yield e, s[p >= 0], p[p >= 0]

        return text, found()

    def _long_word(self, word: bytes) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        text, found = self._steps(word)
        alpha, steps = np.zeros(len(text) + 1), []
        for e, s, p in found:
            alpha[e] = np.logaddexp.reduce(alpha[s] + self.logp[p])
            steps.append((e, s, p))
        return alpha, steps

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        out = np.empty(len(words))
        for i, w in enumerate(words):
            if len(w) + len(MARK) > LONG:
                out[i] = self._long_word(w)[0][-1]
        for which, table in self.groups(words):
            out[which] = self._forward(table)[0][:, -1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used in words that occur so often."""
        total = np.zeros(len(self.logp))
        for word, n in zip(words, counts, strict=True):
            if len(word) + len(MARK) > LONG:
                alpha, steps = self._long_word(word)
                beta = np.full(len(alpha), -np.inf)
                beta[-1] = 0
                for e, s, p in reversed(steps):
                    x = self.logp[p] + beta[e]
                    np.add.at(total, p, n * np.exp(alpha[s] + x - alpha[-1]))
                    beta[s] = np.logaddexp(beta[s], x)
        for which, table in self.groups(words):
            alpha, logs = self._forward(table)
            w, n, longest = table.shape
            beta = np.full((w, n + 1), -np.inf)
            beta[:, n] = 0
            for i in range(n - 1, -1, -1):
                k = np.arange(1, min(longest, n - i) + 1)
                x = logs[:, i, k - 1] + beta[:, i + k]
                top = x.max(1)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    beta[:, i] = safe + np.log(np.exp(x - safe[:, None]).sum(1))
            for size in range(1, longest + 1):
                piece = table[:, : n - size + 1, size - 1]
                share = np.exp(alpha[:, : n - size + 1] + logs[:, : n - size + 1, size - 1] + beta[:, size:] - alpha[:, -1:])
                used = piece >= 0
                total += np.bincount(piece[used], (share * counts[which][:, None])[used], len(total))
        return total


def fold_of(doc_id, folds: int = 7):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times in training rows, times) of each slice, from (text, held_out)."""
    for batch in batches:
        held = batch.column(1).to_numpy(zero_copy_only=False)
        for w in words_of(batch.column(0)):
            _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            every = np.bincount(back, minlength=len(at))
            train = np.bincount(back, ~held[w.row], len(at)).astype(np.int64)
            raw = w.text.tobytes()
            words = [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(train), pa.array(every)], ["word", "train", "total"])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _expect(pieces, logp):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces.value, logp), np.zeros(len(logp))
        for batch in _parts(batches):
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "n"])

    return run


def _values(pieces, logp):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value, logp)
        for batch in _parts(batches):
            words = batch.column(0).to_pylist()
            h = lattice._hashes(b"".join(words), np.cumsum([0, *map(len, words)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column(1), batch.column(2), pa.array(lattice.log_probabilities(words) / LN10)], ["h", "train", "total", "logp"]
            )

    return run


def _score(head):
    """Sums over each row's frequent words, and the hashes of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, logp, seen = head.value
        key, made = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for w in words_of(batch.column(2)):
                at = np.minimum(np.searchsorted(known, w.hash), max(0, len(known) - 1))
                found = known[at] == w.hash if len(known) else np.zeros(len(w.hash), bool)
                row, at = (w.row - w.first_row)[found], at[found]
                add = lambda x: np.bincount(row, x[at], w.n_rows).astype(float)  # noqa: B023, E731 (of no rows, whole numbers)
                rest, rest_row = w.hash[~found].view(np.int64), (w.row - w.first_row)[~found]
                bounds = np.searchsorted(rest_row, np.arange(w.n_rows + 1))
                ids = batch.column(0).slice(w.first_row, w.n_rows)
                held = batch.column(1).slice(w.first_row, w.n_rows)
                arrays = [
                    pa.array(key + made + np.arange(w.n_rows)), ids, held, pa.array(w.counts().astype(np.int64)),
                    pa.array(add(seen).astype(np.int64)), pa.array(add(base)), pa.array(add(logp)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rest)),
                ]
                made += w.n_rows
                yield pa.RecordBatch.from_arrays(arrays, ["row_id", "doc_id", "held_out", "n_words", "n_known", "base", "logp", "rest"])

    return run


def likelihoods(docs: DataFrame, pieces_path: str, held_out: tuple[int, int] = (7, 2), head: int = HEAD, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts are one end token; repeated rows stay and count again in training; null ids train; without a training
    row the base is 0 for each token and the pieces keep their starting probabilities; an empty table gives an empty table;
    other columns are ignored. Words of any length are scored whole.
    """
    spark = docs.sparkSession
    held = (fold_of(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held, F.coalesce(docs["text"], F.lit("")).alias("text"))
    counted = texts.select("text", "held_out").mapInArrow(_count_words, "word binary, train long, total long").groupBy("word")
    vocabulary = written(counted.agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "lm-words")
    n_docs = texts.filter(~F.col("held_out")).count()
    sums = vocabulary.agg(F.sum("train"), F.sum((F.col("train") > 0).cast("long"))).first()
    n_tokens, distinct = (sums[0] or 0) + n_docs, (sums[1] or 0) + (n_docs > 0)

    names, logp = read_pieces(pieces_path)
    pieces = spark.sparkContext.broadcast(names)  # of fixed size: the file's vocabulary
    trained, first = vocabulary.filter("train > 0").select("word", "train"), np.exp(logp)
    for _ in range(rounds):
        used = trained.mapInArrow(_expect(pieces, logp), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(names))
        expected[[r.piece for r in used]] = [r.n for r in used]
        mass = expected + len(names) * first  # the starting probabilities weigh as much as one use of each piece
        total = mass.sum() + n_docs + 1
        logp = np.log(mass / total)
    end_logp = math.log10((n_docs + 1) / total)

    norm = math.log10(n_tokens + distinct + 1)
    base_of = lambda c: F.log10(c + F.lit(1.0)) - F.lit(norm)
    values = written(vocabulary.mapInArrow(_values(pieces, logp), "h long, train long, total long, logp double"), "lm-values")
    rows = at_least(values, "total", head).select("h", "train", "logp").toArrow()
    if rows.num_rows:
        h, train, log_p = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3))
        order = np.argsort(h.view(np.uint64))
        table = (h.view(np.uint64)[order], np.log10(train[order] + 1.0) - norm, log_p[order], (train[order] > 0).astype(float))
    else:
        table = (np.zeros(0, np.uint64), np.zeros(1), np.zeros(1), np.zeros(1))
    shape = "row_id long, doc_id long, held_out boolean, n_words long, n_known long, base double, logp double, rest array<long>"
    scored = written(texts.mapInArrow(_score(spark.sparkContext.broadcast(table)), shape), "lm-documents")

    rare = scored.select("row_id", F.explode("rest").alias("h")).join(values.select("h", "train", "logp"), "h")
    rest = rare.groupBy("row_id").agg(
        F.sum((F.col("train") > 0).cast("long")).alias("known_2"), F.sum(base_of(F.col("train"))).alias("base_2"), F.sum("logp").alias("logp_2")
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(rest, "row_id", "left").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (plus("n_known", "known_2") + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (plus("base", "base_2") + base_of(F.lit(float(n_docs)))).alias("base_score"),
        (plus("logp", "logp_2") + F.lit(end_logp)).alias("score"),
    )
