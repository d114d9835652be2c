"""Secrets in texts: fixed patterns, and formats inferred as probabilistic automata.

The fixed patterns label credentials. Their values, spelled in character classes, form a
prefix tree for each kind; tree states whose outgoing frequencies don't differ
significantly (Hoeffding's bound) are merged, which leaves a small probabilistic automaton
for each kind. Every other run of SHORTEST or more credential characters, and every part of one that a fixed pattern's match leaves over, is a
candidate: it becomes a span of kind `learned` when an automaton gives it a likelihood that the labelled
credentials themselves reach, well above that of the corpus's ordinary runs.

Counts of labelled values and of ordinary characters cover all texts; a prefix tree takes at
most SAMPLE distinct values (those with the smallest hashes) of at most CHARACTERS characters together, so fitting is bounded.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex", "learned")
#: Distinct labelled values that a kind's prefix tree is built from, and their characters together.
SAMPLE, CHARACTERS = 2000, 250_000
#: Least length of a candidate: that of the shortest labelled value. Least advantage in nats a value and a character over ordinary runs.
SHORTEST, ADVANTAGE, MARGIN = 8, 10.0, 0.5


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns' matches, sorted, and found as each pattern alone would find them."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in _RUN.finditer(text):  # matches of the other two of sufficient length lie inside such runs
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        if b - a >= 32:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential characters, less what base spans cover, of SHORTEST characters at least."""
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    if not base:
        return runs
    out, at, ends = [], 0, [(s, e) for s, _, e in base]
    for a, b in runs:
        while at < len(ends) and ends[at][1] <= a:
            at += 1
        for s, e in ends[at:]:
            if s >= b:
                break
            if s - a >= SHORTEST:
                out.append((a, s))
            a = max(a, e)
        if b - a >= SHORTEST:
            out.append((a, b))
    return out


#: Character classes of the automata: digits, hex letters, other letters; the rest stand for themselves.
_CLASS = {c: k for k, cs in (("0", "0123456789"), ("a", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEF"), ("Z", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs} | {c: c for c in "+/_.=-"}
_SIZE = Counter(_CLASS.values())


_SPELL = str.maketrans(_CLASS)


def spelled(value: str) -> str:
    return value.translate(_SPELL)


class Automaton:
    """A probabilistic automaton merged from the prefix tree of (string, count) pairs."""

    def __init__(self, strings: list[tuple[str, int]], alpha: float = 0.05):
        self.end: list[int] = [0]
        self.out: list[dict[str, list[int]]] = [{}]  # symbol: [count, state]
        for s, n in sorted(strings):
            state = 0
            for c in s:
                if c not in self.out[state]:
                    self.end.append(0)
                    self.out.append({})
                    self.out[state][c] = [0, len(self.end) - 1]
                edge = self.out[state][c]
                edge[0] += n
                state = edge[1]
            self.end[state] += n
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _total(self, s: int) -> int:
        return self.end[s] + sum(n for n, _ in self.out[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether no frequency differs by more than Hoeffding's bound, here and in all common continuations."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            m, n = self._total(p), self._total(q)
            if not m or not n:
                continue
            most = self.width * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.end[p] / m - self.end[q] / n) > most:
                return False
            for c in self.out[p].keys() | self.out[q].keys():
                x, y = self.out[p].get(c), self.out[q].get(c)
                if abs((x[0] if x else 0) / m - (y[0] if y else 0) / n) > most:
                    return False
                if x and y:
                    todo.append((x[1], y[1]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to the states from a on."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.end[p] += self.end[q]
            for c, (n, t) in self.out[q].items():
                if c in self.out[p]:
                    self.out[p][c][0] += n
                    todo.append((self.out[p][c][1], t))
                else:
                    self.out[p][c] = [n, t]

    def _merge_states(self) -> None:
        kept, fringe = [0], deque(self.out[0].values())
        while fringe:
            edge = fringe.popleft()
            if edge[1] in kept:
                continue
            same = next((s for s in kept if self._alike(s, edge[1])), None)
            if same is None:
                kept.append(edge[1])
                fringe.extend(self.out[edge[1]].values())
            else:
                new, edge[1] = edge[1], same
                self._fold(same, new)
                fringe.extend(e for s in kept for e in self.out[s].values() if e[1] not in kept and e not in fringe)
        self.states = kept

    def likelihood(self, s: str) -> float:
        """Log-probability of a spelled string of characters, each class's probability shared among its characters.

        Every state lends half a count to all symbols and the end alike; an unseen step leads to a state where they are
        equally likely, so the probabilities of all strings add up to 1.
        """
        state, total, even = 0, 0.0, 1 / (len(_SIZE) + 1)
        for c in s:
            edge = self.out[state].get(c) if state >= 0 else None
            if state < 0:
                total += math.log(even)
            else:
                total += math.log(((edge[0] if edge else 0) + 0.5 * even) / (self._total(state) + 0.5))
            total -= math.log(_SIZE[c])
            state = edge[1] if edge else -1
        return total + math.log(even if state < 0 else (self.end[state] + 0.5 * even) / (self._total(state) + 0.5))


class Ordinary:
    """What runs usually look like: the class of a character given the one before, and the character given its class. \n begins and ends a run."""

    def __init__(self, counts: dict[str, int]):
        """counts: of characters, and of pairs of classes that follow each other."""
        self.char = {}
        for c, k in _CLASS.items():
            total = sum(counts.get(x, 0) + 1 for x, y in _CLASS.items() if y == k)
            self.char[c] = math.log((counts.get(c, 0) + 1) / total)
        kinds = [*_SIZE, "\n"]
        self.step = {}
        for a in kinds:
            total = sum(counts.get(a + b, 0) + 1 for b in kinds)
            self.step |= {a + b: math.log((counts.get(a + b, 0) + 1) / total) for b in kinds}

    def likelihood(self, value: str, s: str) -> float:
        path = "\n" + s + "\n"
        return sum(map(self.char.__getitem__, value)) + sum(map(self.step.__getitem__, map(str.__add__, path, path[1:])))


class Formats:
    """The automata of all kinds, the likelihood a character that nearly all labelled values reach, and the ordinary runs' model."""

    def __init__(self, labelled: dict[str, list[tuple[str, int]]], ordinary: dict[str, int]):
        self.ordinary, self.kinds = Ordinary(ordinary), []
        for kind in sorted(labelled):
            strings = Counter()
            for value, n in labelled[kind]:
                strings[spelled(value)] += n
            automaton = Automaton(list(strings.items()))
            reached = sorted(automaton.likelihood(s) / (len(s) + 1) for s in strings)
            self.kinds.append((automaton, reached[len(reached) // 50]))

    def accepts(self, value: str) -> bool:
        s, n = spelled(value), len(value) + 1
        reached = [x for a, least in self.kinds if (x := a.likelihood(s)) >= least * n]
        return bool(reached) and max(reached) - self.ordinary.likelihood(value, s) >= max(ADVANTAGE, MARGIN * n)


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled values by kind; and of other runs (kind '') the characters, and the pairs of classes that follow each other; with counts."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for s, kind, e in base:
                seen[KINDS[kind], _ASSIGN.match(text, s)[2] if kind == 0 else text[s:e]] += 1
            runs = "\n".join([text[s:e] for s, e in candidates(text, base)])
            path = "\n" + spelled(runs) + "\n"
            for c, n in (Counter(runs) + Counter(map(str.__add__, path, path[1:])) if runs else Counter()).items():
                if c != "\n":
                    seen["", c] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "value", "n"]
        )


def learn_formats(texts: DataFrame) -> Formats:
    """Formats of the credentials in one text column.

    Of each kind's distinct values those with the lowest hashes are picked, in whole; one that is longer than what is left of CHARACTERS is passed over, and the next are picked. A bound on the hash that the kinds' sizes give leaves about
    twice as many as wanted, so no task orders more than that.
    """
    counts = texts.mapInArrow(_count_values, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("h", F.pmod(F.xxhash64("value"), F.lit(1 << 31))), "secret-values")
    labelled: dict[str, list[tuple[str, int]]] = {}
    sizes = counts.filter("kind <> ''").groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()  # of three kinds
    for kind, n in sizes:
        of_kind = counts.filter((F.col("kind") == kind) & (F.col("h") < (1 << 31) * min(1.0, 2 * SAMPLE / n) + 1))
        of_kind = of_kind.withColumn("g", F.xxhash64("value", F.lit(1)))
        left, chosen = CHARACTERS, []
        for r in of_kind.select("h", "g", F.length("value").alias("n")).orderBy("h", "g").limit(SAMPLE).collect():
            if r.n <= left:  # a value that doesn't fit is left out alone
                left -= r.n
                chosen.append((r.h, r.g))
        if chosen:
            few = counts.sparkSession.createDataFrame(chosen, "h long, g long")  # at most SAMPLE
            labelled[kind] = sorted((r.value, r.n) for r in of_kind.join(F.broadcast(few), ["h", "g"]).select("value", "n").collect())
    return Formats(labelled, {r.value: r.n for r in counts.filter("kind = ''").select("value", "n").collect()})  # as many as characters and pairs of classes


def _scan(formats: Formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = lru_cache(1 << 16)(formats.accepts)  # words repeat
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                extra = [(s, 3, e) for s, e in candidates(text, base) if accepts(text[s:e])]
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                n = Counter(k for _, k, _ in base)
                every = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + extra)) if extra else joined
                for column, value in zip(columns, (n[0], n[1], n[2], len(extra), hashlib.sha256(joined.encode()).hexdigest(), every), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans"])

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans) of every row.

    Null and empty texts have no spans (the digest is that of an empty string); repeated rows and null ids stay;
    an empty table gives an empty table; without any labelled value nothing is learned; whole texts are read, however long;
    other columns are ignored. Offsets are code points, ends exclusive.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    formats = learn_formats(texts.select("text"))
    return texts.mapInArrow(_scan(formats), "doc_id long, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string")
