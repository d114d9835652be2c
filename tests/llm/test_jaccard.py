"""The size-aware join against all pairs by brute force."""

import random
import re

import pytest

from corpusloom.llm import jaccard_join as J

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORD.findall((text or "").encode().lower())
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    meet = {}
    for i, s in enumerate(sets):
        for x in s:
            meet.setdefault(x, []).append(i)
    for here in meet.values():
        for a in range(len(here)):
            for b in range(a):
                i, j = find(here[a]), find(here[b])
                if i != j:
                    p, q = sets[here[a]], sets[here[b]]
                    if 100 * len(p & q) >= percent * len(p | q):
                        root[i] = j
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str), [(d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(rows)]


def check(spark, rows, **how):
    k, percent = how.get("k", 4), how.get("percent", 85)
    df = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id long, text string, h string, class long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_groups(df, **how).collect()), key=str)
    assert got == sorted(brute(rows, k, percent)[1], key=str)


def near_copies(rng, n, base, edits, vocabulary):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("boundary", [None, 0, 8, 13])
def test_against_brute_force(spark, boundary):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (*range(1, 30), 60, 200):
        base = rng.choices(words, k=n)
        rows += near_copies(rng, 3, base, 1, words) + [" ".join(base), " ".join(base + ["x"]), "  " + " ".join(base).upper() + "\n"]
    rows += near_copies(rng, 60, rng.choices(words, k=120), 3, words)  # a long list of near copies
    passage = rng.choices(words, k=60)
    rows += [" ".join(passage + rng.choices(words, k=40)) for _ in range(40)]  # a passage of many documents
    rows += ["", None, " ", "a", "a", "A", "a b", "a b", "same four words here", "x " * 500, "x " * 480]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    check(spark, list(zip(ids, rows, strict=True)), **({} if boundary is None else {"boundary": boundary}))


def test_lists_that_the_first_pairs_leave_apart(spark, monkeypatch):
    """A chain of variants: most pairs with a list's first class fail, and blocks are small."""
    monkeypatch.setattr(J, "SMALL", 2)
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "COMMON", 3)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    base = rng.choices(words, k=90)
    rows, now = [], list(base)
    for i in range(40):
        now[(i * 7) % 90] = f"n{i}"
        rows.append((i, " ".join(now)))
    rows += [(100 + i, " ".join(rng.choices(words, k=10) + base[:70] + rng.choices(words, k=10))) for i in range(20)]
    check(spark, rows)
    check(spark, rows, k=5, percent=80)


def test_sets_that_share_a_name_are_named_anew(spark, monkeypatch):
    whole, rng = J._class_of, random.Random(2)
    monkeypatch.setattr(J, "_class_of", lambda bounds, h, salt=0: whole(bounds, h, salt) if salt != 1 else whole(bounds, h, salt) % 3)
    base = [f"v{i}" for i in range(40)]
    check(spark, [(i, " ".join(base[: 30 + i % 9] + rng.choices(base, k=i % 3))) for i in range(40)])


def test_awkward_tables(spark):
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u"), (9, None)])


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows, k=5, percent=80)


def test_keep_one(spark):
    text = " ".join(f"t{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "s"), (2, text + " x", "s"), (5, "other words only", "s"), (6, "", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == [2, 5, 6]


def test_overlap_rules():
    for a in range(1, 80):
        for b in range(a, 80):
            o = J.least_overlap(a, b)
            if o <= a:
                assert 100 * o >= 85 * (a + b - o) and 100 * (o - 1) < 85 * (a + b - o + 1)
                assert any(t == (a, J.least_overlap(a, a)) for t in J.light_tags(b))
                assert o > a - J.prefix_size(a) and o > b - J.prefix_size(b)


def test_bitmaps_never_overstate(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 130, 1000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        for m in (0, 1, n // 10, n // 2, n):
            b = np.concatenate([a[m:], rng.integers(0, 1 << 63, m + n // 8).astype(np.uint64)])
            x, y = J.parity_bits(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
            assert J.bits_apart(x, y) == J.bits_apart(y, x) <= len(set(a.tolist()) ^ set(b.tolist()))
