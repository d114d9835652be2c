"""Source mixing, likelihood, toxicity, secrets, url rules, decontamination and vectors against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from corpusloom.llm import decontaminate as D
from corpusloom.llm import lm_score as L
from corpusloom.llm import mixing as M
from corpusloom.llm import secrets as S
from corpusloom.llm import toxicity as T
from corpusloom.llm import url_rules as U
from corpusloom.llm import vector_graph as V
from corpusloom.llm.components import components

DOCS = "doc_id long, text string, source string, word string, h long"


def docs(spark, texts, sources=None, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, s, "w", 1) for i, t, s in zip(ids, texts, sources or ["s"] * len(texts), strict=True)], DOCS)


def same(spark_df, sql_df):
    a, b = spark_df.toPandas(), sql_df
    assert sorted(a.columns) == sorted(b.columns)
    a, b = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_mix_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    same(M.mix_report(spark.read.parquet(f"{sf}/documents.parquet")), con.execute(M.MIX_SQL).df())


def test_mix_equals_sql_on_skewed_sources(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randrange(0, 40)) for _ in range(900)] + ["", None]
    sources = [rng.choice(["big"] * 30 + ["mid"] * 4 + ["small"]) for _ in range(900)] + ["none", None]
    df = docs(spark, texts, sources)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = M.mix_report(df)
    same(got, con.execute(M.MIX_SQL).df())
    shares = got.groupBy("source").sum("n_tokens").collect()
    for r in shares:
        weight = got.filter(f"source = '{r.source}'").first().weight
        assert r[1] <= weight * sum(len((t or "").split()) for t in texts)
    assert M.mix_report(docs(spark, [])).count() == 0


def test_mix_draws_all_within_the_repetition_limit(spark):
    texts = ["a b c"] * 100 + ["d e"] * 10 + ["", None]
    out = M.mixed(docs(spark, texts, ["x"] * 100 + ["y"] * 10 + ["none", None]), entropy=1.0, repetition=1.5, budget=None)
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == set(range(112)) and all(n[i] == 1 for i in [*range(100), 110, 111])
    assert sum(n[i] for i in range(100, 110)) in (14, 15)
    assert out.columns == ["doc_id", "text", "source", "word", "h"]


def slow_log_probability(word, pieces):
    raw = L.MARK + word
    alpha = [0.0] + [-math.inf] * len(raw)
    for j in range(1, len(raw) + 1):
        xs = [alpha[i] + pieces[raw[i:j]] for i in range(j) if raw[i:j] in pieces]
        alpha[j] = np.logaddexp.reduce(xs) if xs else -math.inf
    return alpha[-1]


def test_lattice_recursion(monkeypatch):
    names, logp = L.read_pieces(P.path("piece_bpe_32k.model"))
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    table, lattice = dict(zip(names, logp, strict=True)), L.Lattice(names, logp)
    words = [b"the", b"thetherion", "éçole".encode(), b"a", b"\xff", "日本".encode(), b"x" * 300]
    want = [slow_log_probability(w, table) for w in words]
    assert np.allclose(lattice.log_probabilities(words), want)
    counts = np.array([3.0, 1, 2, 5, 1, 1, 2])
    expected = lattice.expected(words, counts)
    eps = 1e-6  # an expected count is the derivative of the log-likelihood by the piece's log-probability
    for piece in (b"the", b"e", b"th", b"x"):
        k = names.index(piece)
        moved = logp.copy()
        moved[k] += eps
        slope = (counts * (L.Lattice(names, moved).log_probabilities(words) - want)).sum() / eps
        assert abs(slope - expected[k]) < 1e-3
    monkeypatch.setattr(L, "LONG", 8)  # the way of long words gives the same
    assert np.allclose(lattice.log_probabilities(words), want)
    assert np.allclose(lattice.expected(words, counts), expected)


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 30)
    rng = random.Random(3)
    words = [f"W{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(120)] + [None, "", "  New\tword x ", "long" * 200]
    df = docs(spark, texts)
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = pd.Series([w for t, h in zip(tokens, held, strict=True) if not h for w in t], dtype=object).value_counts(dropna=False)
    counts = {(None if w is None or w != w else w): int(c) for w, c in counts.items()}
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in L.likelihoods(df, P.path("piece_bpe_32k.model"), head=30).collect()}
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts.get(w, 0) > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert r.score < 0
    assert L.likelihoods(docs(spark, []), P.path("piece_bpe_32k.model")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxicity_scores(d, lab).join(lab, "doc_id").filter("held_out").select("score", "predicted", "toxic").toPandas()
    y, s = got.toxic.to_numpy() == 1, got.score.to_numpy()
    auc = (s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean()
    assert auc > 0.9  # 18 toxic rows held out, 40 learned from
    assert (got.predicted[~y] == 1).mean() < 0.02


def test_machine_learns_a_pair():
    """Terms 1 and 2 are toxic together only."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(40) < 0.15) for _ in range(4000)]
    for r in range(4000):
        rows[r] = np.unique(np.concatenate([rows[r][rows[r] > 2], *([[1]] if rng.random() < 0.4 else []), *([[2]] if rng.random() < 0.4 else [])])).astype(np.int64)
    y = np.array([float(1 in r and 2 in r) for r in rows])
    m = T.fit_machine(y, rows, epochs=25)
    score = lambda *t: m.margins(1, np.zeros(len(t), int), m.pick[list(t)])[0]
    assert score(1, 2) > 0 > max(score(1), score(2))


@pytest.mark.parametrize("words, noise", [(2, 0.0), (30, 0.05)])
def test_toxicity_that_only_a_pair_tells(spark, words, noise):
    """Toxic is exactly one of two words: neither tells anything alone."""
    rng = random.Random(11)
    rows, known = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(" ".join(["alpha"] * a + ["omega"] * b + [f"filler{rng.randrange(400)}" for _ in range(words)]))
        known.append((i, 1, int((a != b) != (rng.random() < noise))))
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(docs(spark, rows), labels).filter("held_out").join(labels, "doc_id").toPandas()
    y, s = got.toxic.to_numpy() == 1, got.score.to_numpy()
    auc = (s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean()
    assert auc > 0.95 - noise


def test_terms_that_the_driver_takes_are_bounded(spark, monkeypatch):
    """Only as many rows of lowest hashes as fit within the bound are learned from, whatever their length."""
    taken = []
    monkeypatch.setattr(T, "fit_machine", lambda y, terms: taken.append(sum(map(len, terms))) or T.Machine(np.full(T.BUCKETS, -1), 0.0, np.zeros(1), np.zeros((1, 1))))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(90)], "doc_id long, quality int, toxic int")
    texts = docs(spark, [" ".join(f"u{i}x{j}" for j in range(50)) for i in range(90)])
    T.learn_toxicity(texts, labels, most_terms=700)
    T.learn_toxicity(texts, labels)
    assert 600 <= taken[0] <= 700 and taken[1] > 2000


def test_toxicity_of_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    texts = docs(spark, ["", None, "x" * 100_000, "a b"], ids=[1, None, 3, 3])
    got = T.toxicity_scores(texts, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity_scores(docs(spark, []), labels).count() == 0
    none = T.toxicity_scores(texts, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert T.drop_toxic(texts, labels.limit(0)).columns == texts.columns


def slow_spans(text):
    n = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in n.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


SECRETS = ["", None, "password=abc", 'x PassWord" : "abcdefgh1', "tokentoken=12345678 secret:=a", "AKIA" * 5 + " xAKIAABCDEFGHIJKL", "ab" * 40 + "g" + "0" * 31, "é token = '0123456789abcdef0123456789abcdef0' ü", "api_key=--------", "apikey:zzzzzzzzz,password=yyyyyyyyyy"]


def test_base_spans_are_the_patterns(spark):
    rng = random.Random(2)
    texts = SECRETS + ["".join(rng.choices(["password", "=", '"', " ", "token", ":", "AKIA", "0f9a", "ABCDEF12", "é", "z", "-", "secret", "f" * 16], k=25)) for _ in range(2000)]
    for t in texts:
        assert S.base_spans(t or "") == slow_spans(t or "")
    rows = {r.doc_id: r for r in S.secret_spans(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = slow_spans(t or "")
        said = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert S.secret_spans(docs(spark, [])).count() == 0


def test_learned_formats_find_unlabelled_credentials(spark):
    rng = random.Random(4)
    new = lambda: "sk_live_" + "".join(rng.choices("0123456789abcdef", k=24))
    bare = new()
    texts = [f"here token = {new()} now" for _ in range(60)] + [f"and {bare} alone", "thisisaverylongordinaryword and-some-others-like-it-2024 " * 3]
    got = {r.doc_id: r.spans for r in S.secret_spans(docs(spark, texts)).collect()}
    assert got[60] == "learned:4:36" and got[61] == ""


def test_short_candidates_and_parts_of_runs(spark):
    """A bare value of the length of the shortest labelled ones, and what a fixed pattern leaves of a run, are scored like others."""
    rng = random.Random(9)
    new = lambda: "".join(rng.choices("QXZJK", k=4)) + "".join(rng.choices("0123456789", k=8))
    bare = new()
    texts = [f"here token = {new()} now some ordinary words follow" for _ in range(300)] + [f"and {bare} alone, extraordinary words of documentation", f"{'ab' * 16}{new()}"]
    got = {r.doc_id: r.spans for r in S.secret_spans(docs(spark, texts)).collect()}
    assert got[300] == "learned:4:16" and got[301] == "hex:0:32,learned:32:44"


def test_automaton_is_a_distribution():
    """The probabilities of all strings of at most some symbols come near to 1, and never exceed it."""
    a = S.Automaton([("0a", 30), ("0aa", 10), ("z", 5)])
    kinds = list(S._SIZE)
    strings, total = [""], 0.0
    for _ in range(6):
        total += sum(math.exp(a.likelihood(s) + sum(math.log(S._SIZE[c]) for c in s)) for s in strings)
        strings = [s + c for s in strings for c in kinds] if len(strings) < 20_000 else []
    assert 0.95 < total < 1 + 1e-9


def test_picked_values_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 20)
    monkeypatch.setattr(S, "CHARACTERS", 300)
    seen = []
    monkeypatch.setattr(S, "Formats", lambda labelled, ordinary: seen.append((labelled, ordinary)))
    S.learn_formats(docs(spark, [f"token = abcdefgh{i:012d} word" for i in range(500)]).select("text"))
    (labelled, ordinary), = seen
    assert list(labelled) == ["assign"] and len(labelled["assign"]) == 15 and all(n == 1 for _, n in labelled["assign"])


def repeat_runs(a, b, tile):
    return sum(a[i : i + tile] == b[j : j + tile] for i in range(len(a) - tile + 1) for j in range(len(b) - tile + 1))


def test_repetitive_texts_are_tiled_in_parts(spark, monkeypatch):
    """Few pairs are held at once; results don't change."""
    rng = random.Random(3)
    items = [rng.choices("ab", k=20), ["a"] * 15]
    texts = [rng.choices("ab", k=60), ["a"] * 200, ["a", "b"] * 50]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    find = lambda: sorted(map(tuple, D.contaminated(docs(spark, [" ".join(t) for t in texts]), bench, tile=3, coverage=0.1).collect()))
    index = D.ItemIndex([0, 1], [" ".join(t) for t in items], 3)
    whole = find()
    monkeypatch.setattr(D, "PAIRS", 7)
    (w,) = D.words_of(D.pa.array([" ".join(t) for t in texts]), D.PUNCTUATION)
    assert {(r, i): int(n.sum()) for r, i, _, _, n in index.runs(w)} == {(r, i): n for r, t in enumerate(texts) for i, b in enumerate(items) if (n := repeat_runs(t, b, 3))}
    for r, i, shift, place, n in index.runs(w):
        got = D.tiles(shift, place, n, 3, len(items[i]))
        assert got == slow_tiling(texts[r], items[i], 3)
    assert whole and {(d, i) for d, i, *_ in whole} >= {(1, 1)}

def test_automaton_merges_states():
    strings = [("".join("ab"[(i >> k) & 1] for k in range(n)), 1) for n in range(2, 7) for i in range(1 << n)]
    a = S.Automaton(strings)
    assert len(a.states) <= 8 < sum(2**n for n in range(7))


def test_url_parts_and_fixed_rules(spark):
    urls = ["http://Example.ORG/es/a?x", "https://a.example.org/en/12#t", "ftp://notexample.org/es/", "http://x.com/fr/y", "x.com/de/", None, "", "http://x.com/de/?q=://", "http://host", "http://org?x/y", "HTTP://a.COM:80/de/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(rows, labels).collect()}
    assert got == {
        0: ("example.org", "/es/a", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("notexample.org", "/es/", "org/", "allow"),
        3: ("x.com", "/fr/y", "com/fr/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("x.com", "/de/", "com/de/", "block"),
        8: ("host", "", None, "allow"), 9: ("org", "", None, "allow"), 10: ("a.com:80", "/de/", None, "allow"),
    }


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    urls, bad = [], []
    for _ in range(600):
        parts = [p for p in ("casino", "bonus", "news", "shop", "blog") if rng.random() < 0.4]
        urls.append("http://site.net/" + "/".join([*parts, str(rng.randrange(9))]))
        bad.append(("casino" in parts and "bonus" in parts) if rng.random() < 0.95 else rng.random() < 0.5)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    sets = [set(re.findall("[a-z]+", u)) | {"#1"} for u in urls]
    tokens = sorted({t for s in sets for t in s if sum(t in x for x in sets) <= 0.9 * len(sets)})
    rules = {}
    for m in range(1, 1 << len(tokens)):
        t = frozenset(x for k, x in enumerate(tokens) if m >> k & 1)
        has = [b for s, b in zip(sets, bad, strict=True) if t <= s]
        for verdict, hits, share in (("block", sum(has), sum(bad)), ("allow", len(has) - sum(has), len(bad) - sum(bad))):
            if hits >= 25 and hits / len(has) >= 0.7 and hits / len(has) / (share / len(bad)) >= 1.2:
                rules[t, verdict] = (hits / len(has), hits / len(bad))
    kept = {k: v for k, v in rules.items() if not any(o < k[0] and ov == k[1] and rules[o, ov][0] >= v[0] for o, ov in rules)}
    assert kept

    def judge(s):
        best = max(((c, p, len(t), " ".join([*sorted(t), v]), v) for (t, v), (c, p) in kept.items() if t <= s), default=None)
        return best[4] if best else "allow"

    got = {r.page_id: r.verdict for r in U.judge_urls(pages, labels).collect()}
    assert got == {i: judge(s) for i, s in enumerate(sets)}
    assert "block" in got.values()


def test_tokens_that_always_come_together_are_one_item(spark):
    """A url of forty tokens with a third of the rows."""
    long = "http://hot.net/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    urls = [long] * 100 + [f"http://cold.net/{'spam' if i % 2 else 'fine'}/x" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 100 or i % 2)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.matched) for r in U.judge_urls(pages, labels).collect()}
    assert {got[i][0] for i in range(100)} == {"block"} and got[0][1].count(" ") >= 40
    assert [got[100][0], got[101][0]] == ["allow", "block"]


def slow_tiling(a, b, tile):
    """Greedy string tiling by its definition."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for q in range(len(b)):
            for p in range(len(a)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and p + n not in used_a and q + n not in used_b:
                    n += 1
                if n >= tile and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        p, q, n = best
        out.append(best)
        used_a.update(range(p, p + n))
        used_b.update(range(q, q + n))


def test_tiles_equal_the_definition(spark):
    rng = random.Random(8)
    letters = "abcdefgh"
    items, texts = [], []
    for _ in range(12):
        items.append([rng.choice(letters) + rng.choice(letters) for _ in range(rng.randrange(3, 30))])
    for _ in range(60):
        w = []
        for _ in range(4):
            item = rng.choice(items)
            cut = rng.randrange(len(item))
            w += item[cut:] + item[:cut] if rng.random() < 0.6 else rng.choices(letters, k=8)
        texts.append(w)
    bench = spark.createDataFrame([(i, " ".join(t).title() + ".") for i, t in enumerate(items)] + [(90, None), (91, ""), (None, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.item_words, r.n_tiles, r.longest) for r in D.contaminated(docs(spark, [", ".join(t) for t in texts] + ["", None]), bench, tile=3).collect()}
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(items):
            cut = slow_tiling(a, b, 3)
            covered = sum(n for _, _, n in cut)
            if cut and covered >= 0.5 * len(b):
                want[i, j] = (covered, len(b), len(cut), max(n for _, _, n in cut))
    assert got == want and want
    dirty = {i for i, _ in want}
    kept = D.decontaminate(docs(spark, [", ".join(t) for t in texts]), bench, tile=3)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if i not in dirty]
    assert D.contaminated(docs(spark, []), bench).count() == 0 and D.contaminated(docs(spark, ["a b"]), bench.limit(0)).count() == 0


def test_passes_cover_all_items(spark, monkeypatch):
    """Blocks are sized by counted words; more than one pass finds what one finds."""
    bench = spark.createDataFrame([(i, ", ".join(f"i{i}w{j}é" for j in range(20))) for i in range(50)] + [(50, ""), (51, "..."), (52, None)], "item_id long, text string")
    texts = docs(spark, [" ".join(f"i{i}w{j}É".lower() for j in range(3, 20)) for i in range(0, 50, 3)] + ["clean"])
    one = [p.value[1] for p in D.passes(bench)]
    assert [len(p) for p in one] == [1] and sorted(one[0][0][0]) == list(range(50))
    many = [p.value[1] for p in D.passes(bench, 200, 2)]
    assert [len(p) for p in many] == [2, 2, 1] and sorted(i for p in many for ids, _ in p for i in ids) == list(range(50))
    found, kept = sorted(map(tuple, D.contaminated(texts, bench).collect())), D.decontaminate(texts, bench).collect()
    assert len(found) == 17 and [r.text for r in kept] == ["clean"]
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, D.contaminated(texts, bench).collect())) == found and D.decontaminate(texts, bench).collect() == kept


def brute_vectors(rows, threshold):
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) for _, v, lab in rows]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                link[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    return [(rows[i][0], int(link[i].sum()), min(rows[j][0] for j in range(n) if comp[j] == comp[i])) for i in range(n)]


def test_vectors_against_brute_force(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("LARGE", 100), ("BLOCK", 50)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((base + rng.normal(size=16) * 0.08, c % 2))
    rows += [(rows[0][0] + rng.normal(size=16) * 0.02, 0) for _ in range(90)] + [(rows[3][0] * s, rows[3][1]) for s in (1.0, 1.0, 2.0, 1e-3)]
    table = [(i, [float(x) for x in np.float32(v)], int(lab)) for i, (v, lab) in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0] * 16, None), (n + 3, [float("nan")] + [1.0] * 15, 1), (n + 4, [None] + [1.0] * 15, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1), (n + 7, table[5][1], table[5][2])]
    df = spark.createDataFrame([(*t, "k") for t in table], "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: r for r in V.vector_groups(df).collect()}
    want = brute_vectors(table, 0.98)
    assert sum(got[i].n_links for i, _, _ in want) >= 0.99 * sum(k for _, k, _ in want)
    assert all(got[i].n_links <= k for i, k, _ in want)
    assert np.mean([got[i].component_id == c for i, _, c in want]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and got[0].audit_recall >= 0.95
    assert V.vector_groups(df.limit(0)).count() == 0


def test_a_dense_group_is_not_dealt_again_and_again(spark, monkeypatch):
    """Near copies of one vector, half of the rows: shards hold few rows more than there are nodes."""
    for name, value in (("SHARD", 40), ("LARGE", 80), ("BLOCK", 60)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=24)
    x = np.concatenate([hot + rng.normal(size=(300, 24)) * 0.01, rng.normal(size=(300, 24))])
    nodes = spark.createDataFrame([(i, 1, 24, v.tobytes()) for i, v in enumerate(x)], "node long, label long, dim int, vec binary")
    dealt = V.shards(nodes, float(np.radians(4))).select("node", "cell", "n").toPandas()
    assert set(dealt.node) == set(range(600)) and len(dealt) < 1200 and dealt[dealt.node >= 300].n.mean() < 400
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in V.vector_groups(df).collect()}
    assert all((got[i].n_links, got[i].component_id) == (299, 0) for i in range(300)) and got[300].audit_recall == 1.0


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()], 0.98)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in V.vector_groups(df).collect()) == sorted(want)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 3), (3, 5), (9, 8), (8, 3), (None, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}
    for u, v in edges:
        if u is not None and v is not None and u != v:
            root.setdefault(u, u), root.setdefault(v, v)
    for _ in root:
        for u, v in edges:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    assert got == root
