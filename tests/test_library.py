"""Functions, readers, sinks, contacts, samplers and streams on small cases with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.porter import stem
from corpusloom.operators import contacts as K
from corpusloom.operators import corpus as C
from corpusloom.operators import entities as E
from corpusloom.operators import samplers as S
from corpusloom.operators import social as O
from corpusloom.operators import topics as M
from corpusloom.operators.ids import with_dense_id
from corpusloom.sources import html as H
from corpusloom.sources import readers as R
from corpusloom.sources import sinks as W
from corpusloom.sources.store import Store
from corpusloom.streaming import events as ST


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, value if hasattr(value, "_jc") else F.lit(value))
    return row.select(column.alias("x")).first().x


c = F.col


@pytest.mark.parametrize("text, want", [("SEOUL - Talks began", " Talks began"), ("A long sentence of more than thirty - chars", None), ("-x", "-x"), ("", "")])
def test_dateline(spark, text, want):
    assert one(spark, T.strip_dateline(c("t")), t=text) == (text if want is None else want)


@pytest.mark.parametrize("long, short, want", [("Trung Nguyen Van", "Trung Nguyen", True), ("Trung Nguyen Van", "Trung Van", True), ("Trung Nguyen Van", "trung", False), ("Trung Nguyenson", "Nguyen", True), ("Hanoi", "Hanoi", False)])
def test_encloses(spark, long, short, want):
    assert one(spark, T.encloses(c("a"), c("b")), a=long, b=short) is want
    assert E._encloses(long, short) is want


@pytest.mark.parametrize("name, want", [("kim", "K"), ("김", "ㄱ"), ("7up", "#"), ("", "#"), ("힣", "#"), ("éa", "#"), ("하늘", "#"), ("사과", "ㅅ")])
def test_sections(spark, name, want):
    assert one(spark, T.name_section(c("n")), n=name) == want


@pytest.mark.parametrize("name, want", [("ßheit", "#"), ("ﬀ", "#"), ("ŉ", "#"), ("s", "S")])
def test_a_section_is_one_letter(spark, name, want):
    assert one(spark, T.name_section(c("n")), n=name) == want


def test_scalar_functions(spark):
    assert one(spark, T.phone(c("p")), p="010-0000-0000") == "01000000000"
    assert one(spark, T.star_list(c("p")), p="[dominos*pizza*]") == ["dominos", "pizza"]
    assert one(spark, T.to_star_list(F.array(F.lit("a"), F.lit("b")))) == "[a*b*]"
    assert one(spark, T.friend_weight(F.lit(500.0), F.lit(100))) == 1.0
    assert one(spark, T.join_parts(" ", c("a"), c("b"), c("d")), a="x", b="", d="y") == "x y"
    assert one(spark, T.pair_map(c("p")), p="a,1,b,2,a,3") == {"b": 2, "a": 3}
    assert one(spark, T.pair_map(c("p")), p="") == {}
    assert one(spark, T.map_pairs(T.increment(T.pair_map(c("p")), "b")), p="a,1,b,2") == "a,1,b,3"
    assert one(spark, T.map_pairs(T.increment(T.pair_map(c("p")), "z")), p="a,1") == "a,1,z,1"
    assert one(spark, T.is_permutation(F.array(*map(F.lit, (2, 0, 1))))) is True
    assert one(spark, T.is_permutation(F.array(*map(F.lit, (2, 0, 2))))) is False
    assert one(spark, T.expanded(F.array(F.lit(5), F.lit(7)), F.array(F.lit(2), F.lit(1)))) == [5, 5, 7]
    assert one(spark, T.same_elements(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1)))) is True
    assert one(spark, T.percent_of(30, F.lit(999))) == 299
    assert one(spark, T.with_scheme(F.lit("a.b"))) == "http://a.b" and one(spark, T.with_scheme(F.lit("https://a"))) == "https://a"
    assert one(spark, T.clean_text(F.lit("a<!-- x -->&#8217;s \n b"))) == "a's b"
    assert one(spark, T.before_marker(F.lit("abc Introduction INTRODUCTION"), "INTRODUCTION", "Introduction")) == "abc Introduction "
    assert one(spark, T.z_score(F.lit(12.0), F.lit(100.0), F.lit(50.0), F.lit(1000.0))) == pytest.approx((12 - 5) / math.sqrt(100 * 0.05 * 0.95))
    assert one(spark, F.date_format(T.from_millis(F.lit("0")), T.LOG_TIME)) == "19700101000000+0000"
    assert one(spark, T.xml_element("a", F.lit("x<&"))) == "<a>x&lt;&amp;</a>" and one(spark, T.xml_element("a", F.lit(None))) == "<a></a>"


def test_questions(spark):
    got = one(spark, T.questions(c("t")), t="1. a 2. b 8. c 9. d 28. e 38. f")
    assert [tuple(q) for q in got] == [(1, "completion", "1. a "), (2, "completion", "2. b "), (8, "analogy", "8. c "), (9, "analogy", "9. d "), (28, "antonym", "28. e "), (38, "antonym", "38. f")]
    assert one(spark, T.url_parameter("q", F.lit("a b&c"))) == "q=a+b%26c"


@pytest.mark.parametrize("u, want", [(0.45, 1), (0.449, 0), (0.65, 2), (0.0, 0), (0.999, 2)])
def test_draw(spark, u, want):
    p = F.array(F.lit(0.45), F.lit(0.2), F.lit(0.35))
    assert one(spark, T.draw_index(p, F.lit(u))) == want == S.draw(np.array([0.45, 0.2, 0.35]), u)


def test_draws_have_their_frequencies():
    rng, p = np.random.default_rng(0), np.array([0.45, 0.2, 0.35])
    got = np.bincount([S.draw(p, u) for u in rng.random(4000)], minlength=3) / 4000
    assert abs(got - p).max() < 0.03


#: Words and stems from the published description of the algorithm.
STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()


def test_porter_stems():
    assert [(w, stem(w)) for w in STEMS[::2]] == list(zip(STEMS[::2], STEMS[1::2], strict=True))


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("url\nhead\ndate\nSEOUL - One.\nTwo.\n")
    (tmp_path / "b.txt").write_text("")
    assert {r.name: r.text for r in R.read_documents(spark, str(tmp_path), "news").collect()}["a.txt"] == " One."
    assert {r.name: r.text for r in R.read_documents(spark, str(tmp_path), "titled").collect()} == {"a.txt": "head"}
    assert {r.name: r.text for r in R.read_documents(spark, str(tmp_path)).collect()}["a.txt"] == "url head date SEOUL - One. Two."
    assert R.lines(spark, str(tmp_path), lower=True, unique=True).count() == 5  # the empty file has no line
    body = "x" * 200
    sgml = spark.createDataFrame([(1, f"<TITLE>Ab</TITLE><BODY>{body}\nReuter zz</BODY><TITLE>C</TITLE><BODY>short</BODY>")], "id long, text string")
    assert [(r.ord, r.title, r.body) for r in R.split_sgml(sgml, "id").collect()] == [(0, "ab", body + "\n")]
    seeds = spark.createDataFrame([(1, "pizza\n4\ndominos,2,\nfood\n1\n\nrest")], "id long, text string")
    assert [(r.tag, r.freq, r.cooccur) for r in R.tag_seeds(seeds, "id").collect()] == [("pizza", 4, {"dominos": 2}), ("food", 1, {})]
    assert [(r.tag, r.related) for r in R.tag_map(spark.createDataFrame([(1, "a\nb,1,c,2,")], "id long, text string"), "id").collect()] == [("a", {"b": 1, "c": 2})]
    xml = "<r><address_component><type>country</type><short_name>KR</short_name></address_component><address_component><type>locality</type><long_name>Daejeon</long_name></address_component></r>"
    assert R.place(spark.createDataFrame([(xml,), ("<r/>",)], "xml string")).select("place").collect() == [("KR:Daejeon",), (None,)]
    results = "<results><result><name>A</name><phone>1</phone><email>e</email><labels>l</labels><person>p</person><person>q</person></result><result><name>B</name></result></results>"
    assert [(r.ord, r.name, r.people) for r in R.search_results(spark.createDataFrame([(1, results)], "id long, xml string"), "id").collect()] == [(0, "A", ["p", "q"]), (1, "B", [])]
    new, mark = R.incremental(spark.createDataFrame([(1,), (5,), (9,)], "at long"), "at", 4)
    assert (sorted(r.at for r in new.collect()), mark) == ([5, 9], 9)
    (tmp_path / "runs.csv").write_text("# comment\n1, 2\n3,4\n")
    assert S.read_configurations(spark, str(tmp_path / "runs.csv"), ["a", "b"]).collect() == [(1.0, 2.0), (3.0, 4.0)]


def test_html_nodes(spark):
    page = spark.createDataFrame([(1, '<div class="x"><p>a <b>b</b><br>c</div><script>var a="<p>"</script><a href="/u">l</a>'), (2, None)], "page_id long, html string")
    nodes = H.html_nodes(page)
    assert [(r.tag, r.text) for r in nodes.orderBy("ord").collect()] == [("div", "a b c"), ("p", "a b c"), ("b", "b"), ("br", ""), ("script", ""), ("a", "l")]
    assert [r.tag for r in nodes.filter(H.has_attribute("class", "x") | H.has_attribute("href")).orderBy("ord").collect()] == ["div", "a"]


def test_html_nodes_go_on_in_chunks():
    parser = H._Nodes()
    parser.feed("<div>x" * 500)
    parser.close()
    assert len(parser.pieces) == 500 and parser.text(parser.nodes[0]) == "x" * 500 and parser.text(parser.nodes[-1]) == "x"
    page = "<div>" + "word " * 20_000 + "<p>" * 200
    pages = pd.DataFrame({"page_id": range(20), "html": ["<div>" * 40 + page] * 20})
    sizes = [(len(chunk), chunk.text.str.len().sum()) for chunk in H._rows(("div", "p"))([pages])]
    assert sum(n for n, _ in sizes) == 20 * 241 and max(s for _, s in sizes) <= H.CHUNK + 100_000


def test_sinks(spark, tmp_path):
    table = W.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(spark.range(3))
    assert table.write(table.read().unionByName(spark.range(2))) == 2 and table.read().count() == 5
    add = W.merge_batches(W.VersionedTable(spark, str(tmp_path / "m")), lambda old, new: new if old is None else old.unionByName(new))
    for batch_id in (0, 0, 1):
        add(spark.range(2), batch_id)
    assert W.VersionedTable(spark, str(tmp_path / "m")).read().count() == 4
    W.write_matrix(spark.createDataFrame([(0.5, 1.0)], "a double, b double"), str(tmp_path / "matrix"))
    assert spark.read.text(str(tmp_path / "matrix")).first().value == "0.5000000000,1.0000000000,"
    W.write_ids(spark.createDataFrame([(1, "b"), (0, "a")], "id long, n string"), "id", "n", str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert sorted((r.v, r.n) for r in with_dense_id(df, "n", "v").collect()) == [(i, i) for i in range(1000)]
    assert with_dense_id(df.limit(0), "n", "v").count() == 0


def test_fold_of_mentions(spark):
    mentions = ["Trung Van Nguyen", "Trung Nguyen", "Nguyen", "Bac Ninh", "Hanoi", "Hanoi", "Vietnam", "Mrs. Hang Vu", "Google"]
    types = [1, 1, 1, 2, 2, 2, 2, 1, 0]
    df = spark.createDataFrame([(1, i, m, t) for i, (m, t) in enumerate(zip(mentions, types, strict=True))], "doc_id long, ord long, value string, type int")
    got = {(r.value, r.type): r.cnt for r in E.fold_variants(df).collect()}
    assert set(got) == {("Trung Van Nguyen", 1), ("Mrs. Hang Vu", 1), ("Bac Ninh", 2), ("Hanoi", 2), ("Vietnam", 2), ("Google", 0)}
    assert got["Trung Van Nguyen", 1] == 4 and got["Mrs. Hang Vu", 1] == 2 and got["Bac Ninh", 2] == 2
    assert one(spark, E.entity_type(c("t")), t="location") == 2 and one(spark, E.entity_type(c("t")), t="xyz") == -1


def test_runs_end_at_documents(spark):
    rows = [(1, 0, "A", 1), (1, 1, "B", 1), (1, 2, "x", -1), (1, 3, "C", 2), (1, 4, "D", 1), (2, 0, "E", 1)]
    df = spark.createDataFrame(rows, "doc_id long, pos long, token string, label int")
    assert sorted((r.doc_id, r.ord, r.value, r.type) for r in E.merge_runs(df).collect()) == [(1, 0, "A B", 1), (1, 3, "C", 2), (1, 4, "D", 1), (2, 0, "E", 1)]


def test_mentions_are_made_where_the_document_is(spark, sf):
    """The same runs as of tokens in rows, and nothing is dealt out for them or for the fold."""
    from corpusloom.plans import catalog

    texts = [(1, "Ann Bob x Cat Dogs Abcd Ab"), (2, "Ann"), (3, None), (4, ""), (5, "x 1 y"), (6, "Ann, Bob; Éva Bob\nBob")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda m: sorted((r.doc_id, r.ord, r.value, r.type) for r in m.collect())
    assert rows(E.mentions_in(E.mention_lists(docs))) == rows(E.merge_runs(E.annotate(docs))) != []
    assert rows(E.mentions_in(E.mention_lists(docs, types=("location",)))) == rows(E.merge_runs(E.accepted(E.annotate(docs), "location")))
    for name in ("run_merge_islands", "entity_fold"):
        assert "Exchange" not in catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_fold_by_definition(spark):
    """Each entity goes on to the next in order that encloses it; whatever its words, also long and empty ones."""
    import random

    rng = random.Random(9)
    value = lambda: " ".join(rng.choices(["an", "ann", "anna", "b", "bo", "abcdefghijklmno", "abcdefghijklmnop"], k=rng.randrange(1, 4)))
    rows = [(d, i, value(), rng.randrange(2)) for d in range(6) for i in range(40)]
    for same in (True, False):
        got = {(r.doc_id, r.value, r.type): r.cnt for r in E.fold_variants(spark.createDataFrame(rows, "doc_id long, ord long, value string, type int"), same_type=same).collect()}
        want = {}
        for d in range(6):
            counts, out = {}, {}
            for e in ((v, k) for x, _, v, k in rows if x == d):
                counts[e] = counts.get(e, 0) + 1
            for e in counts:
                best = e
                for o in counts:
                    best = o if o != best and E.longer_form(best, o, same) == o else best
                out[best] = out.get(best, 0) + counts[e]
            want |= {(d, *e): n + (counts[e] if E._encloses(e[0], e[0]) else 0) for e, n in out.items()}
        assert got == want


def test_tokens(spark):
    df = spark.createDataFrame([(1, "$ a 42 $5m It"), (2, None)], "doc_id long, text string")
    assert [r.token for r in C.tokens(df).orderBy("pos").collect()] == ["$5m", "it"]


def test_pairs_and_tolerance(spark):
    calls = spark.createDataFrame([(1, "a", 0), (2, "a", 2000), (3, "b", 1), (4, "a", 4001)], "id long, k string, at long")
    assert sorted((r.id, r.other, r.apart) for r in O.interval_pairs(calls, ["k"]).collect()) == [(1, 2, 2000), (2, 1, 2000)]
    tags = spark.createDataFrame([(1, "pizza"), (1, "dominos"), (1, "pizza")], "g long, t string")
    assert O.tag_pairs(tags, "g", "t").collect() == [("dominos", "pizza", 1)]


def test_ranking_rules(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    terms = spark.createDataFrame([("a",)], "term string")
    none = spark.createDataFrame([], "tag string, other string, n long")
    pairs = spark.createDataFrame([("a", "b", 10)], "tag string, related_tag string, value long")
    assert {r.id: r.r for r in O.relatedness(labels, terms, none, pairs).collect()} == {1: 1.0, 2: 0.015}
    candidates = spark.createDataFrame([(1, 1.0)], "id long, r double")
    empty = (spark.createDataFrame([], s) for s in ("friend long, weight double", "friend long, id long", "id long, friend long, weight double"))
    assert [(r.score, r.people) for r in O.social_rank(candidates, *empty).collect()] == [(0.001, "")]
    stats = spark.createDataFrame([("u", 4)], "tag string, freq long")
    cooc = spark.createDataFrame([("u", "c", 2)], "tag string, other string, n long")
    mine, nothing = spark.createDataFrame([("u",)], "tag string"), spark.createDataFrame([], "tag string, times long")
    assert O.suggestions(mine, stats, cooc, nothing).collect() == [("c", 0.375)]
    often = spark.createDataFrame([("x", 1), ("y", 3)], "tag string, times long")
    assert [r.tag for r in O.suggestions(mine.limit(0), stats, cooc, often).collect()] == ["y", "x"]


def test_visibility(spark):
    shape = "array<struct<device_id:long,label:string>>"
    seen = K.visible_to(c("p"), c("l"), c("g"), F.lit(1).cast("long"), c("v"))
    rows = spark.createDataFrame([(False, None, [(1, "a")], None), (False, None, [(1, "a")], [(1, "a")]), (False, [(1, "z")], None, None), (None, None, None, [(1, "a")]), (True, None, None, None)], f"p boolean, l {shape}, g {shape}, v {shape}")
    assert [r[0] for r in rows.select(seen).collect()] == [False, True, True, False, True]


def test_counters_and_changes(spark):
    nothing = spark.createDataFrame([], "q string, times long")
    seen = spark.createDataFrame([("a",), ("a",), ("b",)], "q string")
    for first, want in ((0, {"a": 1, "b": 0}), (1, {"a": 2, "b": 1})):
        assert {r.q: r.times for r in K.count_up(nothing, seen, ["q"], first=first).collect()} == want
    with pytest.raises(Exception, match="more than one row"):
        K.unique_look_up(seen, q="a").collect()
    assert K.unique_look_up(seen, q="b").count() == 1
    groups, members = spark.createDataFrame([(1, "x"), (2, "y")], "group_id long, label string"), spark.createDataFrame([(1, 7)], "group_id long, id long")
    for both, n in ((True, 0), (False, 1)):
        g, m = K.delete_group(groups, members, F.col("label") == "x", both)
        assert (g.count(), m.count()) == (1, n)


def corpus(spark, n=30, length=20):
    """Documents of two kinds of words that never mix."""
    rng = np.random.default_rng(3)
    rows = [(d, p, int(rng.integers(0, 5)) + 5 * (d % 2)) for d in range(n) for p in range(length)]
    return spark.createDataFrame(rows, "doc_id long, pos long, word_id long")


def purity(rows):
    """The share of tokens whose topic is the main topic of their kind of document."""
    table = np.zeros((2, 4))
    for r in rows:
        table[r.doc_id % 2, r.z] += 1
    return table.max(1).sum() / table.sum() if table[0].argmax() != table[1].argmax() else 0.0


def test_exact_chain_separates_topics_and_repeats(spark):
    chain = S.Chain("lda", topics=2, burn_in=30, lag=5, samples=2, seed=1)
    got = S.exact(corpus(spark), None, chain)
    last = got.filter("iter = 35").collect()
    assert {r.iter for r in got.collect()} == {30, 35} and purity(last) > 0.95
    assert sorted(last) == sorted(S.exact(corpus(spark), None, chain).filter("iter = 35").collect())
    assert S.Chain("lda").sample_iterations() == list(range(300, 481, 20))


@pytest.mark.parametrize("model", ["entity_1", "entity_2", "entity_3", "event"])
def test_entity_chains(spark, model):
    entities = spark.createDataFrame([(d, 1, d % 2, 2) for d in range(30)], "doc_id long, rank long, entity_id long, cnt long")
    rows = S.exact(corpus(spark), entities, S.Chain(model, topics=2, entity_topics=3, burn_in=15, lag=5, samples=1, seed=2)).collect()
    assert len(rows) == 600
    for r in rows:
        assert (r.entity_id == r.doc_id % 2) if r.s else (r.entity_id == -1 and r.z < 2)


def test_distributed_chain_separates_topics(spark):
    start = M.random_assignments(corpus(spark), 2, 4)
    rows = S.distributed_lda(start, 2, 0.1, 0.01, 10, sweeps=15, seed=3).collect()
    assert len(rows) == 600 and purity(rows) > 0.95


def test_checkpoints(spark, tmp_path):
    rows = S.exact(corpus(spark, 4, 5), None, S.Chain("lda", topics=2, burn_in=1, lag=1, samples=2))
    for it in (1, 2):
        S.save_sample(rows.filter(F.col("iter") == it), str(tmp_path / "s"), it)
    assert {r.iter for r in S.last_sample(spark, str(tmp_path / "s")).collect()} == {2}


def test_theta_smoothing(spark):
    assigned = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (1, 1)], "doc_id long, z long")
    theta = M.shares(M.topic_vectors(assigned, "doc_id", 2), 2, 2.0, "theta")
    assert [(r.k, r.theta) for r in M.by_topic(theta, "doc_id", "theta").orderBy("k").collect()] == [(0, 5 / 8), (1, 3 / 8)]


def test_many_topics_are_counted_alike(spark, monkeypatch):
    """Beyond WIDE topics, counts, weights and products take another way to the same values."""
    rows = [(d, p, (d * 7 + p * 3) % 11, (d + p * p) % 5) for d in range(6) for p in range(30)]
    assigned = spark.createDataFrame(rows, "doc_id long, pos long, word_id long, z long")
    words = assigned.select("word_id").distinct()

    def all_of():
        vectors = M.topic_vectors(assigned, "doc_id", 5, F.col("pos") > 3)
        theta, phi = M.shares(vectors, 5, 0.1, "theta"), M.word_shares(M.topic_vectors(assigned, "word_id", 5), words, 5, 0.01)
        given = M.conditional(assigned, 5, 0.1, 0.01, 11).select("doc_id", "word_id", "z", F.array_sort("at").alias("at"), F.transform("weights", lambda w: F.round(w, 12)).alias("w"))
        return [sorted(map(tuple, x.collect())) for x in (vectors, given)] + [M.log2_likelihood(assigned, theta, phi, 5).first()[0]]

    wide = all_of()
    monkeypatch.setattr(M, "WIDE", 2)
    narrow = all_of()
    assert wide[:2] == narrow[:2] and abs(wide[2] - narrow[2]) < 1e-9
    assert sum(len(at) for _, _, _, at, _ in wide[1]) == len(rows)


def test_text_counts_are_token_counts(spark):
    docs = spark.createDataFrame([(1, "b a a c"), (2, "a a zz ZZ a1 22"), (3, None), (4, "")], "doc_id long, text string")
    by_token = lambda df: sorted((r.token, r.cnt, r.df) for r in df.collect())
    assert by_token(C.text_counts(docs, least=1)) == by_token(C.token_counts(C.tokens(docs, least=1)))


def test_resample_draws_exactly_as_many(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(7)], "doc_id long, text string")
    got = C.resample(docs, 20, seed=3)
    assert sorted(r.draw_id for r in got.collect()) == list(range(20)) and {r.doc_id for r in got.collect()} <= set(range(7))
    assert sorted(map(tuple, C.resample(docs.repartition(3), 20, seed=3).collect())) == sorted(map(tuple, got.collect()))
    assert C.resample(docs.limit(0), 5, seed=3).count() == 0


def test_tail_text_without_a_closing_tag(spark):
    pages = spark.createDataFrame([(1, "<p>tail R&D"), (2, None), (3, "<b>x &amp; y</b> z &lt")], "page_id long, html string")
    assert {(r.page_id, r.tag): r.text for r in H.html_nodes(pages).collect()} == {(1, "p"): "tail R&D", (3, "b"): "x & y"}


def test_chain_runs_once_for_all_handled_samples(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(S, "written", lambda df, name: tables.append(name) or df.persist())
    seen = []
    S.exact(corpus(spark, 3, 4), None, S.Chain("lda", topics=2, burn_in=1, lag=1, samples=3), lambda it, rows: seen.append((it, rows.count())))
    assert seen == [(1, 12), (2, 12), (3, 12)] and tables == ["samples"]


def test_schedules():
    assert S.Chain("lda", burn_in=5, lag=2, samples=3).sample_iterations() == [5, 7, 9]
    assert S.Chain("lda", report_every=4, max_iterations=13).sample_iterations() == [4, 8, 12]


def test_annotators(spark):
    docs = spark.createDataFrame([(1, "Kim met Lee in Seoul for Acme Corp")], "doc_id long, text string")
    names = spark.createDataFrame([("Kim", "person"), ("Lee", "PERSON"), ("Seoul", "Location"), ("Acme", "organization"), ("Corp", "organization")], "token string, type string")
    listed = E.annotate_listed(docs, names)
    found = lambda a: sorted((r.value, r.type) for r in E.merge_runs(a).collect())
    assert found(listed) == [("Acme Corp", 3), ("Kim", 1), ("Lee", 1), ("Seoul", 2)]
    assert found(E.accepted(listed, "location")) == [("Seoul", 2)]
    assert found(E.annotate(docs, label=lambda t: F.when(t == "Lee", 1))) == [("Lee", 1)]


def test_longest_forms_by_definition(spark):
    import random

    rng = random.Random(5)
    values = [(d, " ".join(rng.choices(["an", "ann", "anna", "b", "bo", "an"], k=rng.randrange(1, 4))), rng.randrange(2)) for d in range(4) for _ in range(25)]
    got = {(r.doc_id, r.value, r.type): r.longest for r in E.longest_forms(spark.createDataFrame(values, "doc_id long, value string, type int")).collect()}
    encloses = lambda long, short: all(long.startswith(t + " ") or long.find(" " + t) > 0 for t in short.split(" "))
    want = {}
    for d, v, k in set(values):
        other = [o for e, o, t in set(values) if (e, t) == (d, k) and (o == v or encloses(o, v))]
        want[d, v, k] = max(other, key=lambda o: (len(o), o))
    assert got == want


def test_longest_forms_are_found_where_the_document_is(spark, sf):
    from corpusloom.plans import catalog

    assert "Exchange" not in catalog.queries()["entity_longest_form"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_nearest_calls_by_definition(spark):
    import random

    rng = random.Random(4)
    calls = [(i, rng.choice("ab"), rng.randrange(0, 400)) for i in range(150)] + [(1000, "c", 5), (1001, "a", -7), (1002, "a", 10_000)]
    got = {r.id: (r.other, r.apart) for r in O.interval_pairs(spark.createDataFrame(calls, "id long, kind string, at long"), ["kind"], tolerance=6).collect()}
    want = {}
    for i, k, t in calls:
        near = [(abs(t - u), j) for j, m, u in calls if j != i and m == k and abs(t - u) <= 6]
        if near:
            want[i] = (min(near)[1], min(near)[0])
    assert got == want


def test_sweeps_of_parts(spark, monkeypatch):
    """Documents of all lengths, in several parts; a sweep doesn't depend on how they are cut."""
    monkeypatch.setattr(S, "PART_TOKENS", 40)
    toks = spark.createDataFrame([(d, p, p * 7 % 5 + 5 * (d % 2), (d * p) % 2) for d in range(12) for p in range(1 + 5 * (d % 4))], "doc_id long, pos long, word_id long, z long")
    run = lambda: sorted(map(tuple, S.distributed_lda(toks, 2, 0.1, 0.01, 10, 8, 1).collect()))
    got = run()
    assert [r[:3] for r in got] == sorted(tuple(r)[:3] for r in toks.collect())
    monkeypatch.setattr(S, "PART_TOKENS", 10_000)
    assert run() == got
    table = np.zeros((2, 2))
    for d, _, _, z in got:
        table[d % 2, z] += 1
    assert table.max(1).sum() / table.sum() > 0.9


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def finished(df, name, mode="append", **how):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start(**how)
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_stream_pairs(spark, tmp_path):
    import datetime as dt

    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, "a", at(0)), (2, "a", at(2000)), (3, "b", at(1)), (4, "a", at(4001))]
    got = finished(ST.pair_calls(stream(spark, tmp_path, rows, "id long, k string, ts timestamp"), ["k"]), "pairs")
    assert [(r.id, r.other) for r in got] == [(1, 2)]


def test_stream_counts_and_edges(spark, tmp_path):
    rows = [("1-2", "1", "2", 60, 0), ("1-2", "2", "1", 60, 1500), ("1-2", "1", "2", 30, 9000), ("3-4", "3", "4", 60, 0), ("3-4", "4", "3", 60, 2001)]
    source = stream(spark, tmp_path, rows, "pair string, device string, other string, seconds long, at long")
    assert sorted(map(tuple, finished(ST.running_counts(source, ["pair"]), "counts", "update"))) == [("1-2", 3), ("3-4", 2)]
    assert sorted(map(tuple, finished(ST.call_edges(source), "edges", "update"))) == [("1", "2", 1, 1.0), ("2", "1", 1, 1.0)]


def test_stream_shares_and_labels(spark, tmp_path):
    shares = stream(spark, tmp_path / "s", [(1, "A", "x", 1), (1, None, "y", 2), (2, "B", None, 1)], "id long, name string, city string, ts long")
    target = W.VersionedTable(spark, str(tmp_path / "shares"))
    ST.merge_shares(shares, target, str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.id, r.name, r.city) for r in target.read().collect()) == [(1, "A", "y"), (2, "B", None)]
    labels = stream(spark, tmp_path / "l", [("t", 1, ["a", "b"], 1), ("t", 1, ["b", "a"], 2), ("t", 2, ["c"], 3)], "tagger string, id long, labels array<string>, ts long")
    store = Store(spark, str(tmp_path / "store"))
    ST.label_events(labels, store, str(tmp_path / "c2")).awaitTermination()
    assert [store.read(n).count() for n in ("log", "labels", "pairs")] == [3, 3, 1] and store.read("pairs").first().value == 2 and store.latest() == 1
    log, again = W.BatchLog(spark, str(tmp_path / "log")), spark.createDataFrame([("t", 1, ["a"], 1), ("t", 2, ["c"], 3)], "tagger string, id long, labels array<string>, ts long")
    for rows in (again, again.limit(1)):
        log.write(rows, 0)  # a batch that comes again replaces itself
    assert log.read().count() == 1


def test_waiting_logs_go_with_time(spark, tmp_path):
    """A log whose counterpart comes after the watermark has passed it finds nobody, and no state is left of pairs that fell silent."""
    path, schema = tmp_path / "in", "pair string, device string, other string, seconds long, at long"
    for i, rows in enumerate([[("1-2", "1", "2", 60, 0), ("5-6", "5", "6", 9, 100)], [("3-4", "3", "4", 60, 200_000)], [("3-4", "4", "3", 60, 200_500), ("1-2", "2", "1", 60, 200_600)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"b{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))
    q = ST.call_edges(source, keep_ms=10_000).writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("late").collect())) == [("3", "4", 1, 60 / 60), ("4", "3", 1, 60 / 60)]
    left = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert max(left) >= 2 and left[-1] <= 1


def test_queries_have_names_and_sql():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


@pytest.mark.parametrize("missing", ["corpusloom.llm", "corpusloom.llm.queries", "public_tokenizers"])
def test_other_queries_stay_without_the_llm_subpackage(monkeypatch, missing):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("corpusloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    names = set(entry.queries())
    assert len(names) > 60 and not any(n.startswith("op1_") for n in names) and set(entry.oracle_sql()) <= names


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from corpusloom.sources.shared import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_relatedness_reads_labels_once(spark):
    """A label counts once for a contact however often it comes, and contacts' labels are read by one scan, not one for each kind of relation."""
    labels = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c")], "id long, label string").repartition(2).selectExpr("id", "label", "spark_partition_id() AS place")
    terms = spark.createDataFrame([("a",)], "term string")
    related = spark.createDataFrame([("a", "b", 4), ("a", "a", 9)], "tag string, other string, n long")
    pairs = spark.createDataFrame([("a", "b", 10)], "tag string, related_tag string, value long")
    found = O.relatedness(labels, terms, related, pairs)
    assert {r.id: r.r for r in found.collect()} == {1: 1.0, 2: 0.017}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("SPARK_PARTITION_ID") + found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [id") <= 2
