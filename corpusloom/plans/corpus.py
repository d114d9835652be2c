"""Corpus and entity queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.porter import stemmed
from ..operators import corpus as C
from ..operators import entities as E
from ..operators import tagger as G
from ..sources.shared import written
from .registry import query, table

TOKENS = r"""raw AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[$a-zA-Z0-9]+') AS l FROM documents)),
toks AS (SELECT doc_id, pos, lower(raw) AS token FROM raw WHERE length(raw) >= 2 AND regexp_matches(raw, '[A-Za-z]'))"""
COUNTS = TOKENS + ", counts AS (SELECT token, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM toks GROUP BY 1)"
VOCAB = COUNTS + ", vocab AS (SELECT row_number() OVER (ORDER BY cnt DESC, token) - 1 AS word_id, * FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, token) AS r FROM counts WHERE cnt >= 5) WHERE r > 40)"
MENTIONS = r"""words AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents)),
ann AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Z][a-z]+$') THEN length(token) % 3 + 1 ELSE -1 END AS label FROM words),
runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS s FROM ann)),
mentions AS (SELECT doc_id, min(pos) AS ord, string_agg(token, ' ' ORDER BY pos) AS value, label AS type FROM runs WHERE label >= 0 GROUP BY doc_id, run, label)"""
ENTITIES = MENTIONS + ", ents AS (SELECT row_number() OVER (ORDER BY type, value) - 1 AS entity_id, * FROM (SELECT value, type, count(DISTINCT doc_id) AS doc_count FROM mentions GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2))"


def docs_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokens_of(spark, sf_dir) -> DataFrame:
    return C.tokens(docs_of(spark, sf_dir))


def counts_of(spark, sf_dir) -> DataFrame:
    return C.text_counts(docs_of(spark, sf_dir))


def vocabulary_of(spark, sf_dir) -> DataFrame:
    return C.vocabulary(counts_of(spark, sf_dir), 5, 40)


def mentions_of(spark, sf_dir) -> DataFrame:
    return E.mentions_in(E.mention_lists(docs_of(spark, sf_dir)))


def flagship(spark, sf_dir) -> DataFrame:
    return counts_of(spark, sf_dir).orderBy(F.desc("cnt"), "token").limit(100)


@query(f"WITH {COUNTS} SELECT token, cnt, df FROM counts")
def vocab_counts(spark, sf_dir):
    return counts_of(spark, sf_dir)


@query(f"WITH {COUNTS} SELECT token, cnt, df FROM counts WHERE df <= 10 * (SELECT count(*) FROM documents) // 100")
def doc_freq_prune(spark, sf_dir):
    return C.frequent_documents(counts_of(spark, sf_dir), docs_of(spark, sf_dir).count(), 10)


@query(f"WITH {VOCAB} SELECT word_id, token, cnt, df FROM vocab")
def top_stopwords(spark, sf_dir):
    """Vocabulary without the 40 most frequent tokens, with dense ids."""
    return vocabulary_of(spark, sf_dir)


@query(f"WITH {VOCAB} SELECT doc_id, pos, word_id FROM toks JOIN vocab USING (token)")
def encoded_docs(spark, sf_dir):
    return C.encode(tokens_of(spark, sf_dir), written(vocabulary_of(spark, sf_dir), "vocabulary")).select("doc_id", F.col("pos").cast("long").alias("pos"), "word_id")


@query(f"WITH {VOCAB} SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS words, count(*) AS n FROM toks JOIN vocab USING (token) GROUP BY 1")
def decoded_docs(spark, sf_dir):
    """Documents encoded, packed into arrays, and decoded again."""
    vocab = written(vocabulary_of(spark, sf_dir), "vocabulary")
    back = C.decode(C.encode(tokens_of(spark, sf_dir), vocab), vocab)
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return back.groupBy("doc_id").agg(F.array_join(words, " ").alias("words"), F.count("*").alias("n"))


@query(f"WITH {TOKENS}, {ENTITIES} SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM toks) AS n_tokens, (SELECT count(DISTINCT token) FROM toks) AS n_unique, (SELECT count(*) FROM ents) AS n_entities")
def corpus_stats(spark, sf_dir):
    return C.corpus_stats(tokens_of(spark, sf_dir), docs_of(spark, sf_dir), E.entity_set(mentions_of(spark, sf_dir)))


_STOPS = ", ".join(f"('{w}')" for w in C.STOP_WORDS)


@query(f"WITH {COUNTS}, stops(token) AS (VALUES {_STOPS}) SELECT token, cnt FROM counts ANTI JOIN stops USING (token)")
def stopword_anti_join(spark, sf_dir):
    return C.without_stop_words(counts_of(spark, sf_dir), C.stop_list(spark)).select("token", "cnt")


@query(f"WITH {TOKENS}, stops(token) AS (VALUES {_STOPS}, ('market'), ('data')) SELECT token, count(*) AS cnt, min(pos) AS first FROM toks ANTI JOIN stops USING (token) GROUP BY 1")
def token_chain(spark, sf_dir):
    """Counts of tokens after a chain of steps: with letters, in lower case, without function words, without words of the caller's own."""
    toks = C.chained(docs_of(spark, sf_dir), *C.CHAIN, C.without_words(["market", "data"]))
    return toks.groupBy("token").agg(F.count("*").alias("cnt"), F.min("pos").cast("long").alias("first"))


@query(f"WITH {COUNTS} SELECT token, cnt, df FROM counts WHERE cnt >= 5")
def min_token_count(spark, sf_dir):
    return counts_of(spark, sf_dir).filter("cnt >= 5")


@query(r"WITH t AS (SELECT unnest(regexp_extract_all(text, '[$a-zA-Z_]+')) AS raw FROM documents) SELECT lower(raw) AS token, count(*) AS cnt FROM t WHERE length(raw) BETWEEN 3 AND 39 AND regexp_matches(raw, '[A-Za-z]') GROUP BY 1")
def stem_bounds_filter(spark, sf_dir):
    toks = C.tokens(docs_of(spark, sf_dir), pattern=T.ARTICLE_WORDS, least=3, most=39)
    return toks.groupBy("token").agg(F.count("*").alias("cnt"))


@query()
def porter_stems(spark, sf_dir):
    """Stems of all distinct article tokens, with the tokens' counts; stems are made once a distinct token."""
    counts = C.tokens(docs_of(spark, sf_dir), pattern=T.ARTICLE_WORDS, least=1).groupBy("token").agg(F.count("*").alias("cnt"))
    stems = counts.withColumn("stem", stemmed(F.col("token"))).filter(T.is_token(F.col("stem"), 3, 39))
    return stems.groupBy("stem").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_forms"))


@query(f"WITH {MENTIONS} SELECT doc_id, ord, value, type FROM mentions")
def run_merge_islands(spark, sf_dir):
    return mentions_of(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "value", F.col("type").cast("long").alias("type"))


@query()
def tagged_mentions(spark, sf_dir):
    """Mentions by a tag model that is learned from a list of names (capitalised words that occur often, typed by their length): best paths through all documents."""
    docs = docs_of(spark, sf_dir)
    often = E.annotate(docs).filter("label >= 0").groupBy("token", "label").agg(F.count("*").alias("n")).filter("n >= 5")
    names = often.select("token", F.get(F.array(F.lit("OTHER"), F.lit("PERSON"), F.lit("LOCATION"), F.lit("ORGANIZATION")), F.col("label")).alias("type"))
    model = G.learn_lists(G.listed_labels(G.word_lists(docs), names))
    return E.mentions_in(E.run_lists(G.tag_lists(docs, model))).select("doc_id", F.col("ord").cast("long").alias("ord"), "value", F.col("type").cast("long").alias("type"))


@query(f"""WITH {MENTIONS.replace("length(token) % 3 + 1 ELSE", "CASE WHEN length(token) % 3 = 1 THEN -1 ELSE length(token) % 3 + 1 END ELSE")} SELECT doc_id, ord, value, type FROM mentions""")
def entity_types_switch(spark, sf_dir):
    """Mentions of persons and organisations only; locations aren't accepted and end runs."""
    taken = E.mention_lists(docs_of(spark, sf_dir), types=("person", "Organization"))
    return E.mentions_in(taken).select("doc_id", F.col("ord").cast("long").alias("ord"), "value", F.col("type").cast("long").alias("type"))


@query(f"WITH {ENTITIES} SELECT entity_id, value, type, doc_count FROM ents")
def entity_doc_count(spark, sf_dir):
    return E.entity_set(mentions_of(spark, sf_dir)).select("entity_id", "value", F.col("type").cast("long").alias("type"), "doc_count")


@query(f"WITH {MENTIONS} SELECT value, type, count(*) AS mentions FROM mentions WHERE NOT (type = 1 AND value LIKE 'The%') GROUP BY 1, 2 HAVING count(*) >= 3")
def entity_mention_count(spark, sf_dir):
    """Entities by mentions (each counts), without stop entities: persons whose name begins with The."""
    mentions = mentions_of(spark, sf_dir)
    stop = mentions.filter("type = 1 AND value LIKE 'The%'").select("value", "type").distinct()
    return E.entity_set(mentions, 3, stop, by_mention=True).select("value", F.col("type").cast("long").alias("type"), F.col("doc_count").alias("mentions"))


_TOP = ", c AS (SELECT doc_id, entity_id, count(*) AS cnt FROM mentions JOIN ents USING (value, type) GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, entity_id) AS rank FROM c)"


@query(f"WITH {ENTITIES}{_TOP} SELECT doc_id, rank, entity_id, cnt FROM top WHERE rank <= 4")
def entity_top_n(spark, sf_dir):
    mentions = mentions_of(spark, sf_dir)
    return E.document_entities(mentions, E.entity_set(mentions), 4).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {ENTITIES}{_TOP} SELECT doc_id, sum(cnt)::BIGINT AS mentions FROM top WHERE rank <= 4 GROUP BY 1")
def entity_mention_total(spark, sf_dir):
    mentions = mentions_of(spark, sf_dir)
    return E.document_entities(mentions, E.entity_set(mentions), 4).groupBy("doc_id").agg(F.sum("cnt").alias("mentions"))


def _in(short: str, long: str) -> str:
    """SQL for whether each word of one text starts another, or starts a later word of it."""
    return f"len(list_filter(string_split({short}, ' '), lambda t: NOT (starts_with({long}, t || ' ') OR instr({long}, ' ' || t) > 1))) = 0"


@query(
    f"""WITH {MENTIONS}, c AS (SELECT doc_id, value, type, count(*) AS n, min(ord) AS first FROM mentions GROUP BY 1, 2, 3), o AS (SELECT doc_id, list({{'v': value, 't': type}} ORDER BY first) AS l FROM c GROUP BY 1),
b AS (SELECT doc_id, n, list_reduce(list_prepend({{'v': value, 't': type}}, l), lambda best, e: CASE WHEN e.t = best.t AND e.v <> best.v AND {_in("best.v", "e.v")} AND NOT {_in("e.v", "best.v")} THEN e ELSE best END) AS best FROM c JOIN o USING (doc_id)),
f AS (SELECT doc_id, best.v AS value, best.t AS type, sum(n)::BIGINT AS n FROM b GROUP BY ALL)
SELECT f.doc_id, f.value, f.type, f.n + CASE WHEN {_in("f.value", "f.value")} THEN c.n ELSE 0 END AS cnt FROM f JOIN c ON c.doc_id = f.doc_id AND c.value = f.value AND c.type = f.type"""
)
def entity_fold(spark, sf_dir):
    """Mentions of each document folded into their longest forms, in order."""
    return E.fold_listed(E.mention_lists(docs_of(spark, sf_dir))).withColumn("type", F.col("type").cast("long"))


@query(
    f"""WITH {MENTIONS}, d AS (SELECT DISTINCT doc_id, value, type FROM mentions),
m AS (SELECT a.doc_id, a.value, a.type, b.value AS other FROM d a JOIN d b USING (doc_id, type)
  WHERE a.value = b.value OR len(list_filter(string_split(a.value, ' '), lambda t: NOT (starts_with(b.value, t || ' ') OR instr(b.value, ' ' || t) > 1))) = 0)
SELECT doc_id, value, type, arg_max(other, (length(other), other)) AS longest FROM m GROUP BY 1, 2, 3"""
)
def entity_longest_form(spark, sf_dir):
    return E.longest_listed(E.mention_lists(docs_of(spark, sf_dir))).withColumn("type", F.col("type").cast("long"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS spot, doc_id FROM documents), r AS (SELECT unnest(range((SELECT n // 2 FROM n))) AS draw_id)
SELECT draw_id, doc_id FROM (SELECT draw_id, ('0x' || substr(md5('11:' || draw_id), 1, 12))::BIGINT % (SELECT n FROM n) AS spot FROM r) JOIN d USING (spot)"""
)
def corpus_resample(spark, sf_dir):
    """A sample of the corpus with replacement (the feature is the sampling), half as large."""
    docs = docs_of(spark, sf_dir)
    return C.resample(docs, docs.count() // 2, seed=11).select("draw_id", "doc_id")
