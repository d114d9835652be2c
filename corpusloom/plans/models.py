"""Topic-model queries over the pruned corpus with reproducible assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import documents as D
from ..operators import entities as E
from ..operators import samplers as S
from ..operators import topics as M
from ..sources.shared import written
from .corpus import ENTITIES, VOCAB, docs_of, mentions_of, tokens_of, vocabulary_of
from .registry import query, table

K, ALPHA, BETA = 5, 0.1, 0.01
#: Entities of a document.
TOP = 4

ENC = VOCAB + f", a AS (SELECT doc_id, pos, word_id, (31 * doc_id + 17 * pos + 7 * word_id) % {K} AS z FROM toks JOIN vocab USING (token)), ks AS (SELECT unnest(range({K})) AS k)"
WT = ENC + ", wt AS (SELECT word_id, z AS k, count(*) AS n FROM a GROUP BY 1, 2), dt AS (SELECT doc_id, z AS k, count(*) AS n FROM a GROUP BY 1, 2)"
THETA = WT + f", theta AS (SELECT doc_id, k, (coalesce(n, 0) + {ALPHA}::DOUBLE) / (size + {K * ALPHA}::DOUBLE) AS theta FROM (SELECT doc_id, count(*) AS size FROM a GROUP BY 1) CROSS JOIN ks LEFT JOIN dt USING (doc_id, k))"
PHI = f", phi AS (SELECT word_id, k, (coalesce(n, 0) + {BETA}::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM vocab) * {BETA}::DOUBLE) AS phi FROM (SELECT word_id FROM vocab) CROSS JOIN ks LEFT JOIN wt USING (word_id, k) LEFT JOIN (SELECT k, sum(n) AS total FROM wt GROUP BY 1) USING (k))"
ENT = ENC + ", " + ENTITIES + """, c AS (SELECT doc_id, entity_id, count(*) AS cnt FROM mentions JOIN ents USING (value, type) GROUP BY 1, 2),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, entity_id) AS rank FROM c) WHERE rank <= 4),
el AS (SELECT doc_id, flatten(list(list_transform(range(cnt), lambda i: entity_id) ORDER BY entity_id)) AS l FROM de GROUP BY 1),
e AS (SELECT a.*, CASE WHEN l IS NULL THEN 0 ELSE (doc_id + pos) % 2 END AS s, CASE WHEN l IS NOT NULL AND (doc_id + pos) % 2 = 1 THEN l[pos % len(l) + 1] END AS entity_id FROM a LEFT JOIN el USING (doc_id))"""


def assigned_of(spark, sf_dir):
    """Assignments and vocabulary, written once: every statistic reads the assignments several times."""
    vocab = written(vocabulary_of(spark, sf_dir), "vocabulary")
    return written(M.arithmetic_assignments(C.encode(tokens_of(spark, sf_dir), vocab), K), "assigned"), vocab


def top_entities(spark, sf_dir):
    """Entities, and each document's four most mentioned ones: no token is needed for them."""
    mentions = written(mentions_of(spark, sf_dir), "mentions")
    entities = written(E.entity_set(mentions), "entities")
    return entities, written(E.document_entities(mentions, entities, TOP), "document-entities")


def entity_assigned(spark, sf_dir):
    """Tokens with their entities: a document's few entities go to its text, and its tokens carry them, so no token is shuffled."""
    vocab = written(vocabulary_of(spark, sf_dir), "vocabulary")
    entities, top = top_entities(spark, sf_dir)
    docs = docs_of(spark, sf_dir).join(M.entity_lists(top), "doc_id", "left")
    encoded = C.encode(C.tokens(docs, carried=["entities"]), vocab, carried=["entities"])
    return written(M.switched(M.arithmetic_assignments(encoded, K), TOP), "entity-assigned"), vocab, entities, top


def theta_arrays(assigned):
    return M.shares(M.topic_vectors(assigned, "doc_id", K), K, ALPHA, "theta")


def theta_of(assigned):
    return M.by_topic(theta_arrays(assigned), "doc_id", "theta")


def phi_arrays(assigned, vocab):
    return M.word_shares(M.topic_vectors(assigned, "word_id", K), vocab, K, BETA)


@query(f"WITH {WT} SELECT word_id, k, n FROM wt")
def lda_counts(spark, sf_dir):
    return M.topic_counts(assigned_of(spark, sf_dir)[0], "word_id")


@query(f"WITH {WT} SELECT doc_id, k, n FROM dt")
def doc_topic_counts(spark, sf_dir):
    return M.topic_counts(assigned_of(spark, sf_dir)[0], "doc_id")


@query(f"WITH {THETA} SELECT doc_id, k, round(theta, 9) AS theta FROM theta")
def lda_theta(spark, sf_dir):
    return theta_of(assigned_of(spark, sf_dir)[0]).withColumn("theta", F.round("theta", 9))


@query(f"WITH {WT}{PHI} SELECT word_id, k, round(phi, 12) AS phi FROM phi")
def lda_phi(spark, sf_dir):
    assigned, vocab = assigned_of(spark, sf_dir)
    return M.by_topic(phi_arrays(assigned, vocab), "word_id", "phi").withColumn("phi", F.round("phi", 12))


@query(f"WITH {THETA} SELECT doc_id, {', '.join(f'round(max(CASE WHEN k = {k} THEN theta END), 9) AS "topic {k}"' for k in range(K))} FROM theta GROUP BY 1")
def theta_matrix(spark, sf_dir):
    """Documents by topics as a matrix."""
    wide = theta_arrays(assigned_of(spark, sf_dir)[0])
    return wide.select("doc_id", *(F.round(F.get("theta", F.lit(k)), 9).alias(f"topic {k}") for k in range(K)))


@query(f"WITH {WT}, t AS (SELECT k, word_id, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, word_id) AS rank FROM wt) SELECT k, rank, token, n FROM t JOIN vocab USING (word_id) WHERE rank <= 20")
def topic_top_words(spark, sf_dir):
    assigned, vocab = assigned_of(spark, sf_dir)
    best = M.top(M.topic_counts(assigned, "word_id"), ["k"], F.col("n"), "word_id", 20)
    return C.decode(best, vocab).select("k", F.col("rank").cast("long").alias("rank"), "token", "n")


@query(
    f"""WITH {WT}{PHI}, t AS (SELECT k, word_id, phi, row_number() OVER (PARTITION BY k ORDER BY round(phi, 12) DESC, word_id) AS rank FROM phi)
SELECT rank, {', '.join(f"max(CASE WHEN k = {k} THEN token || '(' || printf('%.4f', phi) || ')' END) AS \"topic {k}\"" for k in range(K))} FROM t JOIN vocab USING (word_id) WHERE rank <= 20 GROUP BY 1"""
)
def top_words_matrix(spark, sf_dir):
    """Rank by topic: `word(probability)`."""
    assigned, vocab = assigned_of(spark, sf_dir)
    probabilities = M.by_topic(phi_arrays(assigned, vocab), "word_id", "phi")
    best = C.decode(M.top(probabilities, ["k"], F.round("phi", 12), "word_id", 20), vocab)
    cells = best.select(F.col("rank").cast("long").alias("rank"), "k", F.format_string("%s(%.4f)", "token", "phi").alias("cell"))
    return M.as_matrix(cells, "rank", K, "cell")


@query(f"WITH {THETA}, t AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) AS rank FROM dt) SELECT doc_id, rank, k, n, round(theta, 9) AS theta FROM t JOIN theta USING (doc_id, k) WHERE rank <= 3")
def doc_top_topics(spark, sf_dir):
    assigned, _ = assigned_of(spark, sf_dir)
    best = M.top(M.topic_counts(assigned, "doc_id"), ["doc_id"], F.col("n"), "k", 3)
    return best.join(theta_of(assigned), ["doc_id", "k"]).select("doc_id", F.col("rank").cast("long").alias("rank"), "k", "n", F.round("theta", 9).alias("theta"))


@query(
    f"""WITH {WT}, w AS (SELECT word_id, sum(n) AS total FROM wt GROUP BY 1), t AS (SELECT k, sum(n) AS size FROM wt GROUP BY 1), c AS (SELECT count(*) AS all_n FROM a)
SELECT word_id, k, round((n - size * (total / all_n)) / sqrt(size * (total / all_n) * (1 - total / all_n)), 6) AS z FROM wt JOIN w USING (word_id) JOIN t USING (k) CROSS JOIN c"""
)
def topic_word_zscore(spark, sf_dir):
    assigned, _ = assigned_of(spark, sf_dir)
    counts = M.topic_counts(assigned, "word_id")
    per_word = counts.groupBy("word_id").agg(F.sum("n").alias("total"))
    per_topic = counts.groupBy("k").agg(F.sum("n").alias("size"))
    n = assigned.count()
    joined = counts.join(per_word, "word_id").join(F.broadcast(per_topic), "k")  # K rows
    return joined.select("word_id", "k", F.round(T.z_score(F.col("n"), F.col("size"), F.col("total"), F.lit(float(n))), 6).alias("z"))


@query(
    f"""WITH {WT}, w AS (SELECT word_id, sum(n) AS in_all FROM wt GROUP BY 1), t AS (SELECT k, sum(n)::BIGINT AS total FROM wt GROUP BY 1), c AS (SELECT count(*) AS all_n, (SELECT count(*) FROM vocab) AS v FROM a),
r AS (SELECT k, word_id, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, word_id) AS rank FROM wt)
SELECT k, total, rank, word_id, token, n, round((n + {BETA}::DOUBLE) / (total + v * {BETA}::DOUBLE), 9) AS prob, round((n - total * (in_all / all_n)) / sqrt(total * (in_all / all_n) * (1 - in_all / all_n)), 6) AS z
FROM r JOIN t USING (k) JOIN w USING (word_id) JOIN vocab USING (word_id) CROSS JOIN c WHERE rank <= 25"""
)
def topic_full_report(spark, sf_dir):
    """Each topic's size, and its first 25 words with count, probability and z."""
    assigned, vocab = assigned_of(spark, sf_dir)
    return M.topic_report(assigned, vocab, BETA, 25).withColumns({"prob": F.round("prob", 9), "z": F.round("z", 6)})


@query(f"WITH {THETA}{PHI}, p AS (SELECT a.doc_id, a.pos, sum(theta * phi) AS p FROM a JOIN theta USING (doc_id) JOIN phi USING (word_id, k) GROUP BY 1, 2) SELECT round(sum(log2(p)), 3) AS log2_likelihood FROM p")
def lda_log2_likelihood(spark, sf_dir):
    assigned, vocab = assigned_of(spark, sf_dir)
    out = M.log2_likelihood(assigned, theta_arrays(assigned), phi_arrays(assigned, vocab), K, vocab.count())
    return out.select(F.round("log2_likelihood", 3).alias("log2_likelihood"))


_WEIGHTS = f"""nd AS (SELECT doc_id, z, count(*) AS nd FROM a GROUP BY 1, 2), nw AS (SELECT word_id, z, count(*) AS nw FROM a GROUP BY 1, 2), nk AS (SELECT z, count(*) AS nk FROM a GROUP BY 1),
g AS (SELECT a.doc_id, a.pos, a.word_id, a.z, ks.k, (coalesce(nw, 0) - (a.z = ks.k)::INT + {BETA}::DOUBLE) / (coalesce(nk, 0) - (a.z = ks.k)::INT + (SELECT count(*) FROM vocab) * {BETA}::DOUBLE) * (coalesce(nd, 0) - (a.z = ks.k)::INT + {ALPHA}::DOUBLE) AS w
  FROM a CROSS JOIN ks LEFT JOIN nd ON nd.doc_id = a.doc_id AND nd.z = k LEFT JOIN nw ON nw.word_id = a.word_id AND nw.z = k LEFT JOIN nk ON nk.z = k)"""


@query(f"WITH {ENC}, {_WEIGHTS} SELECT doc_id, pos, arg_max(k, (round(w / t, 9), -k)) AS best, round(max(w / t), 7) AS share FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, pos) AS t FROM g) GROUP BY 1, 2")
def gibbs_conditional(spark, sf_dir):
    """The likeliest topic of each token given all others, and its share."""
    assigned, vocab = assigned_of(spark, sf_dir)
    given = M.conditional(assigned, K, ALPHA, BETA, vocab.count())
    w = [F.get("weights", F.lit(k)) for k in range(K)]
    given = given.withColumn("total", sum(w[1:], w[0]))
    best = F.greatest(*(F.struct(F.round(x / F.col("total"), 9).alias("w"), F.lit(-k).alias("k")) for k, x in enumerate(w)))
    of_cell = given.select("doc_id", "at", (-best["k"]).cast("long").alias("best"), F.round(F.greatest(*w) / F.col("total"), 7).alias("share"))
    return of_cell.select("doc_id", F.explode("at").alias("pos"), "best", "share").withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {ENC}, {_WEIGHTS}, c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, pos ORDER BY k) AS cum, sum(w) OVER (PARTITION BY doc_id, pos) AS t FROM g)
SELECT doc_id, pos, coalesce(min(CASE WHEN ((doc_id * 7919 + pos * 104729) % 10007) / 10007.0::DOUBLE * t < cum THEN k END), {K - 1}) AS z FROM c GROUP BY 1, 2"""
)
def inverse_cdf_draw(spark, sf_dir):
    """The topic that each token would draw with a fixed number."""
    assigned, vocab = assigned_of(spark, sf_dir)
    given = M.conditional(assigned, K, ALPHA, BETA, vocab.count())
    tokens = given.select("doc_id", F.explode("at").alias("pos"), "weights")
    drawn = T.draw_index(F.col("weights"), M.uniform(F.col("doc_id"), F.col("pos")), K)
    return tokens.select("doc_id", F.col("pos").cast("long").alias("pos"), drawn.cast("long").alias("z"))


@query(f"WITH {ENT} SELECT doc_id, s, count(*) AS n FROM e GROUP BY 1, 2")
def switch_counts(spark, sf_dir):
    return entity_assigned(spark, sf_dir)[0].groupBy("doc_id", "s").agg(F.count("*").alias("n"))


def entity_shares(assigned, entities):
    vectors = M.topic_vectors(assigned.filter("s = 1"), "entity_id", K)
    return M.shares(M.for_keys(vectors, entities, "entity_id", K), K, 0.1, "theta_e")


@query(f"WITH {ENT}, ez AS (SELECT entity_id, z AS k, count(*) AS n FROM e WHERE s = 1 GROUP BY 1, 2) SELECT entity_id, k, round((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(size, 0) + {K} * 0.1::DOUBLE), 9) AS theta_e FROM (SELECT entity_id FROM ents) CROSS JOIN ks LEFT JOIN ez USING (entity_id, k) LEFT JOIN (SELECT entity_id, sum(n) AS size FROM ez GROUP BY 1) USING (entity_id)")
def entity_theta(spark, sf_dir):
    assigned, _, entities, _ = entity_assigned(spark, sf_dir)
    return M.by_topic(entity_shares(assigned, entities), "entity_id", "theta_e").withColumn("theta_e", F.round("theta_e", 9))


@query(f"WITH {ENT}, t AS (SELECT entity_id, z AS k, count(*) AS n, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, z) AS rank FROM e WHERE s = 1 GROUP BY 1, 2) SELECT value, type, rank, k, n FROM t JOIN ents USING (entity_id) WHERE rank <= 3")
def entity_top_topics(spark, sf_dir):
    assigned, _, entities, _ = entity_assigned(spark, sf_dir)
    best = M.top(M.topic_counts(assigned.filter("s = 1"), "entity_id"), ["entity_id"], F.col("n"), "k", 3)
    return best.join(entities, "entity_id").select("value", F.col("type").cast("long").alias("type"), F.col("rank").cast("long").alias("rank"), "k", "n")


@query(
    f"""WITH {ENT}, r AS (SELECT 'all' AS kind, word_id, z AS k, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'doc', word_id, z, count(*) FROM e WHERE s = 0 GROUP BY ALL UNION ALL SELECT 'ent', word_id, z, count(*) FROM e WHERE s = 1 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY kind, k ORDER BY n DESC, word_id) AS rank FROM r)
SELECT k, rank, max(CASE WHEN kind = 'all' THEN token END) AS word, max(CASE WHEN kind = 'doc' THEN token END) AS doc_word, max(CASE WHEN kind = 'ent' THEN token END) AS entity_word FROM t JOIN vocab USING (word_id) WHERE rank <= 20 GROUP BY 1, 2 HAVING count(*) = 3"""
)
def top_words_by_switch(spark, sf_dir):
    """Three rankings of a topic's words side by side, as long as the shortest."""
    assigned, vocab, _, _ = entity_assigned(spark, sf_dir)
    kinds = F.explode(F.array(F.lit("all"), F.when(F.col("s") == 0, "doc").otherwise("ent"))).alias("kind")
    counts = assigned.select(kinds, "word_id", F.col("z").alias("k")).groupBy("kind", "k", "word_id").agg(F.count("*").alias("n"))
    best = C.decode(M.top(counts, ["kind", "k"], F.col("n"), "word_id", 20), vocab)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("token")))
    zipped = best.groupBy("k", F.col("rank").cast("long").alias("rank")).agg(of("all").alias("word"), of("doc").alias("doc_word"), of("ent").alias("entity_word"), F.count("*").alias("kinds"))
    return zipped.filter("kinds = 3").drop("kinds")


@query(
    f"""WITH {ENT}, nd AS (SELECT doc_id, count(*) AS n, sum(1 - s) AS cd FROM e GROUP BY 1), dz AS (SELECT doc_id, z AS k, count(*) AS n FROM e WHERE s = 0 GROUP BY 1, 2), ez AS (SELECT entity_id, z AS k, count(*) AS n FROM e WHERE s = 1 GROUP BY 1, 2),
th AS (SELECT doc_id, k, (coalesce(dz.n, 0) + 0.1::DOUBLE) / (cd + {K} * 0.1::DOUBLE) AS th FROM nd CROSS JOIN ks LEFT JOIN dz USING (doc_id, k)),
te AS (SELECT entity_id, k, (coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(size, 0) + {K} * 0.1::DOUBLE) AS te FROM (SELECT entity_id FROM ents) CROSS JOIN ks LEFT JOIN ez USING (entity_id, k) LEFT JOIN (SELECT entity_id, sum(n) AS size FROM ez GROUP BY 1) USING (entity_id)),
se AS (SELECT doc_id, k, sum(te) / max(total) AS se FROM de JOIN te USING (entity_id) JOIN (SELECT doc_id, sum(cnt) AS total FROM de GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
wz AS (SELECT s, word_id, z AS k, count(*) AS n FROM e GROUP BY 1, 2, 3), wt AS (SELECT s, k, sum(n) AS t FROM wz GROUP BY 1, 2),
ph AS (SELECT s, word_id, k, (coalesce(n, 0) + 0.01::DOUBLE) / (coalesce(t, 0) + (SELECT count(*) FROM vocab) * 0.01::DOUBLE) AS ph FROM (SELECT unnest([0, 1]) AS s) CROSS JOIN (SELECT word_id FROM vocab) CROSS JOIN ks LEFT JOIN wz USING (s, word_id, k) LEFT JOIN wt USING (s, k)),
pairs AS (SELECT doc_id, word_id, count(*) AS c FROM e GROUP BY 1, 2),
p AS (SELECT pairs.doc_id, pairs.word_id, c, (cd + 0.5::DOUBLE) / (n + 1.0::DOUBLE) AS pi, sum(p0.ph * th) AS d, sum(p1.ph * coalesce(se, 0)) AS x FROM pairs JOIN nd USING (doc_id) JOIN th USING (doc_id) JOIN ph p0 ON p0.s = 0 AND p0.word_id = pairs.word_id AND p0.k = th.k JOIN ph p1 ON p1.s = 1 AND p1.word_id = pairs.word_id AND p1.k = th.k LEFT JOIN se ON se.doc_id = pairs.doc_id AND se.k = th.k GROUP BY ALL)
SELECT round(sum(c * log2(pi * d + (1 - pi) * x)), 2) AS log2_likelihood FROM p"""
)
def entity_log2_likelihood(spark, sf_dir):
    """Log-likelihood under document and entity topics; entity topics are summed over distinct entities and divided by all mentions."""
    assigned, vocab, entities, top = entity_assigned(spark, sf_dir)
    of_words = F.col("s") == 0
    docs = assigned.groupBy("doc_id").agg(F.count("*").alias("words")).join(M.shares(M.topic_vectors(assigned, "doc_id", K, of_words), K, 0.1, "theta"), "doc_id")
    of_entities = top.join(entity_shares(assigned, entities).select("entity_id", "theta_e"), "entity_id").groupBy("doc_id")
    mean = F.array(*(F.sum(F.get("theta_e", F.lit(k))) / F.sum("cnt") for k in range(K)))
    docs = docs.join(of_entities.agg(mean.alias("from_entities")), "doc_id", "left").select("doc_id", "words", F.col("size").alias("cd"), "theta", "from_entities")
    words = [M.word_shares(M.topic_vectors(assigned, "word_id", K, F.col("s") == s), vocab, K, 0.01, f"phi_{s}") for s in (0, 1)]
    both = M.to_tokens(words[0].join(words[1], "word_id"), vocab.count(), 2 * K)
    joined = M.pair_counts(assigned, "c").join(docs, "doc_id").join(both, "word_id")
    pi = (F.col("cd") + 0.5) / (F.col("words") + 1.0)
    p = pi * M.dot("phi_0", "theta", K) + (1 - pi) * F.coalesce(M.dot("phi_1", "from_entities", K), F.lit(0.0))
    return joined.agg(F.round(F.sum(F.col("c") * F.log2(p)), 2).alias("log2_likelihood"))


@query(
    f"""WITH {ENT}, w AS (SELECT doc_id, z AS k, count(*) AS n FROM a GROUP BY 1, 2), x AS (SELECT doc_id, entity_id % {K} AS k, count(*) AS n FROM de GROUP BY 1, 2),
b AS (SELECT doc_id, k, sum(n) AS n FROM (FROM w UNION ALL FROM x) GROUP BY 1, 2), s AS (SELECT doc_id, sum(n) AS size FROM b GROUP BY 1)
SELECT doc_id, k, round((coalesce(n, 0) + 0.1::DOUBLE) / (size + {K} * 0.1::DOUBLE), 9) AS theta FROM s CROSS JOIN ks LEFT JOIN b USING (doc_id, k)"""
)
def event_theta(spark, sf_dir):
    """Event shares of documents from words and entities together; an entity's event is its id mod K here."""
    assigned, _, _, top = entity_assigned(spark, sf_dir)
    both = assigned.select("doc_id", "z").unionByName(top.select("doc_id", F.pmod("entity_id", F.lit(K)).alias("z")))
    return M.by_topic(M.shares(M.topic_vectors(both, "doc_id", K), K, 0.1, "theta"), "doc_id", "theta").withColumn("theta", F.round("theta", 9))


@query(f"WITH {ENT}, x AS (SELECT entity_id, (doc_id + rank) % {K} AS k, count(*) AS n FROM de GROUP BY 1, 2) SELECT entity_id, k, round((coalesce(n, 0) + 0.5::DOUBLE) / (coalesce(t, 0) + (SELECT count(*) FROM ents) * 0.5::DOUBLE), 9) AS psi FROM (SELECT entity_id FROM ents) CROSS JOIN ks LEFT JOIN x USING (entity_id, k) LEFT JOIN (SELECT k, sum(n) AS t FROM x GROUP BY 1) USING (k)")
def event_psi(spark, sf_dir):
    """Entity shares of events; a mention's event is (doc + rank) mod K here."""
    entities, top = top_entities(spark, sf_dir)
    marked = top.withColumn("z", F.pmod(F.col("doc_id") + F.col("rank"), F.lit(K)))
    psi = M.word_shares(M.topic_vectors(marked, "entity_id", K), entities, K, 0.5, "psi", "entity_id")
    return M.by_topic(psi, "entity_id", "psi").withColumn("psi", F.round("psi", 9))


_RANKED = "row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {tie}) AS rank"


@query(f"WITH {WT}, t AS (SELECT k AS event, word_id, n, sum(n) OVER (PARTITION BY k)::BIGINT AS total, {_RANKED.format(by='k', tie='word_id')} FROM wt) SELECT event, total, rank, token, n FROM t JOIN vocab USING (word_id) WHERE rank <= 20")
def event_top_words(spark, sf_dir):
    """Each event's size in words and its most frequent ones."""
    assigned, vocab = assigned_of(spark, sf_dir)
    best = M.event_report(M.topic_counts(assigned, "word_id"), "word_id", 20)
    return C.decode(best, vocab).select("event", "total", "rank", "token", "n")


@query(f"WITH {ENT}, x AS (SELECT entity_id, (doc_id + rank) % {K} AS k, sum(cnt)::BIGINT AS n FROM de GROUP BY 1, 2), t AS (SELECT k AS event, entity_id, n, sum(n) OVER (PARTITION BY k)::BIGINT AS total, {_RANKED.format(by='k', tie='entity_id')} FROM x) SELECT event, total, rank, value, type, n FROM t JOIN ents USING (entity_id) WHERE rank <= 20")
def event_top_entities(spark, sf_dir):
    """Each event's size in mentions and its most mentioned entities; a mention's event is (doc + rank) mod K here."""
    entities, top = top_entities(spark, sf_dir)
    counts = top.groupBy("entity_id", F.pmod(F.col("doc_id") + F.col("rank"), F.lit(K)).alias("k")).agg(F.sum("cnt").alias("n"))
    best = M.event_report(counts, "entity_id", 20).join(entities.select("entity_id", "value", "type"), "entity_id")
    return best.select("event", "total", "rank", "value", F.col("type").cast("long").alias("type"), "n")


@query(
    f"""WITH {ENT}, b AS (SELECT doc_id, k, sum(n)::BIGINT AS n FROM (SELECT doc_id, z AS k, count(*) AS n FROM a GROUP BY 1, 2 UNION ALL SELECT doc_id, (doc_id + rank) % {K}, sum(cnt) FROM de GROUP BY 1, 2) GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS size, {_RANKED.format(by='doc_id', tie='k')} FROM b) SELECT doc_id, rank, k AS event, n, round((n + 0.1::DOUBLE) / (size + {K} * 0.1::DOUBLE), 9) AS theta FROM t WHERE rank <= 3"""
)
def doc_top_events(spark, sf_dir):
    """Each document's three events with the most words and mentions, and their shares."""
    assigned, _, _, top = entity_assigned(spark, sf_dir)
    mentions = top.select("doc_id", F.pmod(F.col("doc_id") + F.col("rank"), F.lit(K)).alias("z"), F.explode(F.sequence(F.lit(1).cast("long"), "cnt"))).drop("col")
    both = assigned.select("doc_id", "z").unionByName(mentions)
    shares = M.shares(M.topic_vectors(both, "doc_id", K), K, 0.1, "theta")
    cells = shares.select("doc_id", F.inline(F.transform(F.arrays_zip("n", "theta"), lambda x, k: F.struct(k.cast("long").alias("event"), x["n"].alias("n"), x["theta"].alias("theta"))))).filter("n > 0")
    best = M.top(cells, ["doc_id"], F.col("n"), "event", 3)
    return best.select("doc_id", F.col("rank").cast("long").alias("rank"), "event", "n", F.round("theta", 9).alias("theta"))


@query(f"WITH {ENC}, it AS (SELECT unnest(range(3)) AS it), b AS (SELECT it, doc_id, (z + it * pos) % {K} AS k, count(*) AS n FROM a CROSS JOIN it GROUP BY ALL), s AS (SELECT doc_id, count(*) AS size FROM a GROUP BY 1) SELECT doc_id, k, round(sum((coalesce(n, 0) + {ALPHA}::DOUBLE) / (size + {K * ALPHA}::DOUBLE)) / 3, 9) AS theta FROM s CROSS JOIN ks CROSS JOIN it LEFT JOIN b USING (doc_id, k, it) GROUP BY 1, 2")
def theta_sample_mean(spark, sf_dir):
    """Theta averaged over three samples of the chain (here: shifted assignments)."""
    assigned, _ = assigned_of(spark, sf_dir)
    samples = [theta_of(assigned.withColumn("z", F.pmod(F.col("z") + it * F.col("pos"), F.lit(K)))) for it in range(3)]
    return S.sample_mean(samples, "doc_id", "theta").withColumn("theta", F.round("theta", 9))


@query(f"WITH {ENC} SELECT doc_id, string_agg(token || '(' || z || ')', ' ' ORDER BY pos) AS listing FROM a JOIN vocab USING (word_id) GROUP BY 1")
def token_topic_listing(spark, sf_dir):
    assigned, vocab = assigned_of(spark, sf_dir)
    cells = C.decode(assigned, vocab).select("doc_id", "pos", F.format_string("%s(%d)", "token", "z").alias("cell"))
    return cells.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"]), " ").alias("listing"))


@query()
def gibbs_distributed(spark, sf_dir):
    """Topic counts after two approximate distributed sweeps over the whole corpus."""
    assigned, vocab = assigned_of(spark, sf_dir)
    swept = S.distributed_lda(assigned, K, ALPHA, BETA, vocab.count(), sweeps=2, seed=5)
    return M.topic_counts(swept, "word_id")


def _vocabulary(docs):
    return written(C.vocabulary(C.text_counts(docs), 2, 0), "vocabulary")


def _documents(spark, sf_dir, most):
    """Documents that the samplers take, with the `most` entities of each (None: all)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entities = E.entity_set(E.mentions_in(E.mention_lists(docs)), 1, by_mention=True)
    return D.listed(docs, _vocabulary(docs), written(entities, "entities"), most)


def _chain(docs, chain):
    return S.over_documents(docs, [chain]).drop("config")


@query()
def gibbs_lda(spark, sf_dir):
    """Samples of an approximate distributed chain over all documents (the exact chain, `samplers.exact`, is for corpora of one task)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _chain(D.listed(docs, _vocabulary(docs)), S.Chain("lda", topics=4, burn_in=4, lag=2, samples=2, seed=2321))


@query()
def gibbs_entity_v1(spark, sf_dir):
    """Samples of an approximate distributed chain over all documents. A document's entities are the four most mentioned ones in the entity models, as in the reference."""
    return _chain(_documents(spark, sf_dir, TOP), S.Chain("entity_1", topics=4, entity_topics=4, burn_in=10, lag=5, samples=2, seed=1))


@query()
def gibbs_entity_v2(spark, sf_dir):
    """Samples of an approximate distributed chain over all documents."""
    return _chain(_documents(spark, sf_dir, TOP), S.Chain("entity_2", topics=4, entity_topics=4, burn_in=10, lag=5, samples=2, seed=2))


@query()
def gibbs_entity_v3(spark, sf_dir):
    """Samples of an approximate distributed chain over all documents."""
    return _chain(_documents(spark, sf_dir, TOP), S.Chain("entity_3", topics=4, entity_topics=6, burn_in=10, lag=5, samples=2, seed=3))


@query()
def gibbs_event(spark, sf_dir):
    """Samples of an approximate distributed chain over all documents and all entities of each."""
    return _chain(_documents(spark, sf_dir, None), S.Chain("event", topics=4, burn_in=10, lag=5, samples=2, seed=4))


@query()
def gibbs_grid(spark, sf_dir):
    """Words of each topic by configuration: three models of the same corpus in one plan."""
    chains = [S.Chain("lda", topics=k, alpha=a, burn_in=3, lag=1, samples=1, seed=k) for k, a in ((3, 0.1), (5, 0.5))] + [S.Chain("entity_2", topics=4, entity_topics=3, burn_in=3, lag=1, samples=1, seed=9)]
    rows = S.over_documents(_documents(spark, sf_dir, TOP), chains)
    return rows.groupBy("config", "s", "z").agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("n_words"))


_U = "('0x' || substr(md5('77:{sweep}:' || doc_id || ':' || pos), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    f"""WITH {VOCAB}, z AS (SELECT doc_id, pos, word_id, floor((u * 1048576 - floor(u * 1048576)) * 3)::BIGINT AS z, {_U.format(sweep=1)} * (1 - 1 / 1099511627776.0::DOUBLE) AS u FROM (SELECT doc_id, pos, word_id, {_U.format(sweep=0)} AS u FROM toks JOIN vocab USING (token))),
w AS (SELECT word_id, [count(*) FILTER (z = 0), count(*) FILTER (z = 1), count(*) FILTER (z = 2)] AS n FROM z GROUP BY 1), t AS (SELECT [count(*) FILTER (z = 0), count(*) FILTER (z = 1), count(*) FILTER (z = 2)] AS size, count(DISTINCT word_id) AS v FROM z),
f AS (SELECT doc_id, pos, z, u, list_transform(range(1, 4), lambda k: ((n[k] - CASE WHEN z + 1 = k THEN 1 ELSE 0 END)::DOUBLE + 0.01::DOUBLE) / (size[k] + v * 0.01::DOUBLE)) AS a FROM z JOIN w USING (word_id), t),
d AS (SELECT doc_id, list({{'z': z, 'u': u, 'a': a, 'own': []::DOUBLE[], 'out': []::BIGINT[]}} ORDER BY pos) AS l, [count(*) FILTER (z = 0), count(*) FILTER (z = 1), count(*) FILTER (z = 2)]::DOUBLE[] AS own FROM f GROUP BY 1),
s AS (SELECT doc_id, list_reduce(list_prepend({{'z': 0::BIGINT, 'u': 0.0::DOUBLE, 'a': []::DOUBLE[], 'own': own, 'out': []::BIGINT[]}}, l), lambda acc, x:
  list_transform(list_transform(list_transform([list_transform(acc.own, lambda o, k: o - CASE WHEN x.z + 1 = k THEN 1 ELSE 0 END)], lambda less: {{'less': less, 'w': list_transform(less, lambda o, k: x.a[k] * (o + 0.1::DOUBLE))}}),
    lambda q: {{'less': q.less, 's1': q.w[1], 's2': q.w[1] + q.w[2], 's3': q.w[1] + q.w[2] + q.w[3]}}), lambda q: {{'z': 0::BIGINT, 'u': 0.0::DOUBLE, 'a': []::DOUBLE[],
      'own': list_transform(q.less, lambda o, k: o + CASE WHEN k - 1 = (q.s1 <= x.u * q.s3)::BIGINT + (q.s2 <= x.u * q.s3)::BIGINT THEN 1 ELSE 0 END), 'out': list_append(acc.out, (q.s1 <= x.u * q.s3)::BIGINT + (q.s2 <= x.u * q.s3)::BIGINT)}})[1]).out AS out FROM d)
SELECT doc_id, len(out) AS n, md5(array_to_string(out, ',')) AS topics FROM s"""
)
def gibbs_sweep(spark, sf_dir):
    """One sweep of the distributed sampler over the whole corpus, its draws from md5: each document's topics in order."""
    chain = S.Chain("lda", topics=3, burn_in=1, lag=1, samples=1, seed=77, hashed=True)
    vocab = written(vocabulary_of(spark, sf_dir), "vocabulary")
    rows = S.distributed(C.encode(tokens_of(spark, sf_dir), vocab), None, chain)
    inside = F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda x: x["z"])  # of one document
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(inside, ",")).alias("topics"))
