"""The registered queries of this subpackage: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .jaccard_join import jaccard_groups
from .line_dedup import line_dedup
from .lm_score import likelihoods
from .mixing import MIX_SQL, mix_report
from .secrets import secret_spans
from .shared import fresh_path
from .sort_means import clusters
from .spelling import spelling_variants
from .token_counts import token_counts
from .token_files import token_file_digest, write_token_files
from .toxicity import toxicity_scores
from .url_rules import judge_urls
from .vector_graph import vector_groups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sources mixed to 98 % of the largest entropy, at most four passes, within as many tokens as there are."""
    return mix_report(table(spark, sf_dir, "documents"))


def op2_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all embeddings that nearly coincide."""
    return vector_groups(table(spark, sf_dir, "embeddings")).drop("audit_recall")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of all documents."""
    return likelihoods(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from a cache that starts empty (a cache kept between runs would hide the work)."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ORC files of token ids, read back."""
    out = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_digest(spark, out)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by their shingle sets."""
    return jaccard_groups(table(spark, sf_dir, "documents")).drop("class")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that three or more of them share, but for the last document of each."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings."""
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all documents' words."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op10_jaccard_join: all pairs that share a shingle, and the components of their links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""

#: DuckDB SQL for op2_vector_graph: all pairs of a label by cosine.
VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1) USING (vec_id)
"""


#: DuckDB SQL for op11_line_dedup: counts of all keys, and each document's lines put together again.
LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, x.i, x.line FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, i: {'i': i, 'line': s})) AS x FROM documents)
), k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (SELECT k.doc_id, i, line, r.key IS NOT NULL AND k.doc_id <> r.last AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def _means_sql(k: int = 8, rounds: int = 10) -> str:
    """DuckDB SQL for op12_sort_means: all distances in every round."""
    with_all = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p FROM (SELECT sha256('3:' || vec_id) AS h, p FROM v ORDER BY h, p LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        with_all.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, p, min(d)[1] AS d, min(d)[2] AS c FROM (
  SELECT v.vec_id, v.p, [list_sum(list_transform(list_zip(v.p, c{i}.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c{i}.c] AS d FROM v, c{i}) GROUP BY vec_id, p)"""
        )
        if i < rounds:
            with_all.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.p, c{i}.p) AS p FROM c{i} LEFT JOIN (
  SELECT c, list(q ORDER BY j) AS p FROM (SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q
    FROM (SELECT c, unnest(range(64)) AS j, unnest(p) AS x FROM a{i}) GROUP BY c, j) GROUP BY c) m ON m.c = c{i}.c)"""
            )
    return f"""WITH {", ".join(with_all)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""


#: DuckDB SQL for op13_spelling: crc32 by its table over UTF-8 bytes, and all pairs that share a wildcard or a deletion.
SPELLING_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY 1, 2
), h AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || w, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)::BIGINT] ELSE [192 | (ord(s) >> 6), 128 | (ord(s) & 63)] END))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, t
), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), e AS MATERIALIZED (
  SELECT DISTINCT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS wild, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word)))::INTEGER AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM e a JOIN e b ON a.wild = b.wild AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.less = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.less = v.word
), best AS MATERIALIZED (
  SELECT v.word, v.n, count(other) AS n_near, CASE WHEN max(near.n) >= 5 * v.n THEN min({'a': -near.n, 'b': other}).b END AS form, CASE WHEN max(near.n) >= 5 * v.n THEN max(near.n) END AS form_n
  FROM v LEFT JOIN near USING (word) GROUP BY v.word, v.n
), r AS (SELECT word, word AS root, form AS next FROM best UNION ALL SELECT r.word, best.word, best.form FROM r JOIN best ON r.next = best.word)
SELECT word, best.form, root, best.n, n_near, form_n FROM r JOIN best USING (word) WHERE next IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mix, op2_vector_graph, op3_lm_score, op4_url_rules, op5_secret_spans, op6_decontaminate, op7_token_counts, op8_toxicity, op9_token_files, op10_jaccard_join, op11_line_dedup, op12_sort_means, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": MIX_SQL, "op2_vector_graph": VECTOR_SQL, "op10_jaccard_join": JACCARD_SQL, "op11_line_dedup": LINE_SQL, "op12_sort_means": _means_sql(), "op13_spelling": SPELLING_SQL}
