"""Readers and scalar functions over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import html as H
from ..sources import readers as R
from .registry import query, table


def docs_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("WITH l AS (SELECT doc_id, coalesce(string_split(text, chr(10))[4], '') AS t FROM documents) SELECT doc_id, CASE WHEN instr(t, '-') BETWEEN 2 AND 30 THEN substr(t, instr(t, '-') + 1) ELSE t END AS text FROM l")
def dateline_strip(spark, sf_dir):
    return R.news_article(docs_of(spark, sf_dir))


@query("SELECT doc_id, coalesce(string_split(text, chr(10))[2], '') AS text FROM documents")
def second_line(spark, sf_dir):
    return R.titled_article(docs_of(spark, sf_dir))


@query("SELECT doc_id, length(regexp_replace(regexp_replace(text, '\\r?\\n', ' ', 'g'), ' $', '')) AS n, md5(regexp_replace(regexp_replace(text, '\\r?\\n', ' ', 'g'), ' $', '')) AS digest FROM documents")
def whole_text(spark, sf_dir):
    return R.whole_text(docs_of(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("WITH p AS (SELECT page_id, list_filter(string_split(html, '{'), lambda x: x <> '') AS l FROM pages) SELECT page_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ord FROM p")
def brace_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return R.split_documents(pages, "page_id").select("page_id", F.col("ord").cast("long").alias("ord"), "text")


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS a, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS b FROM pages)
SELECT page_id, coalesce(a[1], '') AS first_item, len(a) AS items, lower(coalesce(b[1], '')) AS title FROM p"""
)
def paired_tag_split(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", T.between_tags(F.col("html"), "li").alias("a"), T.between_tags(F.col("html"), "h1").alias("b"))
    return p.select("page_id", F.coalesce(F.get("a", F.lit(0)), F.lit("")).alias("first_item"), F.size("a").cast("long").alias("items"), F.lower(F.coalesce(F.get("b", F.lit(0)), F.lit(""))).alias("title"))


@query("WITH d AS (SELECT doc_id, text, coalesce(nullif(instr(text, ' the '), 0), nullif(instr(text, ' and '), 0)) AS cut FROM documents) SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, cut - 1) END AS text FROM d")
def marker_cut(spark, sf_dir):
    return docs_of(spark, sf_dir).withColumn("text", T.before_marker(F.col("text"), " the ", " and "))


@query(
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, unnest(range(len(l) // 3)) AS record FROM l) SELECT doc_id, record, l[record * 3 + 1] AS first, l[record * 3 + 3] AS last FROM r"
)
def line_records(spark, sf_dir):
    """Lines in records of three."""
    return R.records(docs_of(spark, sf_dir), "doc_id", 3).select("doc_id", F.col("record").cast("long").alias("record"), F.col("fields")[0].alias("first"), F.col("fields")[2].alias("last"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def href_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, string_split(url, '/')[-1] AS file FROM pages")
def html_title_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), T.file_name(F.col("url")).alias("file"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '&#8217;|’', '''', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM b"""
)
def html_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.plain_text(F.col("html"))).alias("digest"))


@query(
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>', 1) AS tags, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1) AS links, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heads FROM pages),
n AS (SELECT *, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS ord FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY ord) AS i FROM n WHERE tag IN ('a', 'h1')),
t AS (SELECT page_id, ord, tag, CASE WHEN tag = 'a' THEN hrefs[i] END AS href, CASE WHEN tag = 'a' THEN links[i] ELSE heads[i] END AS raw FROM k)
SELECT page_id, ord, tag, href, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t"""
)
def html_nodes(spark, sf_dir):
    """Links and headings of all pages by a parser."""
    nodes = H.html_nodes(table(spark, sf_dir, "pages"), ("a", "h1"))
    wanted = nodes.filter((H.has_tag("a") & H.has_attribute("href")) | H.has_tag("h1"))
    return wanted.select("page_id", "ord", "tag", F.element_at("attributes", "href").alias("href"), "text")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND length(html) > 1700")
def url_prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("url").startswith("https://") & (F.length("html") > 1700)).select("page_id", "url")


@query("SELECT page_id FROM pages ANTI JOIN (SELECT url FROM pages WHERE page_id % 3 = 0) USING (url)")
def collected_exclusion(spark, sf_dir):
    """Pages whose url has not been collected yet."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(pages.filter("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id")


@query("SELECT DISTINCT lower(unnest(string_split(text, chr(10)))) AS line FROM conversations")
def unique_lines(spark, sf_dir):
    """Distinct lines in lower case."""
    return table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("line")).select(F.lower("line").alias("line")).distinct()


@query(
    r"""WITH p AS (SELECT doc_id, text, substr(text, instr(text, '-') + 1) AS after, list_transform(string_split(text, ','), lambda x: trim(x)) AS tags FROM documents)
SELECT doc_id, lower(string_split(text, ' ')[1]) AS first, length(after) AS n_after, md5(after) AS after_digest, len(tags) AS n_tags, md5(array_to_string(tags, '|')) AS tags_digest FROM p"""
)
def text_pieces_whole(spark, sf_dir):
    """First word, text after the first hyphen and comma tags of whole texts; wide pieces by length or count, and digest."""
    d = docs_of(spark, sf_dir).select("doc_id", T.first_word(F.col("text")).alias("first"), T.after_hyphen(F.col("text")).alias("after"), T.comma_tags(F.col("text")).alias("tags"))
    return d.select("doc_id", "first", F.length("after").cast("long").alias("n_after"), F.md5("after").alias("after_digest"), F.size("tags").cast("long").alias("n_tags"), F.md5(F.array_join("tags", "|")).alias("tags_digest"))


@query("SELECT p_partkey, printf('%15s(%d)', p_brand, p_size) AS report, '<part><name>' || replace(replace(replace(p_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name><size>' || p_size || '</size></part>' AS xml FROM (SELECT *, p_name AS name FROM part)")
def formatted_rows(spark, sf_dir):
    from ..sources.sinks import xml_rows

    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return part.select("p_partkey", F.format_string("%15s(%d)", "p_brand", "p_size").alias("report"), xml_rows(part, "part", ["name", "size"]).alias("xml"))
