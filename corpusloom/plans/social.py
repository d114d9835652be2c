"""Contact, call, search and tag queries over the stand-in tables: customers are contacts, events are calls and searches, parts of an order are its tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from ..operators import contacts as K
from ..operators import shares as H
from ..operators import social as S
from ..operators import text_index as I
from ..sources.shared import fresh_path, written
from .registry import query, table

_ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
CALLS = "calls AS (SELECT event_id AS id, user_id AS caller, (user_id * 7 + event_id) % 50 AS callee, event_type, epoch_us(ts) // 1000 AS at, floor(value)::BIGINT AS seconds FROM events)"
EDGES = CALLS + ", edges AS (SELECT caller AS src, callee AS dst, count(*) AS calls, sum(seconds / 60.0::DOUBLE) AS minutes FROM calls WHERE caller <> callee GROUP BY 1, 2)"
BOTH = EDGES + ", both_ways AS (SELECT src, dst, sum(calls)::BIGINT AS calls, sum(minutes) AS minutes FROM (FROM edges UNION ALL SELECT dst, src, calls, minutes FROM edges) GROUP BY 1, 2), w AS (SELECT *, (0.3::DOUBLE * minutes + 0.7::DOUBLE * calls) / 220.0::DOUBLE AS weight FROM both_ways)"
TAGS = "tags AS (SELECT DISTINCT l_orderkey AS grp, unnest([p_brand, p_type]) AS tag FROM lineitem JOIN part ON l_partkey = p_partkey), pairs AS (SELECT a.tag, b.tag AS related_tag, count(*) AS value FROM tags a JOIN tags b ON a.grp = b.grp AND a.tag < b.tag GROUP BY 1, 2), cooc AS (SELECT tag, related_tag AS other, value AS n FROM pairs UNION ALL SELECT related_tag, tag, value FROM pairs)"
ROWS = """eav AS (SELECT c_custkey AS raw_id, 'name' AS mimetype, split_part(c_name, '#', 1) AS data1, CASE WHEN c_custkey % 3 = 0 THEN '' END AS data2, CASE WHEN c_custkey % 11 <> 0 THEN split_part(c_name, '#', 2) END AS data3 FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey, 'phone', '0' || c_nationkey || '-' || c_custkey % 40, NULL, NULL FROM customer UNION ALL SELECT c_custkey, 'group', c_mktsegment, NULL, NULL FROM customer WHERE c_acctbal > 0
UNION ALL SELECT c_custkey, 'job', c_mktsegment, '', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT DISTINCT o_custkey, 'tag', o_orderpriority, NULL, NULL FROM orders)"""
SEARCHES = "searches AS (SELECT event_type || '_' || floor(value)::BIGINT % 40 AS query, user_id, n_name AS city FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey), times AS (SELECT query, city, count(*) AS times FROM searches GROUP BY 1, 2)"


def calls_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("caller"), ((F.col("user_id") * 7 + F.col("event_id")) % 50).alias("callee"), "event_type", F.expr(_ms).alias("at"), F.floor("value").alias("seconds")
    )


def edges_of(spark, sf_dir):
    return S.friend_edges(calls_of(spark, sf_dir).filter("caller <> callee"), "caller", "callee", "seconds")


def tag_lists_of(spark, sf_dir):
    """(grp, tags): brands and types of each order's parts, each once, in order. Items go to their order as they are, once."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("p_partkey"))
    dealt = items.join(parts, "p_partkey").select("grp", "p_brand", "p_type").repartition("grp")
    return dealt.groupBy("grp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("p_brand", "p_type"))))).alias("tags"))  # an order's items


def tags_of(spark, sf_dir):
    """(grp, tag): brands and types of each order's parts, each once."""
    return tag_lists_of(spark, sf_dir).select("grp", F.explode("tags").alias("tag"))


def pairs_of(spark, sf_dir):
    return S.list_pairs(tag_lists_of(spark, sf_dir), "tags")


def rows_of(spark, sf_dir):
    """Entity rows of customers."""
    c, null = table(spark, sf_dir, "customer"), F.lit(None).cast("string")
    key, data = F.col("c_custkey").alias("raw_id"), ("data1", "data2", "data3", "data4")

    def kind(df, name, *values):
        values = [*values, *[null] * (4 - len(values))]
        return df.select(key if "c_custkey" in df.columns else F.col("o_custkey").alias("raw_id"), F.lit(name).alias("mimetype"), *(v.cast("string").alias(d) for v, d in zip(values, data, strict=True)))

    parts = F.split("c_name", "#")
    names = kind(c.filter("c_custkey % 7 <> 0"), "name", parts[0], F.when(F.col("c_custkey") % 3 == 0, ""), F.when(F.col("c_custkey") % 11 != 0, parts[1]))
    phones = kind(c, "phone", F.concat(F.lit("0"), F.col("c_nationkey"), F.lit("-"), F.col("c_custkey") % 40))
    groups = kind(c.filter("c_acctbal > 0"), "group", F.col("c_mktsegment"))
    jobs = kind(c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "job", F.col("c_mktsegment"), F.lit(""), F.col("n_name"))
    tags = kind(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct(), "tag", F.col("o_orderpriority"))
    return names.unionByName(phones).unionByName(groups).unionByName(jobs).unionByName(tags)


def searches_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.floor("value") % 40).cast("string")).alias("query"), "user_id")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return e.join(c, F.col("user_id") == F.col("c_custkey")).select("query", "user_id", F.col("n_name").alias("city"))


def shared_of(spark, sf_dir):
    """Contacts with labels (device, label) from their orders and one group."""
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct((F.col("o_orderkey") % 97).alias("device_id"), F.col("o_orderpriority").alias("label")).alias("x"))
    lists = labels.groupBy("id").agg(F.collect_set("x").alias("labels"))
    c = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    group = F.when(F.col("c_acctbal") > 0, F.array(F.struct(F.col("c_nationkey").alias("device_id"), F.col("c_mktsegment").alias("label"))))
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 == 0).alias("is_public"), group.alias("groups")).join(lists, "id", "left")


@query(f"WITH {CALLS}, m AS (SELECT a.id, b.id AS other, abs(a.at - b.at) AS apart FROM calls a JOIN calls b ON a.event_type = b.event_type AND a.id <> b.id AND b.at BETWEEN a.at - 60000 AND a.at + 60000) SELECT id, arg_min(other, (apart, other)) AS other, min(apart) AS apart FROM m GROUP BY 1")
def call_interval_join(spark, sf_dir):
    return S.interval_pairs(calls_of(spark, sf_dir), ["event_type"], tolerance=60_000)


@query("SELECT event_id, c_name AS name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 = 0")
def call_lookup(spark, sf_dir):
    """Each call's contact, null where it is unknown."""
    known = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "events").join(known, "user_id", "left").select("event_id", "name")


@query(f"WITH {EDGES} SELECT src, dst, calls, round(minutes, 6) AS minutes FROM edges")
def friend_edges(spark, sf_dir):
    return edges_of(spark, sf_dir).withColumn("minutes", F.round("minutes", 6))


@query(f"WITH {BOTH} SELECT src, dst, calls, round(weight, 8) AS weight FROM w")
def friend_weight(spark, sf_dir):
    return S.weights(S.both_ways(edges_of(spark, sf_dir))).select("src", "dst", "calls", F.round("weight", 8).alias("weight"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def contact_filter(spark, sf_dir):
    return K.look_up(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3).select("c_custkey", "c_name")


@query("SELECT o_custkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT')")
def label_membership(spark, sf_dir):
    labels = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("labels"))
    city = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return labels.join(city, "o_custkey").filter(F.array_contains("labels", "1-URGENT")).select(F.col("o_custkey").alias("id"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDG%'")
def substring_match(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%WIDG%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'small')")
def full_text_match(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.array_contains(F.split(F.lower("p_name"), " "), "small")).select("p_partkey")


_RUNS = "runs AS (SELECT doc_id, lower(unnest(l)) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[$a-zA-Z0-9]+') AS l FROM documents))"


@query(
    f"""WITH {_RUNS} SELECT 'all' AS kind, doc_id FROM runs WHERE w IN ('that', 'with', 'from') GROUP BY doc_id HAVING count(DISTINCT w) = 3
UNION ALL SELECT 'any', doc_id FROM runs WHERE w IN ('keit', 'pour') GROUP BY doc_id UNION ALL SELECT 'prefix', doc_id FROM runs WHERE starts_with(w, 'keit') GROUP BY doc_id
UNION ALL SELECT 'phrase', a.doc_id FROM runs a JOIN runs b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN runs c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.w = 'and' AND b.w = 'the' AND c.w = 'and' GROUP BY a.doc_id
UNION ALL SELECT 'phrase', a.doc_id FROM runs a JOIN runs b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.w = 'is' AND b.w = 'the' GROUP BY a.doc_id"""
)
def full_text_index(spark, sf_dir):
    """Documents found through an index of words and positions: all of some words, any of some, a prefix, and two phrases."""
    index = I.WordIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "word-index"))
    found = [("all", index.all_of("that", "With", "from")), ("any", index.any_of("keit", "pour")), ("prefix", index.prefix("Keit")), ("phrase", index.phrase("and", "the", "and")), ("phrase", index.phrase("is", "the"))]
    return reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind"), F.col("key").alias("doc_id")) for kind, rows in found))


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example.org/fr/')")
def substring_index(spark, sf_dir):
    """Pages whose url holds a string, found through an index of runs of three characters."""
    index = I.SubstringIndex.build(table(spark, sf_dir, "pages"), fresh_path(spark, "gram-index"), "page_id", "url")
    return index.contains("Example.org/FR/").select(F.col("key").alias("page_id"))


@query(
    """WITH l AS (SELECT o_custkey AS id, bool_or(o_orderkey % 97 = 13) AS tagged FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(c_custkey % 5 = 0 OR tagged OR (c_acctbal > 0 AND ((c_nationkey = 3 AND c_mktsegment = 'BUILDING') OR (c_nationkey = 7 AND c_mktsegment = 'FURNITURE'))), false) AS visible FROM customer LEFT JOIN l ON id = c_custkey"""
)
def visibility_filter(spark, sf_dir):
    """Which contacts device 13 sees, labelled (3, BUILDING) and (7, FURNITURE) itself."""
    mine = F.array(*(F.struct(F.lit(d).cast("long").alias("device_id"), F.lit(t).alias("label")) for d, t in ((3, "BUILDING"), (7, "FURNITURE"))))
    seen = K.visible_to(F.col("is_public"), F.col("labels"), F.col("groups"), F.lit(13).cast("long"), mine)
    return shared_of(spark, sf_dir).select("id", seen.alias("visible"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 97 = 13")
def tagged_by_device(spark, sf_dir):
    return shared_of(spark, sf_dir).filter(K.tagged_by(F.col("labels"), F.lit(13).cast("long"))).select("id")


@query(
    f"""WITH {ROWS}, n AS (SELECT raw_id, trim(concat_ws(' ', nullif(data1, ''), nullif(data2, ''), nullif(data3, ''))) AS name FROM eav WHERE mimetype = 'name'),
l AS (SELECT raw_id, mimetype, string_agg(data1, ',' ORDER BY data1) AS v FROM eav WHERE mimetype IN ('phone', 'tag', 'group') GROUP BY 1, 2)
SELECT n.raw_id, name, coalesce(p.v, '') AS phones, coalesce(t.v, '') AS tags, coalesce(g.v, '') AS groups FROM n LEFT JOIN l p ON p.raw_id = n.raw_id AND p.mimetype = 'phone' LEFT JOIN l t ON t.raw_id = n.raw_id AND t.mimetype = 'tag' LEFT JOIN l g ON g.raw_id = n.raw_id AND g.mimetype = 'group' WHERE length(name) > 0"""
)
def eav_pivot(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return K.contacts_of(rows_of(spark, sf_dir)).select("raw_id", "name", joined("phones"), joined("tags"), joined("groups"))


@query(f"WITH {ROWS}, s AS (SELECT raw_id, mimetype, CASE mimetype WHEN 'name' THEN trim(concat_ws(' ', nullif(data1, ''), nullif(data2, ''), nullif(data3, ''))) WHEN 'job' THEN trim(concat_ws(chr(10), nullif(data1, ''), nullif(data2, ''), nullif(data3, ''))) ELSE coalesce(data1, '') END AS shown FROM eav) SELECT raw_id, mimetype, string_agg(shown, '|' ORDER BY shown) AS entities FROM s WHERE shown <> '' GROUP BY 1, 2")
def eav_entity_lists(spark, sf_dir):
    return K.entity_lists(rows_of(spark, sf_dir)).select("raw_id", "mimetype", F.array_join("entities", "|").alias("entities"))


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def first_raw_per_contact(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return K.first_per_key(rows, "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_partkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON replace('0' || s_nationkey || '-' || s_suppkey % 40, '-', '') = replace('0' || c_nationkey || '-' || c_custkey % 40, '-', '')")
def phone_normalise_join(spark, sf_dir):
    number = lambda nation, key: T.phone(F.concat(F.lit("0"), F.col(nation), F.lit("-"), F.col(key) % 40)).alias("number")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", number("s_nationkey", "s_suppkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", number("c_nationkey", "c_custkey"))
    return s.join(c, "number").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (c_custkey)")
def no_group_anti_join(spark, sf_dir):
    """Contacts in no group: here, without an urgent order."""
    grouped = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(grouped, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def contact_semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, n_name AS grp FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def group_join(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("grp"))
    return table(spark, sf_dir, "customer").join(groups, "c_nationkey", "left").select("c_custkey", "grp")


@query(f"WITH {TAGS} SELECT tag, related_tag, value FROM pairs")
def token_cooccurrence_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)


@query(f"WITH {TAGS} SELECT tag, string_agg(other || ',' || n, ',' ORDER BY other) AS cooccur FROM cooc GROUP BY 1")
def cooccurrence_map(spark, sf_dir):
    return S.co_occurrence_map(pairs_of(spark, sf_dir))


_MINE = ("Brand#13", "ECONOMY")


@query(
    f"""WITH {TAGS}, stats AS (SELECT tag, count(*) AS freq FROM tags GROUP BY 1), freq AS (SELECT tag, freq AS times FROM stats WHERE freq % 3 = 0), p AS (SELECT cooc.tag, other AS c, n / freq AS p FROM cooc JOIN stats USING (tag)),
names AS (SELECT c FROM p WHERE tag IN {_MINE} UNION SELECT tag FROM freq), s AS (SELECT c, sum(x) AS s FROM (SELECT c, 0.75::DOUBLE * p AS x FROM p WHERE tag IN {_MINE} UNION ALL SELECT c, 0.25::DOUBLE * p FROM p JOIN freq USING (tag)) GROUP BY 1)
SELECT c AS tag, round(coalesce(s, 0), 9) AS score FROM names LEFT JOIN s USING (c) WHERE c NOT IN {_MINE} ORDER BY score DESC, tag LIMIT 15"""
)
def tag_suggestion(spark, sf_dir):
    """The 15 best suggestions beside two tags; every third tag by count is a frequent one."""
    tags = tags_of(spark, sf_dir)
    stats = tags.groupBy("tag").agg(F.count("*").alias("freq"))
    frequent = stats.filter("freq % 3 = 0").select("tag", F.col("freq").alias("times"))
    mine = spark.createDataFrame([(t,) for t in _MINE], "tag string")
    return S.suggestions(mine, stats, S.co_occurrence(S.tag_pairs(tags, "grp", "tag")), frequent).withColumn("score", F.round("score", 9))


_REL = TAGS + """, labels AS (SELECT DISTINCT o_custkey AS id, tag AS label FROM orders JOIN tags ON grp = o_orderkey), terms(term) AS (VALUES ('ECONOMY'), ('Brand#5')),
x AS (SELECT id, 2000.0::DOUBLE AS x FROM labels JOIN terms ON label = term UNION ALL SELECT id, n::DOUBLE FROM labels JOIN cooc ON label = other JOIN terms ON cooc.tag = term WHERE label <> term UNION ALL SELECT id, (3 * n)::DOUBLE FROM labels JOIN cooc ON label = cooc.tag JOIN terms ON other = term),
rel AS (SELECT id, sum(x) / 2000 AS r FROM x GROUP BY 1)"""


def relatedness_of(spark, sf_dir):
    lists = written(tag_lists_of(spark, sf_dir), "tag-lists")
    pairs = written(S.list_pairs(lists, "tags"), "tag-pairs")
    labels = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("grp")).join(lists, "grp").select("id", F.explode("tags").alias("label"))
    terms = spark.createDataFrame([("ECONOMY",), ("Brand#5",)], "term string")
    return S.relatedness(labels, terms, S.co_occurrence(pairs), pairs)


@query(f"WITH {_REL} SELECT id, round(r, 6) AS r FROM rel")
def search_relatedness(spark, sf_dir):
    return relatedness_of(spark, sf_dir).withColumn("r", F.round("r", 6))


@query(
    f"""WITH {_REL}, {BOTH}, f AS (SELECT dst AS friend, weight FROM w WHERE src = 1), l AS (SELECT friend, id, sum(l) AS l FROM (SELECT DISTINCT o_orderkey % 50 AS friend, o_custkey AS id, 1.0::DOUBLE AS l FROM orders UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2 HAVING sum(l) > 0),
s AS (SELECT id, sum(weight * l) AS s, string_agg(friend::VARCHAR, ',' ORDER BY friend) AS people FROM l JOIN f USING (friend) GROUP BY 1)
SELECT id, round(r * CASE WHEN coalesce(s, 0) = 0 THEN 0.001::DOUBLE ELSE s END, 8) AS score, coalesce(people, '') AS people FROM rel LEFT JOIN s USING (id)"""
)
def social_rank(spark, sf_dir):
    """Search results of user 1: relatedness times the friends' links."""
    w = written(S.weights(S.both_ways(edges_of(spark, sf_dir))), "friend-weights")
    friends = w.filter("src = 1").select(F.col("dst").alias("friend"), "weight")
    tagged = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("friend"), F.col("o_custkey").alias("id"))
    back = w.select(F.col("src").alias("id"), F.col("dst").alias("friend"), "weight")
    return S.social_rank(relatedness_of(spark, sf_dir), friends, tagged, back).withColumn("score", F.round("score", 8))


@query(f"WITH {SEARCHES} SELECT city, rank, query, times FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY times DESC, query) AS rank FROM times) WHERE rank <= 18")
def top_queries_per_city(spark, sf_dir):
    times = searches_of(spark, sf_dir).groupBy("query", "city").agg(F.count("*").alias("times"))
    return S.top_per_group(times, "city", 18, "query").select("city", F.col("rank").cast("long").alias("rank"), "query", "times")


@query(
    f"""WITH {SEARCHES}, mine AS (SELECT query, count(*) - 1 AS times FROM searches WHERE user_id % 10 = 7 GROUP BY 1), l AS (SELECT * FROM mine ORDER BY times DESC, query LIMIT 6), p AS (SELECT query, sum(times)::BIGINT AS times FROM times ANTI JOIN l USING (query) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 18)
SELECT query, source, rank FROM (SELECT query, source, row_number() OVER (ORDER BY source, times DESC, query) AS rank FROM (SELECT *, 'local' AS source FROM l UNION ALL SELECT *, 'public' FROM p)) WHERE rank <= 18"""
)
def top_queries_union(spark, sf_dir):
    """Six local queries (their counter starts at 0), then public ones."""
    searches = searches_of(spark, sf_dir)
    nothing = searches.limit(0).select("query", F.lit(0).cast("long").alias("times"))
    local = K.count_up(nothing, searches.filter("user_id % 10 = 7"), ["query"], first=0)
    public = searches.groupBy("query").agg(F.count("*").alias("times"))
    return S.merged_queries(local, public).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TAGS} SELECT tag, count(*) AS times FROM tags GROUP BY 1 ORDER BY times DESC, tag LIMIT 25")
def frequent_tags(spark, sf_dir):
    return tags_of(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "tag").limit(25)


@query("SELECT o_custkey AS contact, max(o_orderkey % 1000) AS times FROM orders GROUP BY 1 HAVING max(o_orderkey % 1000) > 0 ORDER BY 2 DESC, 1 LIMIT 5")
def frequent_contacts_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("contact")).agg(F.max(F.col("o_orderkey") % 1000).alias("times"))
    return rows.filter("times > 0").orderBy(F.desc("times"), "contact").limit(5)


_SECTION = "CASE WHEN ascii(upper(name[1])) BETWEEN 65 AND 90 THEN upper(name[1]) ELSE '#' END"


@query(
    f"""WITH n AS (SELECT doc_id AS id, string_split(text, ' ')[1] AS name FROM documents), s AS (SELECT *, {_SECTION} AS section FROM n), o AS (SELECT *, CASE WHEN section = '#' THEN 2 ELSE 1 END AS section_rank, row_number() OVER (PARTITION BY section ORDER BY lower(name), name, id) AS item FROM s),
z AS (SELECT section, section_rank, sum(count(*) + 1) OVER (ORDER BY section_rank, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM o GROUP BY 1, 2)
SELECT id, section, item, (coalesce(start, 0) + item)::BIGINT AS position FROM o JOIN z USING (section)"""
)
def name_sections(spark, sf_dir):
    """First words of documents as a sectioned list with headers."""
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", " ", 1).alias("name"))
    return K.in_sections(names).select("id", "section", F.col("item").cast("long").alias("item"), F.col("position").cast("long").alias("position"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return K.last_wins(orders, "o_custkey", "at", "o_orderkey", "o_orderstatus")


@query(
    """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS city, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS address FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'new ' || c_name END AS name, c_nationkey + 100 AS city, c_mktsegment AS address FROM customer WHERE c_custkey % 3 = 0)
SELECT id, coalesce(n.name, o.name) AS name, coalesce(o.city, n.city) AS city, coalesce(n.address, o.address) AS address FROM o FULL JOIN n USING (id)"""
)
def share_merge(spark, sf_dir):
    """Shared contacts merged by key: only known fields are taken over, and the city never changes."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("city"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("address"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("new "), F.col("c_name"))).alias("name"), (F.col("c_nationkey") + 100).alias("city"), F.col("c_mktsegment").alias("address"))
    return K.upsert(old, new, ["id"], fixed=("city",))


@query(
    f"""WITH {SEARCHES}, old AS (SELECT query, city, count(*) AS times FROM searches WHERE user_id % 2 = 0 GROUP BY 1, 2), seen AS (SELECT query, city, count(*) AS n FROM searches WHERE user_id % 2 = 1 GROUP BY 1, 2)
SELECT query, city, coalesce(times, 0) + coalesce(n, 0) AS times FROM old FULL JOIN seen USING (query, city)"""
)
def upsert_counter(spark, sf_dir):
    searches = searches_of(spark, sf_dir)
    old = searches.filter("user_id % 2 = 0").groupBy("query", "city").agg(F.count("*").alias("times"))
    return K.count_up(old, searches.filter("user_id % 2 = 1"), ["query", "city"])


@query(
    """WITH t AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS grp FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM (SELECT id, CASE WHEN id % 10 = 0 THEN 'changed' ELSE name END AS name, grp FROM t WHERE id % 6 <> 0 OR id % 10 = 0 UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 1 AND c_custkey % 2 = 1) WHERE grp <> 'MACHINERY'"""
)
def batch_operations(spark, sf_dir):
    """Updates, deletes and inserts collected and applied together, then a group deleted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"))
    old = c.filter("id % 2 = 0")
    changes = K.ChangeSet(["id", "name", "grp"])
    part = old.filter("id % 10 = 0")
    changes.update(part, part.withColumn("name", F.lit("changed")))
    changes.remove(changes.delete(old))
    changes.delete(old.filter("id % 6 = 0"))
    changes.insert(c.filter("id % 5 = 1 AND id % 2 = 1"))
    return K.delete_where(changes.apply(old), F.col("grp") == "MACHINERY")


@query("SELECT o_custkey AS id, string_agg(p || ',', '' ORDER BY p) AS labels, '[' || string_agg(p || '*', '' ORDER BY p) || ']' AS stars FROM (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) GROUP BY 1")
def label_strings(spark, sf_dir):
    """Label lists as text, there and back and again."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l"))
    stars = T.to_star_list(F.col("l"))
    return lists.select("id", T.comma_list(T.star_list(stars)).alias("labels"), stars.alias("stars"))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def candidate_union(spark, sf_dir):
    """Contacts with any of two labels, less those of one city."""
    o = table(spark, sf_dir, "orders")
    sets = [o.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("id")) for p in ("1-URGENT", "5-LOW")]
    return sets[0].unionByName(sets[1]).distinct().join(table(spark, sf_dir, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("id")), "id", "left_anti")


@query("SELECT event_id, round(value / 60.0::DOUBLE, 8) AS minutes, strftime(ts, '%Y%m%d%H%M%S') AS at FROM events WHERE value > 0 AND ts > TIMESTAMP '2024-01-10 00:00:00' AND event_type IN ('error', 'signup')")
def incremental_scan(spark, sf_dir):
    """Events of two types after a mark, with a duration: the next upload."""
    e = table(spark, sf_dir, "events")
    new = e.filter((F.col("value") > 0) & (F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")) & F.col("event_type").isin("error", "signup"))
    return new.select("event_id", F.round(T.minutes(F.col("value")), 8).alias("minutes"), F.date_format("ts", "yyyyMMddHHmmss").alias("at"))


@query(
    f"""WITH {CALLS}, m AS (SELECT a.id, arg_min(b.id, (abs(a.at - b.at), b.id)) AS other FROM calls a JOIN calls b ON a.event_type = b.event_type AND a.id <> b.id AND b.at BETWEEN a.at - 60000 AND a.at + 60000 GROUP BY 1),
pairs AS (SELECT a.caller AS src, b.caller AS dst, a.seconds FROM m JOIN calls a USING (id) JOIN calls b ON b.id = m.other WHERE a.caller <> b.caller)
SELECT src, dst, count(*) AS calls, round(sum(seconds / 60.0::DOUBLE), 6) AS minutes FROM pairs GROUP BY 1, 2"""
)
def call_pairing_edges(spark, sf_dir):
    """Friend edges from paired calls: a call whose counterpart is found adds an edge between the two callers."""
    calls = calls_of(spark, sf_dir)
    paired = S.interval_pairs(calls, ["event_type"], tolerance=60_000)
    known = paired.join(calls.select("id", F.col("caller").alias("src"), "seconds"), "id").join(calls.select(F.col("id").alias("other"), F.col("caller").alias("dst")), "other")
    return S.friend_edges(known.filter("src <> dst"), "src", "dst", "seconds").withColumn("minutes", F.round("minutes", 6))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_custkey % 13 <> 0")
def starred_contacts(spark, sf_dir):
    """Contacts that are starred (here: of a high balance) and not deleted."""
    c = table(spark, sf_dir, "customer")
    return K.favourites(c, F.col("c_acctbal") > 5000, F.col("c_custkey") % 13 == 0).select("c_custkey")


@query(
    f"""WITH {ROWS} SELECT raw_id, mimetype, CASE WHEN mimetype = 'phone' THEN 'custom' WHEN mimetype = 'job' THEN 'work' END AS type, CASE WHEN mimetype = 'phone' THEN 'phone' END AS label, data1 FROM eav"""
)
def insert_labels(spark, sf_dir):
    """Entity rows as an insert writes them, with the type and label of their kind."""
    return K.for_insert(rows_of(spark, sf_dir)).select("raw_id", "mimetype", "type", "label", "data1")


@query(f"WITH {ROWS} SELECT a.raw_id, a.mimetype, a.data1 FROM eav a WHERE EXISTS (SELECT 1 FROM eav b WHERE b.raw_id % 10 = 3 AND a.mimetype = b.mimetype AND a.data1 IS NOT DISTINCT FROM b.data1 AND a.data2 IS NOT DISTINCT FROM b.data2 AND a.data3 IS NOT DISTINCT FROM b.data3)")
def entity_value_equality(spark, sf_dir):
    """Entity rows that equal one of some contacts' rows in kind and values, whoever's they are."""
    rows = rows_of(spark, sf_dir)
    return K.equal_values(rows, rows.filter("raw_id % 10 = 3")).select("raw_id", "mimetype", "data1")


@query(
    """WITH g AS (SELECT n_nationkey::BIGINT AS group_id, n_name AS label, n_regionkey::BIGINT AS color FROM nation UNION ALL SELECT 100, 'NEW', 9 UNION ALL SELECT 101, 'OTHER', -1)
SELECT group_id, CASE WHEN label = 'NEW' THEN 'RENAMED' ELSE label END AS label, CASE WHEN group_id = 3 THEN 77 ELSE color END AS color FROM g WHERE label <> 'PERU'"""
)
def group_changes(spark, sf_dir):
    """Groups inserted, one updated by its label, one by its id, and one deleted by its label."""
    n = table(spark, sf_dir, "nation")
    groups = n.select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("long").alias("color"))
    groups = K.insert_group(groups, (100, "NEW", 9), (101, "OTHER", -1))
    groups = K.update_groups(groups, F.col("label") == "NEW", label="RENAMED")
    groups = K.update_groups(groups, F.col("group_id") == 3, color=77)
    return K.delete_group(groups, groups.limit(0).select("group_id"), F.col("label") == "PERU")[0]


@query("SELECT c_custkey FROM customer WHERE replace('0' || c_nationkey || '-' || c_custkey % 40, '-', '') = '0215'")
def phone_owner(spark, sf_dir):
    """Contacts with a number among their phones, hyphens aside."""
    phones = F.array(F.lit("1-2"), F.concat(F.lit("0"), F.col("c_nationkey"), F.lit("-"), F.col("c_custkey") % 40))
    return table(spark, sf_dir, "customer").filter(K.has_phone(phones, F.lit("02-15"))).select("c_custkey")


@query(
    f"""WITH {_REL}, o AS (SELECT id, round(r, 9) AS score FROM rel ORDER BY score DESC, id LIMIT 50) SELECT id, score, rank() OVER (ORDER BY score DESC) AS rank FROM o"""
)
def search_ranking(spark, sf_dir):
    """The first 50 results of a search with their ranks, which equal scores share."""
    found = relatedness_of(spark, sf_dir).select("id", F.round("r", 9).alias("score"))
    return S.ranked(found, 50).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH p AS (SELECT n_nationkey, n_nationkey + 2 AS size, list_transform(range(1, 301), lambda i: list_transform([0, 1], lambda side: ('0x' || substr(md5('5:' || i || ':' || side || ':' || (n_nationkey + 2)), 1, 12))::BIGINT % (n_nationkey + 2))) AS swaps FROM nation),
s AS (SELECT n_nationkey, size, list_reduce(list_prepend(range(size), swaps), lambda v, p: list_transform(v, lambda x, k: CASE WHEN k - 1 = p[1] THEN v[p[2] + 1] WHEN k - 1 = p[2] THEN v[p[1] + 1] ELSE x END)) AS v FROM p)
SELECT n_nationkey, size, array_to_string(v, ',') AS shuffled, list_sort(v) = range(size) AS is_permutation FROM s"""
)
def permutation_shuffle(spark, sf_dir):
    """Arrays shuffled by 300 swaps, whose places come from md5, and whether they are permutations."""
    keys = table(spark, sf_dir, "nation").select("n_nationkey", F.sequence(F.lit(0), (F.col("n_nationkey") + 1).cast("int")).alias("v"))
    shuffled = keys.withColumn("s", T.swapped(F.col("v"), 5))
    return shuffled.select("n_nationkey", F.size("s").alias("size"), F.array_join("s", ",").alias("shuffled"), T.is_permutation(F.col("s")).alias("is_permutation"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def contact_by_id(spark, sf_dir):
    """The one contact of an id; two would be an error."""
    return K.unique_look_up(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), c_custkey=7)


@query("SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority IN ('1-URGENT', '5-LOW'))")
def labels_any(spark, sf_dir):
    """Contacts whose label lists hold any of two labels."""
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("labels"))
    return lists.filter(S.any_equal(F.col("labels"), ["1-URGENT", "5-LOW"])).select("id")


def call_logs_of(spark, sf_dir):
    """(calls, known): events as call logs, and the numbers that are known from the start."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("device"), ((F.col("user_id") * 7 + F.col("event_id")) % 50).alias("number"), F.floor(F.col("value") / 25).alias("seconds"), F.expr(_ms).alias("at"))
    return e, e.filter("device % 10 = 1 and device < 50").select("device", F.col("device").alias("number")).distinct()


@query(
    """WITH RECURSIVE c AS (
  SELECT event_id AS id, user_id AS device, (user_id * 7 + event_id) % 50 AS number, floor(value / 25)::BIGINT AS seconds, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY event_id) AS k FROM events
), start AS (SELECT list(u ORDER BY u) AS l FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 10 = 1 AND user_id < 50)
), s AS (
  SELECT 0::BIGINT AS k, l AS dev, l AS num, []::STRUCT(id BIGINT, device BIGINT, number BIGINT, seconds BIGINT, ms BIGINT)[] AS waiting, NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::BIGINT AS seconds, false AS both_ways FROM start
  UNION ALL
  SELECT k, CASE WHEN t_dev IS NULL THEN dev ELSE list_append(dev, t_dev) END, CASE WHEN t_dev IS NULL THEN num ELSE list_append(num, t_num) END,
    CASE WHEN own IS NOT NULL AND friend IS NOT NULL THEN waiting WHEN m IS NOT NULL THEN list_filter(waiting, lambda w: w.id <> m.id) ELSE list_append(list_filter(waiting, lambda w: w.ms >= e.ms - 6000000), e) END,
    e.device, CASE WHEN own IS NOT NULL AND friend IS NOT NULL THEN friend ELSE m.device END, e.seconds, m IS NOT NULL
  FROM (
    SELECT *, CASE WHEN m IS NULL THEN NULL WHEN own IS NULL AND NOT list_contains(num, m.number) THEN e.device WHEN friend IS NULL AND NOT list_contains(dev, m.device) THEN m.device END AS t_dev, CASE WHEN own IS NULL THEN m.number ELSE e.number END AS t_num
    FROM (
      SELECT *, CASE WHEN (own IS NULL) <> (friend IS NULL) THEN list_filter(waiting, lambda w: w.seconds = e.seconds AND abs(w.ms - e.ms) <= 600000 AND w.device <> e.device AND coalesce(w.device = friend, w.number = own))[1] END AS m
      FROM (SELECT c.k, s.dev, s.num, s.waiting, {'id': c.id, 'device': c.device, 'number': c.number, 'seconds': c.seconds, 'ms': c.ms} AS e, s.num[list_position(s.dev, c.device)] AS own, s.dev[list_position(s.num, c.number)] AS friend FROM s JOIN c ON c.k = s.k + 1)
    )
  )
), ends AS (SELECT src, dst, seconds FROM s WHERE dst IS NOT NULL UNION ALL SELECT dst, src, seconds FROM s WHERE both_ways
), numbers AS (SELECT unnest(dev) AS src, unnest(num) AS src_number FROM s WHERE k = (SELECT max(k) FROM s))
SELECT src, dst, count(*) AS calls, round(sum(seconds / 60.0::DOUBLE), 6) AS minutes, any_value(src_number) AS src_number FROM ends LEFT JOIN numbers USING (src) GROUP BY src, dst"""
)
def call_resolution(spark, sf_dir):
    """Friend edges from call logs one after another, and the caller's number: given for some devices, learned for others from counterpart logs."""
    calls, known = call_logs_of(spark, sf_dir)
    found = C.resolve_calls(calls, known, tolerance=600_000)
    numbers = known.unionByName(found.learned.drop("id")).select(F.col("device").alias("src"), F.col("number").alias("src_number"))
    return found.edges.join(numbers, "src", "left").select("src", "dst", "calls", F.round("minutes", 6).alias("minutes"), "src_number")


@query(
    """WITH RECURSIVE e AS (
  SELECT o_custkey AS cust, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS id, 'd' || o_orderkey % 3 AS device, CASE WHEN o_orderkey % 4 <> 1 THEN 'n' || o_custkey || '-' || o_orderkey % 3 END AS number,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS name, CASE WHEN o_orderkey % 5 <> 2 THEN 'e' || o_custkey || '-' || o_orderkey // 7 % 3 END AS email, CASE WHEN o_orderkey % 7 = 0 THEN 'a' || o_orderkey END AS address, 'c' || o_orderkey % 5 AS city,
    CASE WHEN o_orderkey % 3 <> 0 THEN [o_orderpriority] ELSE [] END AS labels, CASE WHEN o_orderkey % 6 <> 0 THEN [o_orderstatus] END AS groups FROM orders
), s AS (
  SELECT DISTINCT cust, 0::BIGINT AS k, []::STRUCT(contact BIGINT, email VARCHAR, name VARCHAR, number VARCHAR, address VARCHAR, city VARCHAR, is_public BOOLEAN, labels VARCHAR[], groups VARCHAR[])[] AS cs FROM e
  UNION ALL
  SELECT cust, k, list_transform(CASE WHEN hit IS NULL THEN list_append(cs, {'contact': e.id, 'email': NULL, 'name': NULL, 'number': NULL, 'address': NULL, 'city': e.city, 'is_public': false, 'labels': [], 'groups': []}) ELSE cs END,
    lambda c, i: CASE WHEN i <> coalesce(hit, len(cs) + 1) THEN c ELSE {'contact': c.contact, 'email': coalesce(e.email, c.email), 'name': coalesce(e.name, c.name), 'number': coalesce(e.number, c.number), 'address': coalesce(e.address, c.address), 'city': c.city,
      'is_public': c.is_public OR e.groups IS NULL, 'labels': c.labels || list_filter(list_transform(e.labels, lambda x: e.device || ':' || x), lambda x: NOT list_contains(c.labels, x)),
      'groups': c.groups || list_filter(list_transform(coalesce(e.groups, []), lambda x: e.device || ':' || x), lambda x: NOT list_contains(c.groups, x))} END)
  FROM (SELECT s.cust, e.k, s.cs, e, nullif(coalesce(CASE WHEN e.number IS NOT NULL THEN nullif(list_position(list_transform(s.cs, lambda c: c.number), e.number), 0) END, CASE WHEN e.email IS NOT NULL THEN list_position(list_transform(s.cs, lambda c: c.email), e.email) END), 0) AS hit FROM s JOIN e ON e.cust = s.cust AND e.k = s.k + 1)
), last AS (SELECT cust, unnest(arg_max(cs, k)) AS c FROM s GROUP BY cust)
SELECT c.contact, c.email, c.name, c.number, c.address, c.city, c.is_public, array_to_string(c.labels, ',') AS labels, array_to_string(c.groups, ',') AS groups FROM last"""
)
def share_resolution(spark, sf_dir):
    """Contacts after share events one after another, each matched by number, else by email, else new; orders are the events."""
    key, text = F.col("o_orderkey"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shares = table(spark, sf_dir, "orders").select(
        key.alias("id"), text("d", key % 3).alias("device"), F.when(key % 4 != 1, text("n", F.col("o_custkey"), "-", key % 3)).alias("number"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("name"),
        F.when(key % 5 != 2, text("e", F.col("o_custkey"), "-", F.floor(key / 7) % 3)).alias("email"), F.when(key % 7 == 0, text("a", key)).alias("address"), text("c", key % 5).alias("city"),
        F.when(key % 3 != 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(key % 6 != 0, F.array("o_orderstatus")).alias("groups"),
    )
    tags = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["device"], F.lit(":"), x["label"])), ",").alias(c)
    changed, _ = H.share_contacts(None, shares)
    return changed.select("contact", "email", "name", "number", "address", "city", "is_public", tags("labels"), tags("groups"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H%M%S') || '+0900' AS at FROM events")
def log_times(spark, sf_dir):
    """Times of all events as log lines have them, in the zone of Seoul."""
    return table(spark, sf_dir, "events").select("event_id", T.log_time(F.col("ts"), "Asia/Seoul").alias("at"))


@query("SELECT c_nationkey, array_to_string(list_sort(list_append(list(c_name), 'Customer#00' || c_nationkey)), ',') AS names FROM customer GROUP BY 1")
def ordered_insert(spark, sf_dir):
    """Each nation's customers in order, with one more put in its place."""
    lists = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    return lists.select("c_nationkey", F.array_join(T.inserted(F.col("names"), F.concat(F.lit("Customer#00"), F.col("c_nationkey").cast("string"))), ",").alias("names"))
