"""Calls, friends, search ranking, tag pairs and tag suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


def interval_pairs(calls: DataFrame, equal: list[str], at: str = "at", key: str = "id", tolerance: int = 2000) -> DataFrame:
    """(key, other, apart): for each call its counterpart: equal in `equal`, another key, times at most `tolerance` apart; the nearest first, then the least key.

    Each call has a key of its own. Times are cut into bins of several tolerances, and calls near a bin's end also look on from the
    next one. Only neighbours in time are looked at, so a bin costs a sort, however many calls it has.
    """
    width, t = 8 * max(1, tolerance), F.col(at)
    bins = F.array_distinct(F.array(*(F.floor((t + d) / F.lit(width)) for d in (0, -tolerance, tolerance))))
    seen = calls.select(*equal, key, at, F.explode(bins).alias("bin"))
    where = [*equal, "bin"]
    moment = W.partitionBy(*where, at).orderBy(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = seen.withColumns({"least": F.first(key).over(moment), "second": F.nth_value(key, 2).over(moment)})
    strictly = lambda order: W.partitionBy(*where).orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    beside = F.struct(t.alias("at"), F.col("least").alias("other"))
    seen = seen.withColumns({"before": F.last(beside).over(strictly(t)), "after": F.last(beside).over(strictly(t.desc()))})
    same = F.when(F.col(key) == F.col("least"), F.col("second")).otherwise(F.col("least"))
    found = F.array(*(F.when(other.isNotNull(), F.struct(F.abs(t - when).alias("apart"), other.alias("other"))) for when, other in ((t, same), (F.col("before.at"), F.col("before.other")), (F.col("after.at"), F.col("after.other")))))
    best = seen.filter(F.col("bin") == F.floor(t / F.lit(width))).select(key, F.array_min(F.filter(found, lambda x: x.isNotNull())).alias("n"))
    return best.filter(F.col("n.apart") <= tolerance).select(key, F.col("n.other").alias("other"), F.col("n.apart").alias("apart"))


def friend_edges(calls: DataFrame, src: str, dst: str, seconds: str) -> DataFrame:
    """(src, dst, calls, minutes): each pair's calls and minutes."""
    return calls.filter(F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("calls"), F.sum(T.minutes(F.col(seconds))).alias("minutes"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, added up."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "calls", "minutes")
    return edges.unionByName(back).groupBy("src", "dst").agg(F.sum("calls").alias("calls"), F.sum("minutes").alias("minutes"))


def weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", T.friend_weight(F.col("minutes"), F.col("calls")))


def tag_pairs(tags: DataFrame, group: str, tag: str) -> DataFrame:
    """(tag, related_tag, value): unordered pairs of distinct tags in a group, tag first in order, with the groups that hold both."""
    return list_pairs(tags.groupBy(group).agg(F.array_sort(F.collect_set(tag)).alias("t")), "t")


def list_pairs(lists: DataFrame, tags: str) -> DataFrame:
    """As tag_pairs, for groups as rows with a sorted array of their distinct tags; nulls pair with nothing.

    Pairs come from each group's own list (a document's or order's tags, some tens), so they are made where the
    group is and pre-aggregated before the shuffle.
    """
    lists = lists.select(F.filter(tags, lambda x: x.isNotNull()).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("tag"), b.alias("related_tag")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.tag", "p.related_tag").agg(F.count("*").alias("value"))


def co_occurrence(pairs: DataFrame) -> DataFrame:
    """(tag, other, n): each pair from both sides."""
    return pairs.select("tag", F.col("related_tag").alias("other"), F.col("value").alias("n")).unionByName(pairs.select(F.col("related_tag").alias("tag"), F.col("tag").alias("other"), F.col("value").alias("n")))


def co_occurrence_map(pairs: DataFrame) -> DataFrame:
    """(tag, cooccur): a map from other tag to count, as `k,v,k,v` text with ascending keys; a tag meets at most the vocabulary of tags."""
    entries = F.map_from_entries(F.collect_list(F.struct("other", F.col("n").cast("int"))))
    return co_occurrence(pairs).groupBy("tag").agg(T.map_pairs(entries).alias("cooccur"))


#: What an equal label adds to the relatedness, and by what the sum is divided; the weight of a tag pair.
EQUAL, PAIR = 2000, 3


def relatedness(labels: DataFrame, terms: DataFrame, related: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, r): for contacts with labels (id, label), each once however often it comes: over terms and labels, 2000 if equal, else their related count, plus 3 times their pair count; over 2000.

    Terms are a query's words. What a label adds depends on the label alone, so it is summed for each label that relates to a term, and contacts' labels meet
    those sums once: labels that relate to no term add nothing and go before anything is shuffled.
    """
    equal = terms.select(F.col("term").alias("label"), F.lit(EQUAL).cast("double").alias("x"))
    near = related.join(terms, related["tag"] == terms["term"]).filter(F.col("other") != F.col("term")).select(F.col("other").alias("label"), F.col("n").cast("double").alias("x"))
    every = pairs.select(F.col("tag").alias("p"), F.col("related_tag").alias("q"), "value").unionByName(pairs.select(F.col("related_tag").alias("p"), F.col("tag").alias("q"), "value"))
    paired = every.join(terms, every["q"] == terms["term"]).select(F.col("p").alias("label"), (PAIR * F.col("value")).cast("double").alias("x"))
    sums = written(equal.unionByName(near).unionByName(paired).groupBy("label").agg(F.sum("x").alias("x")), "label-sums")
    met = labels.join(sums, "label").repartition("id").groupBy("id", "label").agg(F.first("x").alias("x"))
    return met.groupBy("id").agg((F.sum("x") / EQUAL).alias("r"))


def social_rank(candidates: DataFrame, friends: DataFrame, tagged: DataFrame, back_edges: DataFrame) -> DataFrame:
    """(id, score, people) of candidates (id, r) for one searcher.

    friends: (friend, weight) of the searcher; tagged: (friend, id), who tagged whom; back_edges: (id, friend, weight) from candidate to friend.
    The link l of friend and candidate is 1 if tagged, plus the candidate's weight to the friend; the social sum over friends
    of weight times l, if not 0, multiplies r, else 0.001 does. people: friends with a link, ascending.
    """
    ones = tagged.join(friends.select("friend"), "friend", "left_semi").select("friend", "id", F.lit(1.0).alias("l")).distinct()
    links = ones.unionByName(back_edges.join(friends.select("friend"), "friend", "left_semi").select("friend", "id", F.col("weight").alias("l"))).groupBy("friend", "id").agg(F.sum("l").alias("l")).filter("l > 0")
    social = links.join(friends, "friend").groupBy("id").agg(F.sum(F.col("weight") * F.col("l")).alias("s"), F.array_sort(F.collect_set("friend")).alias("people"))
    joined = candidates.join(social, "id", "left")
    score = F.col("r") * F.when(F.coalesce(F.col("s"), F.lit(0.0)) == 0, F.lit(0.001)).otherwise(F.col("s"))
    return joined.select("id", score.alias("score"), F.coalesce(F.array_join(F.col("people").cast("array<string>"), ","), F.lit("")).alias("people"))


def ranked(scores: DataFrame, n: int, key: str = "id", digits: int = 9) -> DataFrame:
    """The first n results by descending score (to so many digits), then key, with `rank`; equal scores share a rank."""
    first = scores.orderBy(F.round("score", digits).desc(), key).limit(n)
    return first.withColumn("rank", F.rank().over(W.orderBy(F.round("score", digits).desc())))  # of n rows


def suggestions(user_tags: DataFrame, tag_stats: DataFrame, cooc: DataFrame, frequent: DataFrame, n: int = 15) -> DataFrame:
    """(tag, score): the n best tags that the user lacks.

    p(c|u) is how often c came with u over u's frequency; the score is 0.75 of the sum over the user's tags plus 0.25 of that over
    frequent tags (a candidate that is a frequent tag itself isn't left out). Without user tags, frequent tags by times, then name.
    """
    if not user_tags.limit(1).count():
        return frequent.orderBy(F.desc("times"), "tag").limit(n).select("tag", F.lit(0.0).alias("score"))
    share = cooc.join(tag_stats, "tag").select("tag", F.col("other").alias("candidate"), (F.col("n") / F.col("freq")).alias("p"))
    of = lambda given, w: share.join(given.select("tag").distinct(), "tag").select("candidate", (F.lit(w) * F.col("p")).alias("x"))
    names = share.join(user_tags.select("tag").distinct(), "tag").select("candidate").unionByName(frequent.select(F.col("tag").alias("candidate"))).distinct()
    sums = of(user_tags, 0.75).unionByName(of(frequent, 0.25)).groupBy("candidate").agg(F.sum("x").alias("score"))
    scored = names.join(sums, "candidate", "left").select(F.col("candidate").alias("tag"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return scored.join(user_tags.select("tag"), "tag", "left_anti").orderBy(F.round("score", 9).desc(), "tag").limit(n)


def top_per_group(counts: DataFrame, group: str, n: int, tie: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("times"), tie))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def merged_queries(local: DataFrame, public: DataFrame, n_local: int = 6, n: int = 18) -> DataFrame:
    """(query, source, rank): the best local queries, then public ones that aren't among them, n together at most."""
    first = local.orderBy(F.desc("times"), "query").limit(n_local)
    rest = public.join(first.select("query"), "query", "left_anti").orderBy(F.desc("times"), "query").limit(n)
    both = first.select("query", "times", F.lit("local").alias("source")).unionByName(rest.select("query", "times", F.lit("public").alias("source")))
    rank = F.row_number().over(W.orderBy("source", F.desc("times"), "query"))  # of at most n_local + n rows
    return both.withColumn("rank", rank).filter(F.col("rank") <= n).select("query", "source", "rank")


def any_equal(values: Column, wanted: list[str]) -> Column:
    """Whether an array holds any of the values."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
