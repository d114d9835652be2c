"""URL filters: fixed host rules first, then association rules mined from labelled URLs.

FP-growth finds the token combinations of labelled URLs that often come with a class; rules pass by
support and confidence, and a rule goes when a shorter one inside it is at least as confident.
A rule is indexed under its rarest token; a URL meets only rules indexed under its own
tokens, and those are verified in full.

A URL is matched once, however many rows share it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: (verdict, host, path) of the fixed rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALLOW, _BLOCK = "\x00allow", "\x00block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where the url is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct letter-and-digit tokens of a url in lower case; numbers only say how long they are."""
    words = F.filter(F.split(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w)))


def inseparable(labelled: DataFrame, least: float) -> dict[str, list[str]]:
    """Tokens of at least so many rows that always come together: the first by name, and all.

    Two tokens of the same rows have the same row count and sum of row hashes. Tokens this frequent are few: a url's tokens over
    the least share of rows.
    """
    row = F.xxhash64("row", "tokens").cast("decimal(38,0)")
    seen = labelled.withColumn("row", F.monotonically_increasing_id()).select(F.explode("tokens").alias("t"), row.alias("h")).groupBy("t").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    together = seen.filter(F.col("n") >= least).groupBy("n", "h").agg(F.array_sort(F.collect_list("t")).alias("all")).filter(F.size("all") > 1)
    return {r["all"][0]: list(r["all"]) for r in together.select("all").collect()}


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_count: int = 25, min_confidence: float = 0.7, min_lift: float = 1.2, gap: float = 0.5) -> DataFrame | None:
    """Rules (tokens, verdict, confidence, support) from labelled rows (tokens array, bad boolean); None where no row is labelled.

    A rule needs min_support of all rows and min_count rows, min_confidence, and min_lift over its class; where its class is so
    common that this asks for more, a confidence above the class's share by `gap` of what is left to 1. A token of all
    rows doesn't take part: a rule with it and the rule without it fit the same rows. Tokens that always come together are one item, whose rules name
    all of them: a url of many tokens with a third of the rows makes no more itemsets than one of few.
    """
    labelled = written(labelled, "url-labels")
    n = labelled.count()
    if n == 0:
        return None
    support = min(1.0, max(min_support, min_count / n))
    frequent = labelled.select(F.explode("tokens").alias("t")).groupBy("t").count().filter(F.col("count") == n)
    groups = inseparable(labelled, support * n)
    stop = [r.t for r in frequent.select("t").collect()] + [t for g in groups.values() for t in g[1:]]  # each of support * n rows at least
    items = F.array_except("tokens", F.array(*map(F.lit, stop)).cast("array<string>")) if stop else F.col("tokens")
    baskets = labelled.select(F.array_append(items, F.when(F.col("bad"), _BLOCK).otherwise(_ALLOW)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].isin(_ALLOW, _BLOCK))
    share = F.col("confidence") / F.col("lift")  # of the rule's class
    rules = rules.filter((F.col("lift") >= min_lift) | (F.col("confidence") >= share + gap * (1 - share)))
    rules = rules.filter(~F.arrays_overlap("antecedent", F.array(F.lit(_ALLOW), F.lit(_BLOCK))))
    tokens = F.col("antecedent")
    if groups:
        whole = F.create_map(*(x for first, every in groups.items() for x in (F.lit(first), F.array(*map(F.lit, every)))))
        tokens = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(whole, t), F.array(t))))
    return rules.select(F.array_sort(tokens).alias("tokens"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")


def prune_rules(rules: DataFrame) -> DataFrame:
    """Without rules that contain a shorter rule of the same verdict and no less confidence.

    A shorter rule inside another shares its first, middle or last tokens, so candidates meet on each token.
    """
    keyed = rules.withColumn("rule_id", F.concat_ws(" ", "tokens", "verdict"))
    by_token = keyed.select(F.explode("tokens").alias("t"), "rule_id", "tokens", "verdict", "confidence")
    short = keyed.select(
        F.col("tokens")[0].alias("t"), F.col("tokens").alias("inner"), F.col("verdict").alias("inner_verdict"), F.col("confidence").alias("inner_confidence")
    )
    beaten = by_token.join(short, "t").filter(
        (F.col("verdict") == F.col("inner_verdict"))
        & (F.size("inner") < F.size("tokens"))
        & (F.col("inner_confidence") >= F.col("confidence"))
        & (F.size(F.array_except("inner", "tokens")) == 0)
    )
    return keyed.join(beaten.select("rule_id").distinct(), "rule_id", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict, matched) of each url (with its tokens) that a rule fits: most confident first, then most supported, then the longest, then by name."""
    rarity = rules.select(F.explode("tokens").alias("t"), "rule_id", "tokens", "verdict", "confidence", "support")
    df = urls.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    first = W.partitionBy("rule_id").orderBy("df", "t")
    index = rarity.join(df, "t").withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "df")
    met = urls.select("url", F.col("tokens").alias("url_tokens"), F.explode("tokens").alias("t")).join(index, "t")
    met = met.filter(F.size(F.array_except("tokens", "url_tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), "rule_id", "verdict")).alias("best")
    return met.groupBy("url").agg(best).select("url", F.col("best.verdict").alias("mined"), F.col("best.rule_id").alias("matched"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, default: str = "allow", **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched) of every row of pages.

    A page's label is that of the labels row with its id: bad when toxic or of low quality. Null urls have empty parts
    and the default verdict; repeated rows stay; pages or labels without rows work (nothing is mined);
    rows of labels with nulls in both columns tell nothing; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "fixed": verdict})
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.filter("toxic is not null or quality is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.filter("url is not null").select("page_id", url_tokens(F.col("url")).alias("tokens")).join(known, "page_id").select("tokens", "bad")
    mined = mine_rules(labelled, **mining)
    if mined is None:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("matched"))
    urls = judged.filter("fixed is null and url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    hits = match_rules(urls, prune_rules(mined))
    return judged.join(hits, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit(default)).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("matched")).alias("matched"))
