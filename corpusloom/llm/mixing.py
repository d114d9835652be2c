"""Temperature mixing of sources, by DataFrame operations only.

A source's weight is its token count to the power of an exponent between 0 (all alike) and 1 (as they
come), normalised. The exponent is bisected: the largest that still reaches a target entropy, but no less
than the smallest that keeps every source's repetition within a limit. A token budget turns weights into
quotas: whole passes over a source and a rest. Each source is cut into blocks by a hash of the document id;
each pass is a permutation of the blocks (and of the documents of a block, by hash), and the last pass ends where
the rest is used up, inside one block.

Blocks number about the square root of the largest source's documents, so neither the running sums over blocks nor
those inside the one cut block hold more than about that many rows, whatever share a source has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import every, unused
from .shared import written

#: Steps of the bisection, and how many of them one job takes: it tries all exponents that they could come to.
STEPS, AT_ONCE = 30, 3


@dataclass
class Mix:
    exponent: float
    budget: int
    draws: DataFrame  # source, block, pass, block_rank, weight, room: tokens left for the block (null: all of it)
    blocks: int
    seed: int


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def _text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _key(doc_id: Column, text: Column) -> Column:
    """What names a row in hashes: its id, or without one its text, so rows without ids spread over all blocks."""
    return F.coalesce(doc_id.cast("long").cast("string"), _text_hash(text))


def _block(seed: int, blocks: int, key: Column) -> Column:
    return F.conv(F.substring(_hash(seed, key), 1, 8), 16, 10).cast("long") % F.lit(blocks)


def plan_mix(docs: DataFrame, entropy: float | None = 0.98, repetition: float | None = 4.0, budget: float | None = 1.0, seed: int = 17) -> Mix:
    """The exponent and what is drawn from each block.

    entropy: least share of the largest possible entropy; repetition: most passes over a source; budget: tokens to
    draw as a share of all tokens, or None for the least that draws every source once in full. Where
    no exponent meets the repetition limit, the exponent is 1 and quotas are cut at the limit.
    Sources without a token weigh nothing; they are drawn once where the budget is None, else not.
    """
    tokens = docs.select(F.coalesce("source", F.lit("")).alias("source"), _key(F.col("doc_id"), F.col("text")).alias("key"), word_count(F.col("text")).alias("n"))
    per_source = tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    every = written(per_source, "mix-sources")
    sources = every.filter("tokens > 0")
    s = sources.agg(F.count("*").alias("k"), F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.max("docs").alias("docs")).first()
    kinds, total, top = s.k, s["all"] or 0, s.top or 0

    def at(*exponents: float):
        """For each exponent, the sum of powers, the entropy, and the most passes that the budget takes over a source."""
        t = F.col("tokens") / F.lit(float(max(top, 1)))
        sums = [F.sum(f(F.pow(t, F.lit(x)))) for x in exponents for f in (lambda p: p, lambda p: p * F.log(p))]
        most = [F.max(F.pow(t, F.lit(x - 1.0))) for x in exponents]
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums + most)]).first()
        out = []
        for i, _ in enumerate(exponents):
            z, zlogz, peak = row[2 * i], row[2 * i + 1], row[2 * len(exponents) + i]
            passes = peak if budget is None else peak * budget * total / (z * top)
            out.append((z, math.log(z) - zlogz / z, passes))
        return out

    exponent = 1.0
    if kinds > 1:
        goal = (entropy or 0.0) * math.log(kinds)
        (_, _, flat), (_, natural, _) = at(0.0, 1.0)
        lo_h, hi_h = (1.0, 1.0) if natural >= goal else (0.0, 1.0)
        lo_r, hi_r = (0.0, 0.0) if repetition is None or flat <= repetition else (0.0, 1.0)
        for _ in range(STEPS // AT_ONCE):
            by_h, by_r = ([lo + (hi - lo) * i / 2**AT_ONCE for i in range(2**AT_ONCE + 1)] for lo, hi in ((lo_h, hi_h), (lo_r, hi_r)))
            tried = at(*by_h, *by_r)
            reached = [h >= goal for _, h, _ in tried[: len(by_h)]]
            within = [repetition is None or passes <= repetition for _, _, passes in tried[len(by_h) :]]
            for step in [2**i for i in reversed(range(AT_ONCE))]:
                mid_h, mid_r = by_h.index(lo_h) + step, by_r.index(lo_r) + step
                lo_h, hi_h = (by_h[mid_h], hi_h) if reached[mid_h] else (lo_h, by_h[mid_h])
                if hi_r > lo_r:
                    lo_r, hi_r = (lo_r, by_r[mid_r]) if within[mid_r] else (by_r[mid_r], hi_r)
        exponent = round(max(lo_h, hi_r), 6)

    power = F.pow(F.col("tokens") / F.lit(float(max(top, 1))), F.lit(exponent))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    amount = round(budget * total) if budget is not None else round(z * top)
    quota = F.floor(F.round(power / F.lit(z), 9) * F.lit(float(amount)))
    if budget is None:  # the least budget gives the largest source one pass, up to rounding
        quota = F.greatest(quota, F.col("tokens"))
    if repetition is not None:
        quota = F.least(quota, F.floor(F.col("tokens") * F.lit(float(repetition))))
    planned = sources.select("source", F.round(power / F.lit(z), 9).alias("weight"), F.col("tokens").alias("size"), quota.cast("long").alias("quota"))
    planned = planned.withColumn("whole", F.expr("quota div size")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("size")).select("source", "weight", "whole", "rest")
    if budget is None:
        once = (F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("whole"), F.lit(0).cast("long").alias("rest"))
        planned = planned.unionByName(every.filter("tokens = 0").select("source", *once))

    blocks = max(1, int((s.docs or 1) ** 0.5 + 0.999999))
    sums = tokens.groupBy("source", _block(seed, blocks, F.col("key")).alias("block")).agg(F.sum("n").alias("tokens"))
    passes = sums.join(planned, "source").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    order = W.partitionBy("source", "pass").orderBy(_hash(seed, F.col("pass"), F.col("source"), F.col("block")), "block")
    ranked = passes.withColumn("block_rank", F.row_number().over(order)).withColumn("before", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
    last = F.col("pass") > F.col("whole")
    room = F.col("rest") - F.col("before")
    draws = ranked.filter(~last | (room > 0)).select("source", "block", F.col("pass"), "block_rank", "weight", F.when(last & (room < F.col("tokens")), room).alias("room"))
    return Mix(exponent, amount, written(draws, "mix-blocks"), blocks, seed)


def draw(docs: DataFrame, mix: Mix, prefix: str = "__mix_") -> DataFrame:
    """Rows of docs, all columns, once for each pass that draws them, and columns prefix + source, block, pass, block_rank, weight, n_tokens.

    Rows are in no order; (pass, block_rank, md5 of seed, pass and id) is the order of the mix within a source; without an id the text's own hash stands for it.
    A document is drawn in the cut block while it fits in what is left; ties of the hash go by id, size and text. No column of docs
    may begin with the prefix.
    """
    name = lambda c: prefix + c
    key = _key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumns({name("source"): F.coalesce("source", F.lit("")), name("block"): _block(mix.seed, mix.blocks, key)})
    plan = mix.draws.select(*(F.col(c).alias(name(c)) for c in mix.draws.columns))
    on = [name("source"), name("block")]
    count = word_count(F.col("text"))  # after the joins: of cut blocks alone, unless it is asked for
    whole = keyed.join(plan.filter(F.col(name("room")).isNull()), on).withColumn(name("n_tokens"), count)
    part = keyed.join(plan.filter(F.col(name("room")).isNotNull()), on).withColumn(name("n_tokens"), count)
    order = W.partitionBy(*on, name("pass")).orderBy(_hash(mix.seed, F.col(name("pass")), key), "doc_id", name("n_tokens"), _text_hash(F.col("text"))).rowsBetween(W.unboundedPreceding, 0)
    part = part.withColumn(name("sum"), F.sum(name("n_tokens")).over(order)).filter(F.col(name("sum")) <= F.col(name("room"))).drop(name("sum"))
    return whole.unionByName(part).drop(name("room"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs drawn by plan_mix(docs, **how), with docs' columns alone.

    Null sources are the source ''; null and empty texts have no tokens and come with each whole pass; rows without an id are spread over the blocks by their texts;
    repeated rows are drawn each; an empty table gives an empty table; other columns stay, whatever their names.
    """
    return draw(docs, plan_mix(docs, **how), unused(docs, "__mix_")).select(every(docs))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, pass, block, block_rank, n_tokens, weight, exponent): each drawn document, once a pass.

    Nulls, empty texts, repeated rows, ties and other columns are handled as in `mixed`; sources without a token are not drawn under a budget; an empty table gives an empty table.
    """
    mix = plan_mix(docs.select("doc_id", "source", "text"), **how)
    drawn = draw(docs.select("doc_id", "source", "text"), mix)
    names = ("source", "pass", "block", "block_rank", "n_tokens", "weight")
    return drawn.select("doc_id", *(F.col("__mix_" + c).cast("long" if c not in ("source", "weight") else drawn.schema["__mix_" + c].dataType).alias(c) for c in names), F.lit(mix.exponent).alias("exponent"))


#: DuckDB SQL for mix_report(documents) with the default parameters.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(coalesce(text, '')) AS t, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS id FROM documents
), s AS (SELECT source, count(*) AS docs, sum(n)::BIGINT AS tokens FROM d GROUP BY 1 HAVING sum(n) > 0
), a AS (SELECT count(*) AS k, sum(tokens)::DOUBLE AS total, max(tokens)::DOUBLE AS top, ceil(sqrt(max(docs)))::BIGINT AS blocks, list(tokens / (SELECT max(tokens) FROM s)::DOUBLE ORDER BY source) AS t FROM s
), b AS (
  SELECT 0 AS i, CASE WHEN ln(list_sum(t)) - list_sum(list_transform(t, lambda x: x * ln(x))) / list_sum(t) >= 0.98 * ln(k) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo_h, 1.0::DOUBLE AS hi_h,
    0.0::DOUBLE AS lo_r, CASE WHEN list_max(list_transform(t, lambda x: 1 / x)) * total / (k * top) <= 4 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hi_r FROM a
  UNION ALL
  SELECT i + 1, CASE WHEN h >= 0.98 * ln(k) THEN mid_h ELSE lo_h END, CASE WHEN h >= 0.98 * ln(k) THEN hi_h ELSE mid_h END,
    CASE WHEN hi_r = lo_r OR r <= 4 THEN lo_r ELSE mid_r END, CASE WHEN hi_r = lo_r OR r > 4 THEN hi_r ELSE mid_r END
  FROM (SELECT *, ln(list_sum(list_transform(t, lambda x: pow(x, mid_h)))) - list_sum(list_transform(t, lambda x: pow(x, mid_h) * ln(pow(x, mid_h)))) / list_sum(list_transform(t, lambda x: pow(x, mid_h))) AS h,
      list_max(list_transform(t, lambda x: pow(x, mid_r - 1))) * total / (list_sum(list_transform(t, lambda x: pow(x, mid_r))) * top) AS r
    FROM (SELECT *, (lo_h + hi_h) / 2 AS mid_h, (lo_r + hi_r) / 2 AS mid_r FROM b CROSS JOIN a WHERE i < 30))
), e AS (SELECT CASE WHEN k > 1 THEN round(greatest(lo_h, hi_r), 6) ELSE 1.0 END AS exponent, a.* FROM b CROSS JOIN a WHERE i = 30
), w AS (SELECT s.source, s.tokens, exponent, blocks, round(pow(s.tokens / top, exponent) / list_sum(list_transform(t, lambda x: pow(x, exponent))), 9) AS weight, round(total) AS amount FROM s CROSS JOIN e
), q AS (SELECT *, least(floor(weight * amount), floor(tokens * 4.0))::BIGINT AS quota FROM w
), p AS (SELECT *, quota // tokens AS whole, quota % tokens AS rest FROM q
), k AS (SELECT d.*, ('0x' || substr(md5('17:' || id), 1, 8))::BIGINT % (SELECT blocks FROM a) AS block FROM d
), g AS (SELECT source, block, sum(n)::BIGINT AS size FROM k GROUP BY ALL
), x AS (SELECT g.*, p.weight, p.exponent, p.whole, p.rest, unnest(range(1, whole + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS pass FROM g JOIN p USING (source)
), r AS (SELECT *, row_number() OVER o AS block_rank, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before FROM x WINDOW o AS (PARTITION BY source, pass ORDER BY md5('17:' || pass || ':' || source || ':' || block), block)
), m AS (SELECT *, CASE WHEN pass > whole AND rest - before < size THEN rest - before END AS room FROM r WHERE pass <= whole OR rest > before
), z AS (SELECT doc_id, k.source, pass, k.block, block_rank, n, weight, exponent, room, sum(n) OVER (PARTITION BY k.source, k.block, pass ORDER BY md5('17:' || pass || ':' || id), doc_id, n, k.t ROWS UNBOUNDED PRECEDING) AS so_far FROM k JOIN m ON k.source = m.source AND k.block = m.block)
SELECT doc_id, source, pass::BIGINT AS pass, block::BIGINT AS block, block_rank::BIGINT AS block_rank, n AS n_tokens, weight, exponent FROM z WHERE room IS NULL OR so_far <= room
"""
