"""Mixing sources to target weights: temperature, then block permutations.

The share of each source, in tokens, is raised to an exponent and normalised.  The
exponent is the largest in [0, 1] at which the weights' entropy reaches a target
share of the most possible, unless some source would then be repeated too often;
then it is the least at which none is.  Both are found by bisection.

Weights are realised in tokens: a source's quota is so many whole passes over its
documents and a rest.  For the rest, documents fall into blocks by a hash, blocks
are put in a random order by another, and are taken whole while the rest lasts;
the one block that overruns it is taken document by document.  So no source, not
even one with most rows, is ever put in order row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import unused

#: Blocks of a source, at least, and rows that a block has, about, at most.
BLOCKS, PER_BLOCK = 1_024, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def bisect(low: float, high: float, good, steps: int = 60) -> float:
    """The end of the good values that begin at low: good(low) holds, and fails from some value on."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def entropy(weights: list[float], times: list[int] | None = None) -> float:
    return -sum(n * w * math.log(w) for w, n in zip(weights, times or [1] * len(weights), strict=True) if w > 0)


def tempered(totals: list[int], exponent: float, times: list[int] | None = None) -> list[float]:
    top = max(totals)
    raw = [(t / top) ** exponent if t else 0.0 for t in totals]
    whole = sum(n * x for x, n in zip(raw, times or [1] * len(raw), strict=True))
    return [x / whole for x in raw]


def quotas(totals: list[int], *, entropy_share: float, most_passes: float, budget: int | None = None, times: list[int] | None = None) -> tuple[float, list[float], list[int]]:
    """(exponent, weight of each, tokens to take of each) of sources with these totals; times: how many sources have each.

    Without a budget it is the least that takes every document once at least.
    """
    times = times or [1] * len(totals)
    if not any(totals):
        return 1.0, [0.0] * len(totals), [0] * len(totals)

    def taken(e: float) -> list[float]:
        weights = tempered(totals, e, times)
        most = budget if budget is not None else max(t / w for t, w in zip(totals, weights, strict=True) if w)
        return [most * w for w in weights]

    goal = entropy_share * math.log(max(1, sum(n for t, n in zip(totals, times, strict=True) if t > 0)))
    exponent = bisect(0.0, 1.0, lambda e: entropy(tempered(totals, e, times), times) >= goal)
    over = lambda e: max(q / t for q, t in zip(taken(e), totals, strict=True) if t) > most_passes * (1 + 1e-9)
    if over(exponent):
        exponent = min(1.0, math.nextafter(bisect(exponent, 1.0, over), 2.0)) if not over(1.0) else 1.0
    tokens = [round(q) for q in taken(exponent)]
    return exponent, tempered(totals, exponent, times), [max(t, q) if budget is None else q for t, q in zip(totals, tokens, strict=True)]


def copies(docs: DataFrame, *, entropy_share: float = 0.95, most_passes: float = 2.0, budget: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs with all their columns and then mix_source, mix_tokens, mix_weight, mix_copies: how often the mix takes each.

    A column that docs has under one of these names stays, and the new one gets a
    further ``_``.  A null source is a source of its own.  Null and empty texts have
    no tokens and go with their block; those of a source without any tokens are taken
    once.  Rows that repeat each other count as rows, and can't be told apart; ties
    in the order of blocks and rows go by block and doc_id.  Very long texts count
    whole; of an empty table nothing comes.  The driver gathers the different totals
    only: at most the root of twice the tokens, however many sources there are.
    """
    source_, tokens_, weight_, copies_ = unused(docs, "mix_source", "mix_tokens", "mix_weight", "mix_copies")
    hash_, block_, left_, passes_, more_ = unused(docs, "mix_hash", "mix_block", "mix_left", "mix_passes", "mix_more")
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null apart from any name
    count = max(BLOCKS, 1 << (docs.count() // PER_BLOCK).bit_length())
    marked = docs.withColumns({source_: source, tokens_: F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"), hash_: F.xxhash64(F.lit(seed), "doc_id", "text")})
    marked = marked.withColumn(block_, F.pmod(hash_, F.lit(count)).cast("int"))
    blocks = marked.groupBy(F.col(source_).alias("s"), F.col(block_).alias("b")).agg(F.sum(tokens_).alias("tokens"))
    totals = blocks.groupBy("s").agg(F.sum("tokens").alias("total"))
    sizes = totals.groupBy("total").count().orderBy("total").collect()
    _, weights, tokens = quotas([r.total for r in sizes], entropy_share=entropy_share, most_passes=most_passes, budget=budget, times=[r["count"] for r in sizes])
    plan = [(r.total, float(w), *((q // r.total, q % r.total) if r.total else (1, 0))) for r, w, q in zip(sizes, weights, tokens, strict=True)]
    targets = totals.join(docs.sparkSession.createDataFrame(plan, "total long, weight double, passes long, rest long"), "total").drop("total")
    shuffled = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "b"), "b")
    until = F.sum("tokens").over(shuffled.rowsBetween(Window.unboundedPreceding, 0))
    # left: tokens that remain for a block; it is whole, partial or beyond
    decided = blocks.join(targets, "s").withColumn("left", F.col("rest") - until + F.col("tokens"))
    decided = decided.select(F.col("s").alias(source_), F.col("b").alias(block_), F.col("weight").alias(weight_), F.col("passes").alias(passes_), F.col("left").alias(left_), F.when(F.col("left") >= F.col("tokens"), 1).when(F.col("left") <= 0, 0).alias(more_))
    if sum(r["count"] for r in sizes) * count <= 1_000_000:  # a row of a few dozen bytes each
        decided = F.broadcast(decided)
    joined = marked.join(decided, [source_, block_])
    within = Window.partitionBy(source_, block_).orderBy(hash_, "doc_id")
    so_far = F.sum(tokens_).over(within.rowsBetween(Window.unboundedPreceding, 0))
    partial = joined.where(F.col(more_).isNull()).withColumn(more_, (so_far <= F.col(left_)).cast("int"))
    every = joined.where(F.col(more_).isNotNull()).unionByName(partial)
    return every.select(*docs.columns, F.substring(source_, 2, 1 << 30).alias(source_), tokens_, weight_, (F.col(passes_) + F.col(more_)).alias(copies_))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    taken = copies(docs, **options)
    times, turn = F.col(taken.columns[-1]), unused(taken, "mix_turn")[0]
    return taken.where(times > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_copies").alias("copies"))
