"""Mixing sources to target weights (problem 9) by subset-sum budget fitting.

The mix is the largest one in which every source that has documents can hold its share: its size is
the least of capacity/share over the sources, capacity being tokens times the allowed repeats.  A
source's budget is filled with as many whole rounds of all its documents as fit.  The remainder is
fitted per exact token length: a proportional number of documents of each length, then a bounded
knapsack over the lengths for the last few thousand tokens, so the budget is met to the token where
the lengths allow it.  Which documents of a length are taken is decided by a seeded hash.

Histograms of lengths, not documents, are planned on: their size is bounded by sources times the
longest text.  Taking the n first documents of a length by hash counts hash buckets first, so no
length, however common, is ranked in one task.

Defined results: NULL and blank texts have no tokens and aren't used; source spellings differing in
case, blanks or hyphens are one; NULL sources and sources without target aren't used; a target without
documents gets share 0, and the others keep their proportions to one another; targets that are NULL, not
positive, or with repeats below 1 are unattainable; repeated targets of one source count once (largest).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, scratch, small, spread
from .tokens import VOCABULARY, with_token_counts

SEED = 20240101
#: Least budget left to the knapsack, in multiples of the longest length.
KNAPSACK_ROOM = 4


def source_key(c: Column) -> Column:
    """page_body, ' Page-Body ' -> page_body."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that the total is the largest sum <= budget that this finds;
    exactly budget whenever the bounded knapsack over what the proportional part leaves can reach it."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    room = KNAPSACK_ROOM * int(lengths.max())
    take = (counts * max(0, budget - room)) // total
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths):  # whole extra items of the longest lengths until the knapsack is small
        if left <= 2 * room:
            break
        more = min(int(counts[i] - take[i]), (left - 2 * room) // int(lengths[i]) + 1)
        more = max(0, min(more, left // int(lengths[i])))
        take[i] += more
        left -= more * int(lengths[i])
    # bounded knapsack by bit sets: bit s of reach[k] says that the first k pieces can sum to s
    pieces: list[tuple[int, int]] = []
    for i, (length, spare) in enumerate(zip(lengths.tolist(), (counts - take).tolist(), strict=True)):
        spare, size = min(spare, left // length if length else 0), 1
        while spare > 0:
            n = min(size, spare)
            pieces.append((i, n))
            spare, size = spare - n, size * 2
    mask, reach = (1 << (left + 1)) - 1, [1]
    for i, n in pieces:
        reach.append((reach[-1] | reach[-1] << (int(lengths[i]) * n)) & mask)
        if reach[-1] >> left & 1:
            break
    s = reach[-1].bit_length() - 1
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> s & 1:
            i, n = pieces[k - 1]
            take[i] += n
            s -= int(lengths[i]) * n
    return take


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's histogram -> rounds of all documents, and extra takes per length."""
    lengths, counts = pdf["tokens"].to_numpy(), pdf["n_docs"].to_numpy()
    total, budget, most = int((lengths * counts).sum()), int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0])
    rounds = min(most, budget // total) if total else 0
    extra = fit(lengths, counts, budget - rounds * total) if rounds < most else np.zeros_like(counts)
    return pd.DataFrame({"source": pdf["source"], "tokens": lengths, "rounds": rounds, "extra": extra})


def targets_of(targets: DataFrame) -> DataFrame:
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return t


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(taken: doc_id, source, tokens, times; shares: one row per target source)."""
    sized = spread(documents.select("text", "doc_id", source_key(F.col("source")).alias("source")).where("text rlike '\\\\S' and doc_id is not null and source is not null"))
    sized = scratch(with_token_counts(sized, "text", "tokens", vocabulary), "tokens").where("tokens > 0").dropDuplicates(["doc_id"])
    wanted = targets_of(targets)
    usable = wanted.where("target_share > 0 and max_repeats >= 1")
    sized = scratch(sized.join(small(usable.select("source")), "source", "left_semi"), "sized")
    hist = sized.groupBy("source", "tokens").agg(F.count("*").alias("n_docs"))
    have = hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_docs")).alias("available"), F.sum("n_docs").alias("n_docs")).join(usable, "source")
    rows = have.collect()  # as many rows as usable targets, with what each has
    whole = math.fsum(r.target_share for r in rows)
    size = min((r.available * r.max_repeats / (r.target_share / whole) for r in rows), default=0.0)
    budgets = [(r.source, int(min(size * (r.target_share / whole), r.available * r.max_repeats) + 0.5), int(r.max_repeats), r.target_share / whole) for r in rows]
    spark = documents.sparkSession
    budget = spark.createDataFrame(budgets, "source string, budget bigint, max_repeats bigint, attainable_share double")
    plan = hist.join(small(budget), "source").groupBy("source").applyInPandas(_plan, "source string, tokens bigint, rounds bigint, extra bigint")
    plan = scratch(plan, "plan")
    # the first `extra` documents of each (source, tokens) by seeded hash, by way of hash buckets
    marked = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("b", F.shiftrightunsigned("h", 52))
    per_bucket = marked.groupBy("source", "tokens", "b").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("source", "tokens").orderBy("b")) - F.col("m")
    quota = per_bucket.withColumn("before", before).join(plan, ["source", "tokens"]).select("source", "tokens", "b", "rounds", (F.col("extra") - F.col("before")).alias("quota"))
    ranked = marked.withColumn("rn", F.row_number().over(Window.partitionBy("source", "tokens", "b").orderBy("h", "doc_id"))).join(quota, ["source", "tokens", "b"])
    times = F.col("rounds") + F.when(F.col("rn") <= F.col("quota"), 1).otherwise(0)
    taken = ranked.select("doc_id", "source", "tokens", times.alias("times")).where("times > 0")
    used = plan.join(hist, ["source", "tokens"]).groupBy("source").agg(
        F.sum(F.col("tokens") * (F.col("rounds") * F.col("n_docs") + F.col("extra"))).alias("used_tokens"), F.sum(F.col("rounds") * F.col("n_docs") + F.col("extra")).alias("used_docs")
    )
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # over the few target rows
    shares = (
        wanted.join(have.select("source", "available", "n_docs"), "source", "left").join(budget.select("source", "budget", "attainable_share"), "source", "left").join(used, "source", "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("available", F.lit(0)).alias("available_tokens"),
            F.coalesce("budget", F.lit(0)).alias("budget_tokens"), "used_tokens", F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
            F.coalesce("attainable_share", F.lit(0.0)).alias("attainable_share"), F.coalesce(F.col("used_tokens") / F.nullif(all_used, F.lit(0)), F.lit(0.0)).alias("actual_share"),
        )
    )
    return taken, shares


def taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))[1]
