"""Mixing sources to target weights by Poisson replication.

Each document has a uniform number from a hash of its id and the seed. Inverting the Poisson distribution of its
source's mean repetition rate at that number gives how often it is used, never more than the source's cap. The rate
is found from the sizes of all documents so that the source reaches its share: with a document's number fixed, its
count only grows with the rate, so one histogram of the tokens over the numbers, summed in one pass, gives the size
that any rate leads to, and the rate for the wanted size is found in it by bisection, source by source.

The mixture's size is a parameter, SIZE times the usable tokens if none is given, so it grows as the input does. A
source that has too little for its share even at its cap is used up to the cap, stays short, and shares() reports it.

Documents with null or empty text, and sources without a positive target, stay out. A target without any document
reaches 0. Repeated ids count once, as the row with the least source and size. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovework.llm.encoding import RANKS, token_counts
from trovework.session import written

#: The mixture's tokens as a part of the usable ones.
SIZE = 0.15
#: Bins of the histogram a source, of equal width in u.
BINS = 1 << 14
#: The targets are a list that people keep: more sources than this are refused, as the list is broadcast.
MOST_SOURCES = 100_000


def _uniform(seed: int, *cols: str) -> F.Column:
    """In the open interval (0, 1), from the upper 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_count(u: F.Column, rate: F.Column, cap: F.Column) -> F.Column:
    """The least k with P(X <= k) >= u for X of that Poisson rate, at most cap; terms are summed from their logarithms, so high rates don't underflow."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest(cap, F.lit(1))),
        F.struct((-rate).alias("l"), F.exp(-rate).alias("c"), F.lit(0).alias("k")),
        lambda a, i: F.struct((a["l"] + F.log(rate) - F.log(i)).alias("l"), (a["c"] + F.exp(a["l"] + F.log(rate) - F.log(i))).alias("c"), (a["k"] + (u > a["c"]).cast("int")).alias("k")),
        lambda a: a["k"],
    )
    return F.when(rate > 0, F.least(step, cap)).otherwise(F.lit(0))


def counts_at(u: np.ndarray, rate: float, cap: int) -> np.ndarray:
    """As poisson_count(), for many u."""
    if rate <= 0:
        return np.zeros(len(u), dtype=np.int64)
    i = np.arange(cap)
    logs = i * math.log(rate) - rate - np.array([math.lgamma(x + 1) for x in i])
    return np.searchsorted(np.cumsum(np.exp(logs)), u, side="left")


def targets_of(targets: DataFrame) -> DataFrame:
    """source, target_share and max_repeats of the targets that ask for something."""
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("target_share > 0 and max_repeats > 0")
    if t.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    return t


def sized(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str = RANKS) -> DataFrame:
    """The documents that may be used: doc_id, source, n_tokens and u. Texts are counted where they are read; only sizes are shuffled."""
    keep = docs.select("doc_id", "source", "text").where(F.col("text").isNotNull() & (F.col("text") != ""))
    keep = keep.join(F.broadcast(targets_of(targets).select("source")), "source", "left_semi")
    one = token_counts(keep, path=path).where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r"))
    return one.select("doc_id", "r.source", "r.n_tokens", _uniform(seed, "doc_id").alias("u"))


def rates(docs: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """For each target: source, target_share, max_repeats, tokens (usable), wanted (tokens) and rate.

    docs is sized(). The histogram has at most BINS rows a source; the rate of a source is sought in one group of these.
    """
    t = targets_of(targets)
    bins = docs.groupBy("source", F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("n_tokens").alias("n"), (F.sum(F.col("u") * F.col("n_tokens")) / F.sum("n_tokens")).alias("u"))
    bins = written(bins, "histogram")
    usable = bins.groupBy("source").agg(F.sum("n").alias("tokens"))
    all_of = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usable"))
    t = t.join(F.broadcast(usable), "source", "left").crossJoin(F.broadcast(all_of))  # one row
    total = F.lit(float(size)) if size is not None else F.col("usable") * F.lit(SIZE)
    weight = F.col("target_share") / t.agg(F.sum("target_share")).first()[0] if t.take(1) else F.lit(0.0)
    t = t.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (weight * total).alias("wanted"))

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        cap, wanted = int(b["max_repeats"].iloc[0]), float(b["wanted"].iloc[0])
        u, n = b["u"].to_numpy(), b["n"].to_numpy(np.float64)
        reached = lambda r: float((n * counts_at(u, r, cap)).sum())
        # at rate 0 nothing is used, from this high rate on nearly all documents up to their cap
        low, high = 0.0, 4.0 * cap + 40.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if reached(mid) >= wanted else (mid, high)
        nearest = low if abs(reached(low) - wanted) < abs(reached(high) - wanted) else high
        return pd.DataFrame({"source": [b["source"].iloc[0]], "rate": [nearest]})

    found = bins.join(F.broadcast(t.select("source", "max_repeats", "wanted")), "source").groupBy("source").applyInPandas(solve, "source string, rate double")
    return written(t.join(F.broadcast(found), "source", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0))), "rates")


def draw(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str = RANKS, size: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the plan of each source.

    The first has doc_id, source, n_tokens and repeats (at least 1). Rates and sizes are written to the shared folder.
    """
    have = written(sized(docs, targets, seed, path), "sized")
    plan = rates(have, targets, size)
    chosen = have.join(F.broadcast(plan.select("source", "rate", "max_repeats")), "source").withColumn("repeats", poisson_count(F.col("u"), F.col("rate"), F.col("max_repeats")))
    return chosen.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), plan


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str = RANKS, size: float | None = None) -> DataFrame:
    """The mixture itself: a row for each use of a document, doc_id, source, n_tokens and copy (from 1), shuffled globally by a hash."""
    chosen, _ = draw(docs, targets, seed, path, size)
    rows = chosen.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).repartition("shuffle_key").sortWithinPartitions("shuffle_key").drop("shuffle_key")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 7, path: str = RANKS, size: float | None = None) -> DataFrame:
    """source, target_share, actual_share, tokens, documents and the greatest number of repeats, for each target."""
    chosen, plan = draw(docs, targets, seed, path, size)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    return plan.select("source", "target_share", "max_repeats").join(F.broadcast(got), "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats",
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
