"""Quality of ranked results, comparison of modes, and use of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_quality(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id, p_at_k for each k, recall: results has query_id, doc, rank; relevant has query_id, doc.

    The share at k is of the rows there are, at most k; recall is 0 where nothing is relevant.
    """
    rel = relevant.select("query_id", "doc", F.lit(1).alias("hit")).distinct()
    r = results.join(rel, ["query_id", "doc"], "left").groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), *[F.count(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1)).alias(f"h{k}") for k in ks])
    total = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    r = r.join(total, "query_id", "left")
    return r.select("query_id", *[(F.col(f"h{k}") / F.least(F.lit(k), F.col("n"))).alias(f"p_at_{k}") for k in ks], F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0)).alias("recall"))


def improvement(old: float, new: float) -> float:
    if old == 0:
        return 100.0 if new > 0 else 0.0
    return (new - old) / old * 100


def best_mode(quality: DataFrame) -> DataFrame:
    """query_id and mode with the best share at 10; ties go to hybrid, then by name. quality has query_id, mode, p_at_10."""
    first = F.struct(F.col("p_at_10"), (F.col("mode") == "hybrid").cast("int"), F.col("mode"))
    return quality.groupBy("query_id").agg(F.max_by("mode", first).alias("mode"))


def recommended_weights(keyword: float, vector: float, hybrid: float, current: tuple[float, float] = (0.6, 0.4), margin: float = 0.1) -> tuple[float, float]:
    """Weights for both legs by their mean shares at 10."""
    if keyword > vector + margin:
        return (0.7, 0.3)
    if vector > keyword + margin:
        return (0.4, 0.6)
    return (0.6, 0.4) if hybrid >= max(keyword, vector) else current


def compared(quality: DataFrame) -> DataFrame:
    """query_id, each mode's share at 10, the best mode, and by how many per cent hybrid is better than keyword. quality has query_id, mode, p_at_10."""
    shares = quality.groupBy("query_id").pivot("mode", ["keyword", "vector", "hybrid"]).agg(F.first("p_at_10"))
    old, new = F.coalesce("keyword", F.lit(0.0)), F.coalesce("hybrid", F.lit(0.0))
    gain = F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise((new - old) / old * 100)
    return shares.join(best_mode(quality).withColumnRenamed("mode", "best"), "query_id").withColumn("improvement", gain)


def weights(quality: DataFrame, current: tuple[float, float] = (0.6, 0.4), margin: float = 0.1) -> DataFrame:
    """One row: the mean share at 10 of each mode, how often each is best, and the weights of both legs that follow."""
    c = compared(quality)
    r = c.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("keyword", "vector", "hybrid")], *[F.count(F.when(F.col("best") == m, 1)).alias(f"{m}_wins") for m in ("keyword", "vector", "hybrid")])
    k, v, h = F.col("keyword"), F.col("vector"), F.col("hybrid")
    first = F.when(k > v + margin, 0.7).when(v > k + margin, 0.4).when(h >= F.greatest(k, v), 0.6).otherwise(current[0])
    return r.withColumn("keyword_weight", first).withColumn("vector_weight", F.round(1 - first, 6))


def vector_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: vectors, those that are null or empty, numbers in all, and the sizes there are."""
    n = F.greatest(F.size(column), F.lit(0))
    return vectors.agg(F.count("*").alias("vectors"), F.count(F.when(n == 0, 1)).alias("empty"), F.sum(n).cast("bigint").alias("numbers"), F.min(n).alias("least"), F.max(n).alias("most"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each provider and model; repeated rows count once, missing numbers as 0."""
    one = calls.dropDuplicates(["usage_id"])
    name = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")).alias(c)
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return one.groupBy(name("provider"), name("model")).agg(F.count("*").alias("calls"), n("input_tokens"), n("output_tokens"), F.round(n("cost_estimate"), 6).alias("cost"))


def recent(calls: DataFrame, limit: int = 100) -> DataFrame:
    """The last calls, newest first."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return calls.dropDuplicates(["usage_id"]).orderBy(F.desc("completed_at"), "usage_id").limit(limit)


def usage_by_window(calls: DataFrame, length: str = "1 day") -> DataFrame:
    one = calls.dropDuplicates(["usage_id"])
    return one.groupBy(F.window("completed_at", length)).agg(F.count("*").alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens")).select(F.col("window.start").alias("window_start"), "calls", "input_tokens")


def running_cost(calls: DataFrame) -> DataFrame:
    """provider, day, the day's cost and the cost up to that day: sums of days first, so that the window sorts days, not calls."""
    one = calls.dropDuplicates(["usage_id"]).withColumn("day", F.to_date("completed_at"))
    days = one.groupBy("provider", "day").agg(F.sum(F.coalesce("cost_estimate", F.lit(0.0))).alias("cost"))
    w = Window.partitionBy("provider").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("provider", "day", F.round("cost", 6).alias("cost"), F.round(F.sum("cost").over(w), 6).alias("running_cost"))
