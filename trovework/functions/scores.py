"""Column functions for scores and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost of 1,000 input and output tokens.
RATES = {"gpt-4": (0.03, 0.06), "gpt-3.5": (0.0005, 0.0015), "opus": (0.015, 0.075), "anthropic": (0.003, 0.015)}


def combined(keyword: Column, vector: Column, keyword_weight: float = 0.6, vector_weight: float = 0.4) -> Column:
    """Both scores weighted; where only one leg found the row, its score as it is."""
    if not (0 <= keyword_weight <= 1 and 0 <= vector_weight <= 1 and abs(keyword_weight + vector_weight - 1) <= 1e-9):
        raise ValueError("weights lie in [0, 1] and sum to 1")
    return F.when(keyword.isNotNull() & vector.isNotNull(), keyword_weight * keyword + vector_weight * vector).otherwise(F.coalesce(keyword, vector))


def min_max(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """score brought to 0..1 within each group; 1 where all are equal. The groups are result lists, so of bounded size."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))


def token_cost_estimate(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 2) / 4).cast("int"))).cast("int")


def cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    p, m = F.lower(F.coalesce(provider, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    i, o = F.coalesce(tokens_in, F.lit(0)), F.coalesce(tokens_out, F.lit(0))
    of = lambda k: (i * F.lit(RATES[k][0]) + o * F.lit(RATES[k][1])) / F.lit(1000.0)
    return (
        F.when(F.contains(p, F.lit("openai")), F.when(F.contains(m, F.lit("gpt-3.5")) | F.contains(m, F.lit("gpt-35")), of("gpt-3.5")).otherwise(of("gpt-4")))
        .when(F.contains(p, F.lit("anthropic")), F.when(F.contains(m, F.lit("opus")), of("opus")).otherwise(of("anthropic")))
        .otherwise(F.lit(0.0))
    )
