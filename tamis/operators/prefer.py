"""Preferences learned from decisions: weights of words, and what they add to a posting's score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_support(decided: DataFrame, tokens: Column) -> DataFrame:
    """word, applied, dismissed: decisions of each kind whose text holds the word."""
    words = decided.select("kind", F.explode(tokens).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col("kind") == "applied").alias("applied"), F.count_if(F.col("kind") == "dismissed").alias("dismissed"))


def fit(support: DataFrame, decided: DataFrame, least: int = 2, sure: int = 4, scale: float = 4.0, smallest: float = 1.0, activate: int = 4) -> DataFrame:
    """word and weight: how one-sided a word is, times how often it was met, up to scale.

    No word has a weight while there are fewer than ``activate`` decisions.
    """
    support = support.where(decided.agg(F.count("*")).scalar() >= activate)
    n = F.col("applied") + F.col("dismissed")
    weight = (F.col("applied") - F.col("dismissed")) / n * F.least(n, F.lit(sure)) / sure * scale
    return support.where(n >= least).select("word", F.round(weight, 2).alias("weight")).where(F.abs("weight") >= smallest)


def apply(postings: DataFrame, key: str, tokens: Column, weights: DataFrame, low: int = -15, high: int = 12) -> DataFrame:
    """key, total, delta (it rounded) and the two strongest words for and against, of each posting; 0 without a weighted word.

    Weights are met by a join on the word; each posting's sum is combined before the shuffle.
    """
    met = postings.select(key, F.explode(tokens).alias("word")).join(weights, "word")
    total = F.greatest(F.lit(low), F.least(F.lit(high), F.sum("weight")))
    top = lambda c, sign: F.transform(F.slice(F.sort_array(F.collect_list(F.when(c, F.struct((sign * F.col("weight")).alias("w"), "word")))), 1, 2), lambda x: x["word"])
    sums = met.groupBy(key).agg(total.alias("total"), top(F.col("weight") > 0, -1).alias("liked"), top(F.col("weight") < 0, 1).alias("disliked"))
    none = F.array().cast("array<string>")
    every = postings.select(key).join(sums, key, "left").withColumns({"total": F.coalesce("total", F.lit(0.0)), "liked": F.coalesce("liked", none), "disliked": F.coalesce("disliked", none)})
    return every.select(key, "total", F.floor(F.col("total") + 0.5).cast("int").alias("delta"), "liked", "disliked")


def top_share(df: DataFrame, value: str) -> DataFrame:
    """Percent of the largest and of all, over a small aggregated table."""
    everything = Window.partitionBy()
    return df.withColumns({"of_max": F.col(value) * 100.0 / F.max(value).over(everything), "of_all": F.col(value) * 100.0 / F.sum(value).over(everything)})
