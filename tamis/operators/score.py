"""Scores: points of signals and components, their sum, reasons, second opinions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, hits


def signal_points(text: Column, signals: Sequence[tuple[str, int, str]]) -> tuple[Column, Column]:
    """Points of the signals in a text, and their reasons."""
    low = F.lower(text)
    points, reasons = F.lit(0), []
    for term, weight, reason in signals:
        hit = F.contains(low, F.lit(term))
        points = points + F.when(hit, weight).otherwise(0)
        reasons.append(F.when(hit, F.lit(reason)))
    return points, F.array_compact(F.array(*reasons))


def keyword_points(text: Column, keywords: Sequence[str], groups: Sequence[Sequence[str]]) -> Column:
    """Three points a keyword up to 18, six for each group with a word in the text."""
    low = F.lower(text)
    out = F.least(hits(low, keywords) * 3, F.lit(18))
    for g in groups:
        out = out + F.when(any_of(low, g), 6).otherwise(0)
    return out


def startup_points(flag: Column, favoured: Column, phrase: Column, headcount: Column, founded: Column, year: int) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(flag, 8) + points(favoured, 6) + points(phrase, 8) + points(headcount <= 300, 5) + points(founded >= year - 10, 3)


def final_score(parts: dict[str, Column], bonus: Column) -> tuple[Column, Column]:
    """Sum of the parts, held within 0 and 100, plus a bonus up to 100; and the parts as a struct."""
    total = F.lit(0)
    for c in parts.values():
        total = total + c
    held = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return F.least(F.lit(100), held + bonus).cast("int"), F.struct(*[c.cast("int").alias(k) for k, c in parts.items()])


def top_reasons(*lists: Column, most: int = 5) -> Column:
    """The first few reasons of several lists, in order."""
    return F.slice(F.flatten(F.array(*lists)), 1, most)


def reconcile(df: DataFrame, threshold: int = 55, fraud: int = 72) -> DataFrame:
    """df with relevant and reason from code_veto, model_score, model_veto and fraud_score."""
    ladder = (
        F.when(F.col("model_score").isNull(), F.when(F.col("code_veto"), "hard_skip").otherwise("no_model_data"))
        .when(F.col("code_veto") | F.col("model_veto"), "hard_skip")
        .when(F.col("model_score") < threshold, "below_threshold")
        .when(F.col("fraud_score") >= fraud, "suspicious_fraud")
        .otherwise("relevant")
    )
    return df.withColumn("reason", ladder).withColumn("relevant", F.col("reason").isin("relevant", "no_model_data"))


def audit_score(score: Column, veto: Column, default: int = 50) -> Column:
    """A model's score held within 0 and 100; a veto makes it 0 whatever the model said."""
    return F.when(veto, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(score, F.lit(default)))))


def rounded_hundreds(amount: Column) -> Column:
    return (F.floor(amount / 100 + 0.5) * 100).cast("long")


def capped(most: dict[str, int]) -> dict[str, Column]:
    """Lists of a model's output cut to so many entries each; a missing list is empty."""
    return {c: F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, n) for c, n in most.items()}
