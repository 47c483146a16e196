"""Feed health: what a run says of a feed, streaks of failures, order by urgency."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import any_of
from .store import StoredTable

# Parts of error messages.
PROXY_WORDS = ("proxy", "tunnel", "503", "523")
BLOCK_WORDS = ("403", "429", "forbidden", "captcha", "blocked")
#: Most urgent first.
SEVERITY = ("proxy_offline", "error", "blocked", "empty", "ok")


def classify(error: Column, rows: Column, proxied: Column, proxy_down: Column) -> Column:
    """Status of a feed's run."""
    low = F.lower(error)
    return (
        F.when(error.isNotNull() & proxied & any_of(low, PROXY_WORDS), "proxy_offline")
        .when(error.isNotNull() & any_of(low, BLOCK_WORDS), "blocked")
        .when(error.isNotNull(), "error")
        .when((rows == 0) & proxied & proxy_down, "proxy_offline")
        .when(rows == 0, "empty")
        .otherwise("ok")
    )


def streaks(runs: DataFrame, source: str, order: Sequence[str], failed: Column, fruitful: Column) -> DataFrame:
    """Each run with the number of failures in a row up to it, and the last time that it found rows."""
    w = Window.partitionBy(source).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    marked = runs.withColumns({"_failed": failed, "_island": island, "last_success": F.last(F.when(fruitful, F.col("ran_at")), ignorenulls=True).over(w)})
    inside = Window.partitionBy(source, "_island").orderBy(*order)
    return marked.withColumn("failures", F.sum(F.col("_failed").cast("int")).over(inside)).drop("_failed", "_island")


#: What is known of a feed's runs between two times.
SUMMARY = "source string, since timestamp, until timestamp, runs bigint, head bigint, tail bigint, last_success timestamp"


def summaries(runs: DataFrame, source: str, order: Sequence[str], failed: Column, fruitful: Column, slices: Sequence[Column] = ()) -> DataFrame:
    """One row a feed and slice of time (none: all): runs, failures before the first other run and after the last, last success.

    Two such rows that follow each other give the one of both (see ``folded``), so a feed's runs are
    never sorted or gathered in one task: all is summed in the tasks first.
    """
    cut = [c.alias(f"_slice{i}") for i, c in enumerate(slices)]
    by, at = [source, *[f"_slice{i}" for i in range(len(slices))]], F.struct(*order)
    marked = runs.select("*", *cut, at.alias("_at"), F.coalesce(failed, F.lit(False)).alias("_failed"), fruitful.alias("_fruitful"))
    ends = marked.where("not _failed").groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    met = marked.join(ends, functools.reduce(lambda x, y: x & y, same), "left").select(*by, "_at", "ran_at", "_failed", "_fruitful", "_first", "_last")
    count = lambda when: F.count_if(F.col("_failed") & F.coalesce(when, F.lit(True)))
    out = met.groupBy(*by).agg(
        F.min("ran_at").alias("since"),
        F.max("ran_at").alias("until"),
        F.count("*").alias("runs"),
        count(F.col("_at") < F.col("_first")).alias("head"),
        count(F.col("_at") > F.col("_last")).alias("tail"),
        F.max(F.when(F.col("_fruitful"), F.col("ran_at"))).alias("last_success"),
    )
    return out.select(F.col(source).alias("source"), "since", "until", "runs", "head", "tail", "last_success")


def folded(parts: DataFrame) -> DataFrame:
    """Summaries of one feed in the order of their times, as one: in any grouping the same."""
    listed = F.array_sort(F.collect_list(F.struct("since", "until", "runs", "head", "tail", "last_success")))
    both = lambda a, b: F.struct(
        a["since"].alias("since"),
        F.greatest(a["until"], b["until"]).alias("until"),
        (a["runs"] + b["runs"]).alias("runs"),
        F.when(a["head"] < a["runs"], a["head"]).otherwise(a["runs"] + b["head"]).alias("head"),
        F.when(b["tail"] < b["runs"], b["tail"]).otherwise(b["runs"] + a["tail"]).alias("tail"),
        F.greatest(a["last_success"], b["last_success"]).alias("last_success"),
    )
    one = parts.groupBy("source").agg(listed.alias("p"))
    return one.select("source", F.aggregate(F.slice("p", 2, F.size("p")), F.element_at("p", 1), both).alias("s")).select("source", "s.*")


def stored_health(spark: SparkSession, path: str, buckets: int = 16) -> StoredTable:
    return StoredTable(spark, path, StructType.fromDDL(SUMMARY), ["source"], buckets)


def carry(store: StoredTable, parts: DataFrame, batch: tuple[str, int] | None = None) -> None:
    """Put a run's summaries behind those that are stored; runs that begin before the stored ones' end raise."""

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        late = folded(new).select("source", "since").join(old.select("source", "until"), "source").where("since < until")
        if (row := late.first()) is not None:
            raise ValueError(f"runs of {row['source']} from {row['since']} come after later ones were stored")
        return folded(old.unionByName(new))

    store.merge(parts, fold, batch)


def severity(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
