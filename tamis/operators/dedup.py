"""Keep-first and keep-last dedup by one key or two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .stages import discard, written


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def merge_by_key(df: DataFrame, key: str, ordinal: str, keep: str = "last") -> DataFrame:
    """One row a key at its first position, with the payload of its last (or first) row; partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in (key, ordinal)]
    pick = F.max_by if keep == "last" else F.min_by
    got = df.groupBy(key).agg(F.min(ordinal).alias(ordinal), pick(F.struct(*rest), F.col(ordinal)).alias("_row"))
    return got.select(key, ordinal, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _firsts(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.groupBy("a").agg(F.min("o").alias("fa")), left.groupBy("b").agg(F.min("o").alias("fb"))


def _without(left: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (o, a, b) that share neither key with a kept one."""
    rest = left.join(kept.select(F.col("a").alias("ka")), F.col("a").eqNullSafe(F.col("ka")), "left_anti")
    return rest.join(kept.select(F.col("b").alias("kb")), F.col("b").eqNullSafe(F.col("kb")), "left_anti")


def _folded(left: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The kept rows of components of at most so many rows, each found in order in one expression; the rows of larger ones."""
    first_a, first_b = _firsts(left)
    # A key's first row stands for it: a number without nulls.
    first_a, first_b = first_a.withColumnRenamed("a", "ka"), first_b.withColumnRenamed("b", "kb")
    ids = left.join(first_a, F.col("a").eqNullSafe(F.col("ka"))).join(first_b, F.col("b").eqNullSafe(F.col("kb")))
    ids = written(ids.select("o", "a", "b", "fa", "fb"), "two-key-ids")
    ends = ids.select(F.xxhash64(F.lit("a"), "fa").alias("x"), F.xxhash64(F.lit("b"), "fb").alias("y"))
    roots = components(ends, "x", "y").select(F.col("v").alias("x"), "root")
    held = ids.withColumn("x", F.xxhash64(F.lit("a"), "fa"))
    size = held.groupBy("x").agg(F.count("*").alias("n")).join(roots, "x").groupBy("root").agg(F.sum("n").alias("rows"))
    placed = written(held.join(roots.join(size, "root"), "x").drop("x"), "two-key-parts")
    discard(ids)
    start = F.struct(*[F.array().cast("array<bigint>").alias(c) for c in ("fa", "fb")], F.array().cast("array<int>").alias("at"))
    met = lambda acc, r: F.array_contains(acc["fa"], r["fa"]) | F.array_contains(acc["fb"], r["fb"])
    more = lambda acc, r: F.struct(F.array_append(acc["fa"], r["fa"]).alias("fa"), F.array_append(acc["fb"], r["fb"]).alias("fb"), F.array_append(acc["at"], r["at"]).alias("at"))
    rows = F.array_sort(F.collect_list(F.struct("o", "fa", "fb", "a", "b")))
    listed = placed.where(F.col("rows") <= most).groupBy("root").agg(rows.alias("r"))
    number = F.transform("r", lambda r, i: F.struct(r["fa"].cast("bigint").alias("fa"), r["fb"].cast("bigint").alias("fb"), (i + 1).cast("int").alias("at")))
    picks = F.aggregate(number, start, lambda acc, r: F.when(met(acc, r), acc).otherwise(more(acc, r)), lambda acc: acc["at"])
    kept = listed.select("r", F.explode(picks).alias("at")).select(F.element_at("r", F.col("at")).alias("r")).select("r.o", "r.a", "r.b")
    return written(kept, "two-key-folded"), written(placed.where(F.col("rows") > most).select("o", "a", "b"), "two-key")


def two_key_dedup(df: DataFrame, key_a: str, key_b: str, order: str, *, rounds: int = 3, most: int = 20_000) -> DataFrame:
    """Rows whose keys are both new among the kept rows before them, by a whole number without nulls or ties.

    A dropped row doesn't register its other key, so two windows don't say this. In rounds,
    every undecided row that is the first of both its groups is kept, and undecided rows
    that share a key with a kept row go. That decides most rows, but a chain of rows that block
    each other takes a round a link. So after a few rounds what is undecided is split into
    connected components (rows that share keys), and each of up to ``most`` rows is gone through in
    order in one expression; rounds go on for larger ones, which what was decided has taken apart,
    and so by turns. Firsts come from aggregations that combine before the shuffle, the state
    is a written table, and only whether rows are left comes to the driver.
    """
    ids = written(df.select(F.col(order).cast("bigint").alias("o"), F.col(key_a).alias("a"), F.col(key_b).alias("b")), "two-key")
    if not ids.groupBy("o").agg(F.count("*").alias("n")).where("o is null or n > 1").isEmpty():
        raise ValueError(f"{order} must order the rows: it holds nulls or ties")
    left, kept, number = ids, None, 0
    while not left.isEmpty():
        number += 1
        if number % (rounds + 1):
            first_a, first_b = _firsts(left)
            now = written(first_a.join(first_b, F.col("fa") == F.col("fb")).select(F.col("fa").alias("o"), "a", "b"), "two-key-kept")
            rest = written(_without(left, now), "two-key")
        else:
            now, rest = _folded(left, most)
        kept = now if kept is None else kept.unionByName(now)
        discard(left)
        left = rest
    if kept is None:
        return df.limit(0)
    return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")
