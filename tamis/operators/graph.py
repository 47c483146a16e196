"""Joins that deal a hot key to many tasks or pass over rows without a partner, and connected components in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import discard, written


def spread_join(rows: DataFrame, values: DataFrame, key: str, salt: Column, salts: int = 64, how: str = "inner") -> DataFrame:
    """rows (a written table) joined to values (one row a key), inner or left, a hot key's rows in up to so many parts.

    Only the distinct pairs of key and salt meet values, so a key has at most ``salts`` rows
    in that join, and each of its parts one partner in the other.
    """
    cell = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    of = cell.select(key, "_salt").distinct().join(values, key)
    return cell.join(of, [key, "_salt"], how).drop("_salt")


def possible(rows: DataFrame, keys: DataFrame, key: str, of: str | None = None) -> DataFrame:
    """The rows whose key may be among keys (a written table with a column of, or key): all that are, and some others.

    What is broadcast has a bound whatever the size of keys: 2^17 words of 64 bits, of which a
    hash of each key sets one. So rows that surely lack a partner aren't shuffled for a join
    that decides; the more keys there are, the more others pass.
    """
    place = lambda name: F.xxhash64(name, F.lit("possible"))
    word = lambda name: place(name).bitwiseAND(F.lit((1 << 17) - 1))
    bit = lambda name: F.shiftrightunsigned(place(name), 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(of or key))
    words = keys.groupBy(word(of or key).alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.withColumn("_word", word(key)).join(F.broadcast(words), "_word")
    return met.where(F.getbit("_bits", bit(key)) == 1).drop("_word", "_bits")


def both_ways(edges: DataFrame) -> DataFrame:
    """v and u: every edge (lo, hi) from either end."""
    return edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionByName(edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")))


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller one, which has none itself."""
    ends = both_ways(edges).groupBy("v").agg(F.count_if(F.col("u") < F.col("v")).alias("below"), F.count_if(F.col("u") > F.col("v")).alias("above"))
    return ends.where("below > 1 or below > 0 and above > 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v and root: the smallest vertex of the component of every vertex that has an edge.

    Large-star and small-star rounds by turns: every vertex hands its larger, then its
    smaller neighbours to the smallest one it knows, until only stars are left. Each round is
    a written table; only whether another one is needed comes to the driver.
    """
    edges = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo != hi").distinct(), "components")
    while not are_stars(edges):
        both = both_ways(edges)
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = spread_join(both.where("u > v"), least, "v", F.col("u")).select(F.col("m").alias("lo"), F.col("u").alias("hi")).where("lo != hi").distinct()
        # Small-star: v is the larger end of each edge, so its neighbours are the smaller ones.
        large = written(large, "components")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = spread_join(large, least, "hi", F.col("lo"))
        small = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), "hi"))
        old, edges = edges, written(small.where("lo != hi").distinct(), "components")
        discard(old, large)
    lone = edges.select(F.col("lo").alias("v"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("v"), F.col("lo").alias("root")).unionByName(lone)
