"""URL filters by a temporal list join.

List entries carry dates: a pattern is added to a list on one day and removed on another.
They become validity intervals, and every capture is judged by the entries that were active
when it was fetched, not by today's list. A pattern is a domain and covers its subdomains.

A verdict depends on host and fetch time alone, so it is made once for each pair of them and
then joined to the captures; the pairs of a hot host are as many as its fetch times. The
as-of join is an equality join on the domain with a condition on time. A domain that most
hosts share, such as a top-level one, is met by its entries in up to 64 parts, and by no host
if no list names it. No list is broadcast unless Spark has measured it to be small.

Of several entries for one pattern, list and day, a removal wins. Intervals are closed at
their start and open at their end. A pattern on an allow list overrides blocks on shorter or
equal patterns. Defined results: a capture with a null or malformed url has a null host and
isn't blocked; a null fetch time meets no entry; entries with a null list, pattern or day
don't count; repeated captures each get a row; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a url without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still active) from list, pattern, action ('add' or 'remove'), day."""
    known = entries.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    days = known.groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("day")
    changes = days.withColumn("before", F.lag("action").over(w)).where(~F.col("action").eqNullSafe(F.col("before")))
    spans = changes.withColumn("valid_to", F.lead("day").over(w))
    return spans.where("action = 'add'").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def verdicts(visits: DataFrame, spans: DataFrame, allow: str = "allow") -> DataFrame:
    """host, fetched, lists, pattern (the longest active one), blocked, for each distinct host and fetch time that an entry covers."""
    keys = visits.where(F.col("host").isNotNull() & F.col("fetched").isNotNull()).distinct()
    tried = keys.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("domain"))
    tried = tried.withColumn("part", F.pmod(F.xxhash64("host", "fetched"), F.lit(64)).cast("int"))
    listed = tried.select("domain", "part").distinct().join(spans.withColumnRenamed("pattern", "domain"), "domain")
    asof = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    active = tried.join(listed, ["domain", "part"]).where(asof).withColumnRenamed("domain", "pattern")
    size = F.char_length("pattern")
    allowed, blocking = F.when(F.col("list") == allow, size), F.when(F.col("list") != allow, size)
    out = active.groupBy("host", "fetched").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.max_by("pattern", size).alias("pattern"),
        F.coalesce(F.max(blocking), F.lit(0)).alias("block"),
        F.coalesce(F.max(allowed), F.lit(0)).alias("allow"),
    )
    return out.select("host", "fetched", "lists", "pattern", (F.col("block") > F.col("allow")).alias("blocked"))


def evaluate(captures: DataFrame, entries: DataFrame, allow: str = "allow", salts: int = 64) -> DataFrame:
    """page_id, host, fetched, lists, pattern and blocked of every capture (page_id, url, fetched).

    Captures without a host or a time pass beside the join, and those of one host and time, which
    may be many, meet their verdict in up to ``salts`` parts.
    """
    known = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    complete = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    cells = known.where(complete).withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    found = verdicts(known.select("host", "fetched"), intervals(entries), allow)
    told = cells.select("host", "fetched", "part").distinct().join(found, ["host", "fetched"])
    joined = cells.join(told, ["host", "fetched", "part"], "left").select("page_id", "host", "fetched", F.coalesce("lists", F.lit("")).alias("lists"), "pattern", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    beside = known.where(~complete).select("page_id", "host", "fetched", F.lit("").alias("lists"), F.lit(None).cast("string").alias("pattern"), F.lit(False).alias("blocked"))
    return joined.unionByName(beside)
