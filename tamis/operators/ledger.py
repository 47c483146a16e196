"""The decision ledger: append-only events from which current sets, upserts and transitions follow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import StoredTable

#: An entry of a stored ledger: what was done to a key, when, and until when that holds.
ENTRY = "kind string, key string, op string, ts timestamp, event_id bigint, expires_at timestamp"


def live(ledger: DataFrame, as_of: Column, ttl_hours: Mapping[str, int], key: str) -> DataFrame:
    """kind and key of entries whose latest event lies within the kind's time to live."""
    last = ledger.where(F.col("kind").isin(*ttl_hours)).groupBy("kind", key).agg(F.max("ts").alias("ts"))
    age = F
    for kind, hours in ttl_hours.items():
        age = age.when(F.col("kind") == kind, hours)
    return last.where(F.col("ts") > as_of - F.make_dt_interval(hours=age.otherwise(0)))


def with_expiry(ledger: DataFrame, hours: Column) -> DataFrame:
    """expires_at on each row, so that a later prune can't shorten a row's life."""
    return ledger.withColumn("expires_at", F.col("ts") + F.make_dt_interval(hours=hours))


def current(ledger: DataFrame, key: Sequence[str], op: str = "op", remove: str = "remove") -> DataFrame:
    """Keys whose last operation isn't a removal."""
    last = ledger.groupBy(*key).agg(F.max_by(op, F.struct("ts", "event_id")).alias("last_op"), F.max("ts").alias("ts"))
    return last.where(F.col("last_op") != remove)


def upsert(changes: DataFrame, key: str, replace: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the replaced columns from the last change, all others from the first."""
    at = F.struct(*order)
    first = [F.min_by(c, at).alias(c) for c in changes.columns if c not in (key, *replace)]
    return changes.groupBy(key).agg(*first, *[F.max_by(c, at).alias(c) for c in replace])


def first_write(ledger: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Set-if-absent: the first row of each key stays."""
    return ledger.groupBy(key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in columns])


def newest_per(ledger: DataFrame, per: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The newest rows of each class, with their place.

    Spark bounds the rows of each class within every task before the shuffle, so a class
    with most of the rows costs no more than another.
    """
    return ledger.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("place") <= most)


def transitions(events: DataFrame, key: str) -> DataFrame:
    """Each decision with the status before it: open at first, open again after a reversal."""
    status = F.when(F.col("kind") == "reverted", "open").otherwise(F.col("kind"))
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("status", status).withColumn("before", F.coalesce(F.lag("status").over(w), F.lit("open")))


def followups_due(applied: DataFrame, reminded: DataFrame, as_of: Column, key: str, days: int = 7, slack_hours: int = 20) -> DataFrame:
    """Applications about so many days old of which nobody was reminded."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("ts")
    due = applied.where(F.abs(age - days * 86400) <= slack_hours * 3600)
    return due.join(reminded.select(key).distinct(), key, "left_anti")


def repair_urls(rows: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Broken urls rewritten, unless a row with the repaired url exists already."""
    broken = rows.where(F.col("url").rlike(pattern)).withColumn("repaired", F.regexp_replace("url", pattern, replacement))
    return broken.join(rows.select(F.col("url").alias("repaired")).distinct(), "repaired", "left_anti")


# Tables that outlive a run.


def stored_ledger(spark: SparkSession, path: str, buckets: int = 64) -> StoredTable:
    """The ledger at a path: append puts entries into it, compact_ledger keeps it small."""
    return StoredTable(spark, path, StructType.fromDDL(ENTRY), ["kind", "key"], buckets)


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each kind and key."""
    rest = [c for c in entries.columns if c not in ("kind", "key")]
    last = entries.groupBy("kind", "key").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("e"))
    return last.select("kind", "key", "e.*")


def unexpired(entries: DataFrame, as_of: Column) -> DataFrame:
    """Last entries whose own life isn't over; removals too, so that an older entry that comes late stays removed."""
    return latest(entries).where(F.coalesce(F.col("expires_at") > as_of, F.lit(True)))


def members(entries: DataFrame, as_of: Column) -> DataFrame:
    """Kind and key of what is in the ledger's sets."""
    return unexpired(entries, as_of).where("op != 'remove'").select("kind", "key", "ts", "expires_at")


def compact_ledger(store: StoredTable, as_of: Column) -> None:
    """One entry a key, none that is over; what a reader finds doesn't change."""
    store.compact(lambda rows: unexpired(rows, as_of))


def _placed(old: DataFrame, new: DataFrame, order: Sequence[str]) -> tuple[DataFrame, Column]:
    at = F.struct(*[F.col(c) for c in order])
    rows = old.select(*old.columns, F.lit(0).alias("_new"), F.lit(None).cast(new.select(at.alias("o")).schema["o"].dataType).alias("_at"))
    return rows.unionByName(new.select(*old.columns, F.lit(1).alias("_new"), at.alias("_at"))), F.struct("_new", "_at")


def upsert_into(store: StoredTable, changes: DataFrame, replace: Sequence[str], order: Sequence[str], batch: tuple[str, int] | None = None) -> None:
    """Changes into a stored table, one row a key: the replaced columns from the last change, all others from what is stored, or else from the first change."""

    def fold(old: DataFrame, new: DataFrame) -> DataFrame:
        rows, place = _placed(old, new, order)
        rest = [c for c in store.schema.names if c not in store.key]
        return rows.groupBy(*store.key).agg(*[(F.max_by if c in replace else F.min_by)(c, place).alias(c) for c in rest])

    missing = [c for c in order if c not in store.schema.names]
    if missing:
        raise ValueError(f"the stored table has no {missing} to order changes by")
    store.merge(changes, fold, batch)


def insert_absent(store: StoredTable, rows: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None) -> None:
    """Rows of keys that the stored table doesn't have yet, the first of each: first write wins, and a backfill."""
    upsert_into(store, rows, (), order, batch)


def repair_stored(store: StoredTable, column: str, pattern: str, replacement: str, order: Sequence[str]) -> None:
    """Rewrite the values of a column that match a pattern, in the stored rows.

    As under a unique index, a row whose repaired value another row has already stays as it
    is, and of several that would get the same value the first in order gets it.
    """
    rows = store.read()
    broken = rows.where(F.col(column).rlike(pattern)).withColumn("_to", F.regexp_replace(column, pattern, replacement))
    free = broken.join(rows.select(F.col(column).alias("_to")).distinct(), "_to", "left_anti")
    first = free.groupBy("_to").agg(F.min_by(F.struct(*store.schema.names), F.struct(*order)).alias("r"))
    fixed = first.select(*[F.col("_to").alias(column) if c == column else F.col(f"r.{c}").alias(c) for c in store.schema.names])
    upsert_into(store, fixed, (column,), order)


def bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Rows as a table of the catalog in buckets of a key, sorted, one file a bucket: what joins on the key needn't deal out again."""
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)
    return rows.sparkSession.table(table)


def unseen(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key a long history doesn't hold.

    With a history that ``bucketed`` wrote, with at least as many buckets as shuffle partitions,
    only the rows are exchanged; where they are bucketed alike, nothing is.
    """
    return rows.join(history.select(key), key, "left_anti")
