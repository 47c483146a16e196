"""Exact dedup by a tree merge of sorted digest runs.

Rows are dealt to 256 runs by their ids and digests. A run holds the best row of each of its
digests, in the digests' order. In every round sixteen runs are merged into one, which keeps
the best row of each digest, until one run is left.

Runs lie in tables that are bucketed by the digest, each bucket sorted by digest and by the
run that its rows will belong to. So the children of a run lie interleaved in one sorted
file of each bucket, and merging them is one pass over it: a round neither exchanges nor
sorts what it reads. The last run is joined to the first ones in the same way, bucket by
bucket, and what it says goes from there to every row. No task meets more of one digest
than a 256th of its rows, so a text that a third of all rows share is no hot spot.

Digests are verified at every level: a second, independent hash and the normalised length
must agree among rows of one SHA-256, or the job stops.

Texts are equal when identical after the normalisation. The row with most code points in
its original text stays, then the one with the smallest id. Defined results: a null text
counts as empty; all empty texts are equal; a null id ranks after all others; of rows
repeated with one id and text one stays, and each of them gets a row in the result; other
columns are carried by :func:`distinct_rows` whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, discard, shared_path, text_or_empty, without, written

FAN_IN_BITS = 4
ROUNDS = 2
CLASH = "two texts share a SHA-256 digest"
#: Columns by which the better of two rows sorts first.
RANK = ("short", "no_id", "doc_id", "text_key")


def without_space(text: Column) -> Column:
    return F.translate(text, ASCII_SPACE, "")


def digests(docs: DataFrame, runs: int) -> DataFrame:
    """What the merge needs of each row: 32 bytes of digest instead of the text."""
    text = text_or_empty()
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.char_length(text).alias("n_chars"), without_space(text).alias("norm"))
    return made.select(
        F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        (-F.col("n_chars")).alias("short"),
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        "text_key",
        F.struct(F.xxhash64("norm").alias("hash"), F.octet_length("norm").alias("size")).alias("proof"),
    )


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark counts on the order of a bucket that is one file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run_table(df: DataFrame, name: str, buckets: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df, which has one partition a bucket, as a bucketed and sorted table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*order).saveAsTable(table)
    out = df.sparkSession.table(table)
    out.written_to, out.table = path, table
    return out


def _drop(*tables: DataFrame) -> None:
    for t in tables:
        t.sparkSession.sql(f"drop table if exists {t.table}")
    discard(*tables)


def _merged(level: DataFrame, *keys: str) -> DataFrame:
    """The best row of each key, its count and its proof, by one pass over sorted buckets; a count only of rows that agree."""
    out = level.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.min("proof").alias("lo"), F.max("proof").alias("hi"))
    return out.select(*keys, "best", F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(F.raise_error(F.lit(CLASH))).alias("n"), F.col("lo").alias("proof"))


def merge(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest, keep_id, group_size and kept of every row, as a written table."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    up = F.shiftright("run", FAN_IN_BITS).alias("up")
    with _sorted_buckets(spark):
        rows = digests(docs, 1 << (FAN_IN_BITS * ROUNDS)).repartition(buckets, "run", "digest")
        rows = _run_table(rows, "digest-rows", buckets, ("run", "digest"), ("run", "digest", *RANK))
        best = F.struct(*RANK, F.col("run").alias("leaf")).alias("best")
        level = _merged(rows.select("run", "digest", best, F.lit(1).alias("n"), "proof"), "run", "digest")
        level = _run_table(level.withColumn("up", up).repartition(buckets, "digest"), "digest-runs", buckets, ("digest",), ("digest", "up"))
        levels = [level]
        for _ in range(ROUNDS - 1):
            level = _merged(level, "digest", "up").withColumnRenamed("up", "run").withColumn("up", up)
            level = _run_table(level, "digest-runs", buckets, ("digest",), ("digest", "up"))
            levels.append(level)
        top = _merged(level, "digest").select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.leaf").alias("keep_leaf"), F.col("n").alias("group_size"))
        known = levels[0].select("run", "digest").join(top, "digest")
        nth = F.row_number().over(Window.partitionBy("run", "digest").orderBy(*RANK))
        joined = rows.select("run", "digest", *RANK).withColumn("nth", nth).join(known, ["run", "digest"])
        kept = (F.col("nth") == 1) & (F.col("run") == F.col("keep_leaf"))
        out = written(joined.select("doc_id", "text_key", "digest", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept")), "digest-groups")
        _drop(rows, *levels)
    return out


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, columns and all; the texts of rows that stay needn't move."""
    merged = merge(docs)
    drop = merged.groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    drop = written(drop.where("n > 1 or not stays").select("id", "text_key", "stays"), "digest-drop")
    discard(merged)
    return without(docs, drop)
