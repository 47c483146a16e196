"""Streams over landed files. Each runs until the files that are there are done.

``at`` names the folder that a stream's results and checkpoint live in: the next call with
the same name and folder goes on where the last one ended, in another session too, and a batch
that failed half-way is repeated without double rows. Without it a stream starts anew, in a
new folder under spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import health, ledger
from ..operators.stages import shared_path as shared
from ..operators.store import StoredTable


def read_files(spark: SparkSession, folder: str, schema, glob: str = "*", per_batch: int = 100) -> DataFrame:
    """Files of a folder as a stream, a bounded number of them in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)


def places(spark: SparkSession, name: str, at: str | None) -> tuple[str, str]:
    """Where a stream's results and its checkpoint are."""
    root = f"{at}/{name}" if at else shared(spark, name)
    return f"{root}/rows", f"{root}/checkpoint"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Write a stream to Parquet until its input is done, and read that.

    The sink's own log names the files of finished batches, and readers follow it, so files
    that a failed batch left don't count.
    """
    spark = stream.sparkSession
    out, state = places(spark, name, at)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if _exists(spark, out) else spark.createDataFrame([], stream.schema)


def run_batches(stream: DataFrame, name: str, put: Callable[[DataFrame, int], None], mode: str = "append", at: str | None = None) -> None:
    """Hand each micro-batch to put, with the number that tells a repeated batch from a new one."""
    state = places(stream.sparkSession, name, at)[1]
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _stored(stream: DataFrame, name: str, at: str | None, schema: StructType, keys: Sequence[str], buckets: int) -> tuple[str, Callable[[SparkSession], StoredTable]]:
    root = at or shared(stream.sparkSession, name)
    return root, lambda spark: StoredTable(spark, f"{root}/{name}/rows", schema, keys, buckets)


def ingest(spark: SparkSession, folder: str, schema, transform: Callable[[DataFrame], DataFrame], glob: str = "*", at: str | None = None, name: str = "ingest") -> DataFrame:
    """New files of a feed through its canonical projection into a table."""
    return run_to_table(transform(read_files(spark, folder, schema, glob)), name, at=at)


def dedup_within(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """The first row of each key; keys are forgotten when they are older than the horizon, so state stays bounded."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], size: str, late: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out once their window is closed."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def run_updates(stream: DataFrame, name: str, keys: list[str], at: str | None = None, buckets: int = 16) -> DataFrame:
    """The last row of each key of an aggregating stream, in a stored table that is as large as its keys are many."""
    spark = stream.sparkSession
    root, store = _stored(stream, name, at, stream.schema, keys, buckets)

    def put(batch: DataFrame, number: int) -> None:
        # An update names each key once, so the new row replaces the old one.
        store(batch.sparkSession).merge(batch, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new), (name, number))

    run_batches(stream, name, put, "update", root)
    return store(spark).read()


def first_writes(stream: DataFrame, name: str, key: str, order: Sequence[str], at: str | None = None, buckets: int = 16) -> DataFrame:
    """First write wins over a stream: each batch adds the keys that the stored table lacks, and a repeated batch nothing."""
    spark = stream.sparkSession
    root, store = _stored(stream, name, at, stream.schema, [key], buckets)
    run_batches(stream, name, lambda batch, number: ledger.insert_absent(store(batch.sparkSession), batch, order, (name, number)), at=root)
    return store(spark).read()


def carried_health(stream: DataFrame, name: str, order: Sequence[str], failed: Column, fruitful: Column, at: str | None = None, buckets: int = 16) -> DataFrame:
    """Each feed's streak and last success over all batches so far, from summaries that are stored between them."""
    spark = stream.sparkSession
    root, store = _stored(stream, name, at, StructType.fromDDL(health.SUMMARY), ["source"], buckets)
    put = lambda batch, number: health.carry(store(batch.sparkSession), health.summaries(batch, "source", order, failed, fruitful), (name, number))
    run_batches(stream, name, put, at=root)
    return store(spark).read()


def unanswered(asked: DataFrame, answered: DataFrame, key: str, time: str, within: str, late: str) -> DataFrame:
    """Rows of a stream whose key has no row in another stream within so long: what a left outer join leaves unmatched.

    Both streams have a watermark, so an unanswered row comes out once the answers that could
    still arrive are too late for it, and is forgotten then; so are answers.
    """
    left = asked.withWatermark(time, late).alias("l")
    right = answered.select(F.col(key).alias("_key"), F.col(time).alias("_at")).withWatermark("_at", late)
    near = (F.col(f"l.{key}") == F.col("_key")) & (F.col("_at") >= F.col(f"l.{time}")) & (F.col("_at") <= F.col(f"l.{time}") + F.expr(f"interval {within}"))
    return left.join(right, near, "left_outer").where("_key is null").drop("_key", "_at")
