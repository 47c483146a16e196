"""Helpers that several operators use: table access, written stages, sampling, a sparse solver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import possible, spread_join
from ..operators.stages import discard, shared_path, written

__all__ = ["ASCII_SPACE", "Sparse", "class_counts", "discard", "held_out", "labelled_sample", "lasso_logistic", "possible", "shared_path", "small_batches", "spread_join", "table", "terms_of", "text_or_empty", "without", "written"]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of terms in lower case, and a space for all others.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """ASCII letters (A-Z lower-cased), digits and whatever isn't ASCII, in maximal stretches."""
    return text.encode().translate(_TERMS).split()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python tasks get at most so many rows at a time, as befits rows of some kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of docs, columns and all, but for those of drop: id, text_key (xxhash64 of the text), stays.

    Where stays is true, several rows are alike in id and text and one of them is kept.
    Rows that aren't named pass without a shuffle if Spark measures drop to be small.
    """
    held = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("row_id"), F.xxhash64("row.text").alias("row_key"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("text_key"))
    one = Window.partitionBy("row_id", "row_key").orderBy("row_key")
    alike = held.join(drop.where("stays"), same, "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return held.join(drop, same, "left_anti").select("row.*").unionByName(alike.select("row.*"))


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents whose labels are never learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int]) -> DataFrame:
    """(text, y) of at most limits[y] documents of each class y, none held out.

    The rows with the smallest hashes of their ids are taken, so a sample is the same on
    every run. Its ids (at most sum(limits), a parameter) are broadcast and the texts stay
    where they are. Rows with a null id or label don't count; of several labels of one id
    the largest does. Of several rows of one id the one with the smallest hash of its text
    counts, so the limits hold for rows as well.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .where(~held_out(F.col("id")))
    )
    chosen = None
    for y, limit in sorted(limits.items()):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "y")


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return {r["y"]: r["n"] for r in known.groupBy(F.when(F.col(label) > 0, 1).otherwise(0).alias("y")).agg(F.count("*").alias("n")).collect()}


class Sparse:
    """A matrix by its entries that aren't zero; products cost as many steps as it has entries."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    @classmethod
    def of(cls, lines: list[dict[int, float]], width: int) -> Sparse:
        """From one {column: value} a row."""
        count = [len(x) for x in lines]
        cols = np.fromiter((c for x in lines for c in x), np.int32, sum(count))
        values = np.fromiter((v for x in lines for v in x.values()), np.float32, sum(count))
        return cls(np.repeat(np.arange(len(lines), dtype=np.int32), count), cols, values, (len(lines), width))

    @classmethod
    def dense(cls, x: np.ndarray) -> Sparse:
        rows, cols = np.nonzero(x)
        return cls(rows.astype(np.int32), cols.astype(np.int32), x[rows, cols].astype(np.float32), x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.values * w[self.cols], minlength=self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=self.values * e[self.rows], minlength=self.shape[1])


def lasso_logistic(x: Sparse, y: np.ndarray, l1: float, pairs: Sparse | None = None, pair_weight: float = 0.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradient.

    pairs: rows of feature differences whose squared scores are penalised as well,
    pair_weight times their mean. The intercept carries no penalty.
    """
    n, k = x.shape
    if not n or len(np.unique(y)) < 2:
        return np.zeros(k), 0.0
    pairs = pairs if pairs is not None and pairs.shape[0] else None

    def gradient(err: np.ndarray, w: np.ndarray, scale: float) -> np.ndarray:
        g = np.append(x.transposed_times(err), err.sum()) * scale / n
        if pairs is not None:
            g[:k] += 2 * pair_weight / pairs.shape[0] * pairs.transposed_times(pairs.times(w))
        return g

    v, bound = np.ones(k + 1), 1.0
    for _ in range(20):  # largest eigenvalue of the Hessian's bound
        g = gradient(x.times(v[:k]) + v[k], v[:k], 0.25)
        bound = float(np.linalg.norm(g)) or 1.0
        v = g / bound
    step = 1 / (1.05 * bound)
    w = np.zeros(k + 1)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        score = x.times(z[:k]) + z[k]
        new = z - step * gradient(1 / (1 + np.exp(-np.clip(score, -30, 30))) - y, z[:k], 1.0)
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:k], float(w[k])
