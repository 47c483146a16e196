"""The engine's tables as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every rule about time counts back from here.
AS_OF = "2024-01-31 00:00:00"
RATES = (("EUR", 1.0), ("USD", 0.88), ("GBP", 1.16), ("CHF", 1.04))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES), "currency string, rate double")


def _pick(number, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting a document. The row counts that spread keys come from Parquet footers."""
    d, g, s, p, n = (table(spark, sf_dir, x) for x in ("documents", "pages", "supplier", "part", "nation"))
    i = F.col("doc_id")
    rows = d.withColumns({"_g": i % g.count(), "_s": i % s.count(), "_p": i % p.count()})
    firms = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("_s"), "s_name", F.col("n_name").alias("country"))
    rows = rows.join(g.select(F.col("page_id").alias("_g"), "url"), "_g").join(firms, "_s").join(p.select(F.col("p_partkey").alias("_p"), "p_retailprice"), "_p")
    return rows.select(
        i.alias("posting_id"),
        i.alias("ingest_ordinal"),
        "source",
        (i % 8 + 1).cast("int").alias("source_priority"),
        "url",
        F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("title"),
        F.concat("s_name", _pick(i % 4, "", " GmbH", " GmbH & Co. KG", " SAS")).alias("company"),
        "country",
        _pick(i % 3, "remote", "hybrid", "on-site").alias("work_mode"),
        F.col("lang").alias("language"),
        F.col("text").alias("description"),
        F.when(i % 5 != 0, (i % 10).cast("int")).alias("experience_min"),
        F.when(i % 7 != 0, F.col("p_retailprice") * 40).alias("salary_yearly_min"),
        _pick(i % 5, "EUR", "USD", "GBP", "CHF", "XXX").alias("salary_currency"),
        (i % 6 == 0).alias("offers_relocation"),
        (F.lit("2024-01-30 00:00:00").cast("timestamp") - F.make_dt_interval(hours=(i % 240).cast("int"))).alias("published_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    kind = F.when(F.col("event_type") == "purchase", "applied").when(F.col("event_type") == "error", "dismissed").when(F.col("event_type") == "click", "seen").when(F.col("event_type") == "view", "sent").otherwise("reverted")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("profile_id"), (F.col("event_id") % n).alias("posting_id"), kind.alias("kind"), F.col("value").alias("score"))


def feed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("ts").cast("timestamp").alias("ran_at"),
        F.concat(F.lit("feed"), (F.col("user_id") % 47).cast("string")).alias("source"),
        F.when(kind.isin("error", "signup"), 0).otherwise(F.floor("value").cast("int")).alias("rows_found"),
        F.when(kind == "error", "HTTP 403 forbidden").alias("error"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    score = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 1, (50 + i % 51).cast("int")).otherwise((i % 55).cast("int"))
    return d.join(labels, "doc_id", "left").select(i.alias("posting_id"), score.alias("model_score"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("model_veto"), (i * 7 % 101).cast("int").alias("fraud_score"))
