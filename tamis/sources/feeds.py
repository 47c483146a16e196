"""Landed feeds: nested JSON to canonical rows, by configuration.

A feed is its schema, the path of its list and a mapping from its fields; feeds differ by
configuration, not by code. A landed file is one response, or one a line. Those that can't be read, or
hold no list, go to a quarantine with their feed, file, text and reason, so one feed's errors don't
touch another's rows, and a count a feed tells the health report of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.infer import time_canon

CANONICAL = ("source", "source_priority", "url", "title", "company", "location", "description", "published_at")


@dataclass(frozen=True)
class Feed:
    name: str
    priority: int
    schema: str
    items: str
    fields: Mapping[str, Sequence[str]]
    published: Column | None = field(default=None, compare=False)
    #: One response a line, so that a file can be split; else a file is one response, however it is laid out.
    lines: bool = False

    def responses(self, spark: SparkSession, path: str) -> DataFrame:
        """Landed responses, broken ones too, each with its file."""
        reader = spark.read.schema(f"{self.schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        return reader.json(path, multiLine=not self.lines).select("*", F.col("_metadata.file_path").alias("_file"))

    def _reason(self) -> Column:
        return F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col(self.items).isNull(), "no list")

    def quarantine(self, responses: DataFrame) -> DataFrame:
        """feed, file, raw and reason of the responses without items that can be read; raw is null where only the list is missing."""
        return responses.select(F.lit(self.name).alias("feed"), F.col("_file").alias("file"), F.col("_corrupt_record").alias("raw"), self._reason().alias("reason")).where("reason is not null")

    def good(self, responses: DataFrame) -> DataFrame:
        return responses.where(self._reason().isNull())

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Raw items of landed response files."""
        return self.explode(self.good(self.responses(spark, path)))

    def run_counts(self, responses: DataFrame) -> DataFrame:
        """source, responses, broken, rows_found and error (null unless every response is broken): what the health report reads of a run."""
        reason = self._reason()
        seen = responses.select(reason.alias("why"), F.when(reason.isNull(), F.size(self.items)).otherwise(0).alias("n")).agg(
            F.count("*").alias("responses"), F.count("why").alias("broken"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_found"), F.min("why").alias("why")
        )
        error = F.when((F.col("responses") > 0) & (F.col("broken") == F.col("responses")), F.concat(F.lit("unreadable response: "), "why"))
        return seen.select(F.lit(self.name).alias("source"), "responses", "broken", "rows_found", error.alias("error"))

    def explode(self, responses: DataFrame) -> DataFrame:
        return responses.select(F.explode(F.col(self.items)).alias("item"))

    def canonical(self, items: DataFrame, as_of: Column) -> DataFrame:
        """Canonical postings: the first non-empty alias of each field; rows without title or url go."""
        pick = lambda name: F.coalesce(*[F.nullif(F.trim(F.col(f"item.{a}").cast("string")), F.lit("")) for a in self.fields[name]], F.lit(None).cast("string"))
        out = items.select(
            F.lit(self.name).alias("source"),
            F.lit(self.priority).alias("source_priority"),
            *[(pick(c) if c in self.fields else F.lit(None).cast("string")).alias(c) for c in ("url", "title", "company", "location", "description")],
            F.coalesce(self.published if self.published is not None else F.lit(None).cast("timestamp"), as_of).alias("published_at"),
        )
        return out.where(F.col("title").isNotNull() & F.col("url").isNotNull())


RSS_ITEM = "title string, link string, guid string, description string, pubDate string, region string, category array<string>, _corrupt_record string"


def rss_rows(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files as they are, with their file; what isn't XML is in _corrupt_record.

    Files are read as lines that end where items do, so Spark splits a feed of any size, and each
    item is parsed once.
    """
    lines = spark.read.option("lineSep", "</item>").text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    item = F.nullif(F.regexp_extract("value", r"(?s)<item(?:[ \t\r\n][^>]*)?>.*$", 0), F.lit(""))
    parsed = F.from_xml(F.concat(item, F.lit("</item>")), RSS_ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(item.isNotNull()).select("_file", parsed.alias("i")).select("_file", "i.*")


def rss_quarantine(rows: DataFrame, feed: str) -> DataFrame:
    """feed, file, raw and reason of the items that aren't XML."""
    return rows.where("_corrupt_record is not null").select(F.lit(feed).alias("feed"), F.col("_file").alias("file"), F.col("_corrupt_record").alias("raw"), F.lit("malformed").alias("reason"))


def rss_files(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """title, url, description, region and published_at of the items of landed RSS files, by the rules of ``html.rss_items``."""
    filled = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    date = filled(F.col("pubDate"))
    out = rss_rows(spark, path).where("_corrupt_record is null").select(
        filled(F.col("title")).alias("title"),
        filled(F.col("link"), F.col("guid")).alias("url"),
        F.coalesce(filled(F.col("description")), F.lit("")).alias("description"),
        F.coalesce(filled(F.col("region"), F.try_element_at("category", F.lit(1))), F.lit("")).alias("region"),
        F.when(date.isNull(), as_of).otherwise(time_canon(text=date)).alias("published_at"),
    )
    return out.where("title is not null and url is not null and published_at is not null")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def select_feeds(rows: DataFrame, feeds: DataFrame, only: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the chosen feeds, which are a small configuration table."""
    chosen = feeds
    if only:
        chosen = chosen.where(F.col("source").isin(*only))
    if exclude:
        chosen = chosen.where(~F.col("source").isin(*exclude))
    return rows.join(chosen, "source")


def enrich(listing: DataFrame, detail: DataFrame, key: str, text: str = "description") -> DataFrame:
    """List rows with their details' longer text; rows without a detail are flagged partial."""
    more = detail.select(key, F.col(text).alias("_detail"))
    joined = listing.join(more, key, "left")
    longer = F.when(F.char_length("_detail") > F.char_length(F.coalesce(text, F.lit(""))), F.col("_detail")).otherwise(F.col(text))
    return joined.withColumns({text: longer, "partial": F.col("_detail").isNull()}).drop("_detail")
