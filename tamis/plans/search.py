"""A whole run: new postings through dedup, ledger, rules, scores and preferences to a short ranked list."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, ledger, prefer
from ..operators.rules import RulePack


def keyed(postings: DataFrame) -> DataFrame:
    """postings with url_norm, role, company_key (the company part of the role) and identity (title, company and source as they are)."""
    whole = [F.lower(F.trim("title")), F.lower(F.trim("company")), F.col("source")]
    return postings.withColumns({"url_norm": text.normalize_url(F.col("url")), "role": text.role_key(F.col("company"), F.col("title")), "company_key": text.dashed(F.col("company")), "identity": F.concat_ws("|", *whole)})


def unseen(postings: DataFrame, every: DataFrame, decisions: DataFrame, as_of: Column, ttl_hours: Mapping[str, int], dismissed_roles: int = 2) -> DataFrame:
    """Postings that no live entry of the ledger names by url or role, of companies with fewer dismissed roles than that.

    every: all postings with their keys, under whose ids entries were made. All three are
    anti joins on keys that are aggregated before.
    """
    named = decisions.join(every.select("posting_id", "url_norm", "role", "company_key"), "posting_id")
    decided = {k: v for k, v in ttl_hours.items() if k in ("applied", "dismissed")}
    urls = ledger.live(named, as_of, ttl_hours, "url_norm").select("url_norm").distinct()
    roles = ledger.live(named, as_of, decided, "role")
    companies = roles.where("kind = 'dismissed'").groupBy(F.substring_index("role", "::", 1).alias("company_key")).agg(F.count_distinct("role").alias("n")).where(F.col("n") >= dismissed_roles)
    left = postings.join(urls, "url_norm", "left_anti").join(roles.select("role").distinct(), "role", "left_anti")
    return left.join(companies.select("company_key"), "company_key", "left_anti")


def run(postings: DataFrame, decisions: DataFrame, pack: RulePack, score: Callable[[Column], Column], as_of: Column, ttl_hours: Mapping[str, int], order: Sequence[Column], most: int, ordinal: str = "ingest_ordinal") -> DataFrame:
    """The best postings, at most so many, with sent: whether an entry of kind sent names the url.

    score takes what past decisions add to a posting. Dedup, anti joins and rules come first,
    so that only what can still win is scored; the top-k never sorts the whole table.
    """
    every = keyed(postings)
    new = dedup.two_key_dedup(every, "url_norm", "identity", ordinal)
    fresh = pack.passed(unseen(new, every, decisions, as_of, ttl_hours))
    tokens = text.tokenize(F.concat_ws(" ", "title", "company"))
    decided = decisions.where(F.col("kind").isin("applied", "dismissed")).join(postings.select("posting_id", "title", "company"), "posting_id")
    deltas = prefer.apply(fresh, "posting_id", tokens, prefer.fit(prefer.word_support(decided, tokens), decided)).select("posting_id", "delta")
    scored = fresh.join(deltas, "posting_id").withColumn("score", score(F.col("delta")))
    once = dedup.keep_first(scored, [text.normalize_company(F.col("company")), text.base_title(F.col("title"))], order)
    best = once.orderBy(*order).limit(most)
    sent = decisions.where("kind = 'sent'").join(every.select("posting_id", "url_norm"), "posting_id").select("url_norm").distinct().withColumn("sent", F.lit(True))
    return best.join(sent, "url_norm", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))
