"""Analytics, counts and digests over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, prefer, report
from ..plans import adapters as A
from . import query
from .rules import PACK_SQL, pack

AS_OF = "timestamp '2024-01-31 00:00:00'"
ROWS = """e as (select posting_id, arg_max(kind, {'t': ts, 'e': event_id}) as status, max(ts) as ts from decisions where kind in ('applied', 'dismissed') group by 1),
a as (select p.source, case when posting_id % 9 = 0 then null else p.country end as country, e.status, e.ts from e join postings p using (posting_id)
  union all select source, case when posting_id % 9 = 0 then null else country end, 'pending', published_at from postings where posting_id not in (select posting_id from e))"""


def analytics(spark, d):
    """Decided postings at the time of the decision, and pending ones at the time they were found."""
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed"))
    last = e.groupBy("posting_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    p = A.postings(spark, d).select("posting_id", "source", F.when(F.col("posting_id") % 9 != 0, F.col("country")).alias("country"), "published_at")
    done = last.join(p, "posting_id").select("source", "country", "status", "ts")
    rest = p.join(last, "posting_id", "left_anti").select("source", "country", F.lit("pending").alias("status"), F.col("published_at").alias("ts"))
    return done.unionByName(rest)


V = ("postings", "decisions")


@query("decided_plus_pending", f"with {ROWS} select source, country, status, count(*) as n from a group by all", *V)
def _(spark, d):
    return analytics(spark, d).groupBy("source", "country", "status").agg(F.count("*").alias("n"))


@query("decided_or_history", f"""with t as (select source, kind, ts from decisions join postings using (posting_id) where kind in ('applied', 'dismissed')),
h as (select source, kind from decisions join postings using (posting_id) where kind = 'seen'), m as (select * from t where ts >= {AS_OF})
select 'table' as store, source, kind, count(*) as n from t group by all union all select 'empty table', source, kind, count(*) from (select source, kind from m union all select source, kind from h where not exists (select 1 from m)) group by all""", *V)
def _(spark, d):
    """Decided rows from the table of decisions; from the history, which has no country, only where the table is empty."""
    named = A.decisions(spark, d).join(A.postings(spark, d).select("posting_id", "source"), "posting_id")
    table = named.where(F.col("kind").isin("applied", "dismissed")).select("source", "kind", "ts")
    history = named.where("kind = 'seen'").select("source", "kind", "ts")
    out = [report.primary_else(t, history).groupBy("source", "kind").agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "source", "kind", "n") for s, t in (("table", table), ("empty table", table.where(F.col("ts") >= A.as_of())))]
    return out[0].unionByName(out[1])


@query("count_by_source", f"with {ROWS} select source, count(*) as n from a group by 1", *V)
def _(spark, d):
    return report.counts(analytics(spark, d), F.col("source"), "source").orderBy(F.col("n").desc(), "source")


@query("applied_by_source", f"with {ROWS} select source, count(*) as n from a where status = 'applied' group by 1", *V)
def _(spark, d):
    return report.counts(analytics(spark, d).where("status = 'applied'"), F.col("source"), "source").orderBy(F.col("n").desc(), "source")


@query("count_by_country", f"with {ROWS} select coalesce(country, 'Unknown') as country, count(*) as n from a group by 1", *V)
def _(spark, d):
    return report.counts(analytics(spark, d), F.coalesce("country", F.lit("Unknown")), "country").orderBy(F.col("n").desc(), "country")


@query("status_breakdown", f"with {ROWS} select count(*) filter (status = 'applied') as applied, count(*) filter (status = 'dismissed') as dismissed, count(*) filter (status = 'pending') as pending from a", *V)
def _(spark, d):
    return report.status_breakdown(analytics(spark, d))


@query("daily_trend", f"with {ROWS} select strftime(ts, '%Y-%m-%d') as day, count(*) as n from a group by 1", *V)
def _(spark, d):
    return report.counts(analytics(spark, d), F.date_format("ts", "yyyy-MM-dd"), "day").orderBy("day")


@query("trend_windows", f"with {ROWS} select days, count(*) filter (ts >= {AS_OF} - to_days(n)) as n from a cross join (values ('7', 7), ('30', 30), ('90', 90), ('all', 100000), ('13', 30)) w(days, n) group by 1", *V)
def _(spark, d):
    return report.within_windows(analytics(spark, d), A.as_of(), (7, 30, 90, "all", 13))


@query("analytics_bundle", f"""with {ROWS}, w as (select * from a where ts >= {AS_OF} - interval 30 days)
select 'source' as section, source as label, count(*) as n from w group by 2 union all select 'country', coalesce(country, 'Unknown'), count(*) from w group by 2 union all select 'status', status, count(*) from w group by 2
union all select 'day', strftime(ts, '%Y-%m-%d'), count(*) from w group by 2 union all select 'applied_source', source, count(*) from w where status = 'applied' group by 2""", *V)
def _(spark, d):
    return report.bundle(report.window_rows(analytics(spark, d), A.as_of(), 30))


@query("source_yield", f"select source, count(*) as fetched, count(*) filter (published_at >= {AS_OF} - interval 168 hours) as fresh, count(*) filter ({PACK_SQL} is null) as passed from postings group by 1", "postings")
def _(spark, d):
    p = pack().apply(A.postings(spark, d))
    fresh = F.col("published_at") >= A.as_of() - F.expr("interval 168 hours")
    return p.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(fresh).alias("fresh"), F.count_if(F.col("reject_reason").isNull()).alias("passed"))


@query("group_totals", "with l as (select *, row_number() over (partition by source order by ran_at desc, run_id desc) as i from feed_runs) select case when replace(source, 'feed', '')::int < 20 then 'fast' else 'slow' end as feed_group, sum(rows_found)::bigint as rows_found, count(*) filter (error is not null) as failing, count(*) filter (rows_found > 0) as ok from l where i = 1 group by 1", "feed_runs")
def _(spark, d):
    last = A.feed_runs(spark, d).groupBy("source").agg(F.max_by(F.struct("rows_found", "error"), F.struct("ran_at", "run_id")).alias("r"))
    group = F.when(F.replace("source", F.lit("feed"), F.lit("")).cast("int") < 20, "fast").otherwise("slow")
    return last.groupBy(group.alias("feed_group")).agg(F.sum(F.col("r.rows_found").cast("long")).alias("rows_found"), F.count_if(F.col("r.error").isNotNull()).alias("failing"), F.count_if(F.col("r.rows_found") > 0).alias("ok"))


@query("share_of_max", f"with {ROWS}, c as (select source, count(*) as n from a group by 1) select source, n, greatest(2, round(n * 100.0::double / max(n) over (), 1)) as bar, round(n * 100.0::double / sum(n) over (), 1) as share from c", *V)
def _(spark, d):
    got = prefer.top_share(report.counts(analytics(spark, d), F.col("source"), "source"), "n")
    return got.select("source", "n", F.greatest(F.lit(2.0), F.round("of_max", 1)).alias("bar"), F.round("of_all", 1).alias("share"))


@query("daily_usage", "select strftime(ts - interval 8 hours, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def _(spark, d):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles")  # eight hours behind UTC all January
    return A.table(spark, d, "events").groupBy(F.date_format(local, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("excerpt_stats", "select source, round(avg(least(length(description), 500)), 3) as mean_length, count(*) filter (length(description) >= 500) as full_texts, count(*) as n from postings group by 1", "postings")
def _(spark, d):
    n = F.char_length("description")
    return A.postings(spark, d).groupBy("source").agg(F.round(F.avg(F.least(n, F.lit(500))), 3).alias("mean_length"), F.count_if(n >= 500).alias("full_texts"), F.count("*").alias("n"))


@query("decision_digest", """with r as (select kind, title || ' @ ' || company as line, row_number() over (partition by kind order by ts desc, event_id desc) as i from decisions join postings using (posting_id) where kind in ('applied', 'dismissed'))
select kind, string_agg(line, '; ' order by i) as digest from r where i <= 8 group by 1""", *V)
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed"))
    last = ledger.newest_per(e, ["kind"], [F.col("ts").desc(), F.col("event_id").desc()], 8)
    named = last.join(A.postings(spark, d).select("posting_id", "title", "company"), "posting_id").select("kind", "place", F.concat_ws(" @ ", "title", "company").alias("line"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "; ")
    return named.groupBy("kind").agg(lines.alias("digest"))
