"""Streams run over the tables' files and compared with what a batch says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import adapters as A
from ..streaming import jobs
from . import query

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def event_files(spark, d):
    """As a stream; the table is one file, or a folder of part files."""
    schema = A.table(spark, d, "events").schema
    part = spark.read.parquet(f"{d}/events.parquet").inputFiles()
    folder, glob = (d, "events.parquet") if len(part) == 1 and part[0].endswith("/events.parquet") else (f"{d}/events.parquet", "*.parquet")
    return jobs.read_files(spark, folder, schema, glob).withColumn("ts", F.col("ts").cast("timestamp"))


def decision_stream(spark, d):
    n = A.table(spark, d, "documents").count()
    return event_files(spark, d).select("event_id", (F.col("event_id") % n).alias("posting_id"), "event_type", "ts")


@query("stream_ingest", "select event_id, user_id, event_type, regexp_extract(props, '([0-9]+)', 1)::int as k from events")
def _(spark, d):
    rows = event_files(spark, d).select("event_id", "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    return jobs.run_to_table(rows, "ingest")


def landed(spark, rows, at, time, *ends):
    """Lands rows in a folder, one stretch of time after the other, and yields after each."""
    since = None
    for until in (*ends, None):
        part = rows if since is None else rows.where(F.col(time) >= F.lit(since).cast("timestamp"))
        part = part if until is None else part.where(F.col(time) < F.lit(until).cast("timestamp"))
        part.write.mode("append").parquet(f"{at}/in")
        yield f"{at}/in"
        since = until


@query("stream_resume", "select event_id, user_id, 1 + (ts >= timestamp '2024-01-11')::int + (ts >= timestamp '2024-01-21')::int as run, 1::bigint as times from events")
def _(spark, d):
    """Three runs of one named ingest over a folder in which files land between them: which run took a row, and how often it was taken."""
    at, runs = jobs.shared(spark, "resume"), []
    events = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for folder in landed(spark, events, at, "ts", "2024-01-11", "2024-01-21"):
        # What a run returns is the table's files as they are then.
        runs.append(jobs.ingest(spark, folder, events.schema, lambda s: s.select("event_id", "user_id"), "*.parquet", at=at))
    seen = None
    for number, rows in enumerate(runs, 1):
        rows = rows.withColumn("run", F.lit(number))
        seen = rows if seen is None else seen.unionByName(rows)
    return seen.groupBy("event_id", "user_id").agg(F.min("run").alias("run"), F.count_if(F.col("run") == len(runs)).alias("times"))


@query("stream_dedup", "select distinct user_id, event_type from events")
def _(spark, d):
    rows = jobs.dedup_within(event_files(spark, d), ["user_id", "event_type"], "ts", "60 days")
    return jobs.run_to_table(rows.select("user_id", "event_type"), "dedup")


@query("stream_first_write", "select user_id, min(event_id) as event_id from events group by 1")
def _(spark, d):
    """First write wins by key, merged batch by batch; a repeated batch changes nothing."""
    return jobs.first_writes(event_files(spark, d).select("user_id", "event_id"), "first-write", "user_id", ["event_id"])


@query("stream_daily_counts", "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all")
def _(spark, d):
    counts = jobs.windowed_counts(event_files(spark, d), "ts", ["event_type"], "1 day", "60 days")
    last = jobs.run_updates(counts, "daily", ["start", "event_type"])
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("stream_followups", """select a.event_id, a.posting_id, strftime(a.ts + interval 188 hours, '%Y-%m-%d %H:%M:%S') as due_at from decisions a where a.kind = 'applied' and a.ts < timestamp '2024-01-20'
and not exists (select 1 from decisions s where s.kind = 'sent' and s.posting_id = a.posting_id and s.ts >= a.ts and s.ts <= a.ts + interval 188 hours)""", "decisions")
def _(spark, d):
    """Applications of which nobody was reminded within seven days and twenty hours, as they fall due.

    Reported are those that fell due while events still came, the last day's aside.
    """
    e = decision_stream(spark, d)
    applied = e.where("event_type = 'purchase'").select("event_id", "posting_id", "ts")
    sent = decision_stream(spark, d).where("event_type = 'view'").select("posting_id", "ts")
    due = jobs.unanswered(applied, sent, "posting_id", "ts", "188 hours", "1 day")
    rows = jobs.run_to_table(due, "followups")
    return rows.where("ts < timestamp '2024-01-20'").select("event_id", "posting_id", F.date_format(F.col("ts") + F.expr("interval 188 hours"), "yyyy-MM-dd HH:mm:ss").alias("due_at"))


@query("stream_streaks", f"""with r as (select *, error is not null as failed from feed_runs), l as (select source, max({{'t': ran_at, 'i': run_id}}) as last_ok from r where not failed group by 1)
select r.source, count(*) as runs, count(*) filter (failed and (last_ok is null or {{'t': ran_at, 'i': run_id}} > last_ok)) as failures, {STAMP.format("max(case when rows_found > 0 then ran_at end)")} as last_success
from r left join l on r.source = l.source group by 1""", "feed_runs")
def _(spark, d):
    """Streaks of failures and last successes over three runs of a stream, carried in a stored table between them."""
    at, rows = jobs.shared(spark, "streaks"), None
    runs = A.feed_runs(spark, d)
    for folder in landed(spark, runs, at, "ran_at", "2024-01-11", "2024-01-21"):
        stream = jobs.read_files(spark, folder, runs.schema, "*.parquet", per_batch=1000)
        rows = jobs.carried_health(stream, "health", ["ran_at", "run_id"], F.col("error").isNotNull(), F.col("rows_found") > 0, at=at)
    return rows.select("source", "runs", F.col("tail").alias("failures"), F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"))
