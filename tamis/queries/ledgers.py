"""Ledger, joins, dedup, preferences and health over the adapter views."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, health, ledger, prefer
from ..operators.stages import shared_path
from ..operators.store import StoredTable
from ..plans import adapters as A
from ..plans import search
from . import query
from .rules import PACK_SQL, RANK, SCORE_SQL, rank_order, ranked
from .scalars import COLLAPSE, NORM_COMPANY, NORM_URL, ROLE_KEY, TITLE_TOKENS

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
AS_OF = "timestamp '2024-01-31 00:00:00'"


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def norm(spark, d):
    """Postings with their keys."""
    return A.postings(spark, d).withColumns({"url_norm": text.normalize_url(F.col("url")), "role": text.role_key(F.col("company"), F.col("title")), "company_key": text.normalize_company(F.col("company"))})


U = f"""k as (select *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || u[length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1:] as url_norm, {ROLE_KEY} as role, {NORM_COMPANY.format('company')} as company_key
  from (select *, {NORM_URL.format('url')} as u from postings))"""
#: Hours; short, because the events of the test tables come thick.
TTL = {"seen": 4, "applied": 24, "dismissed": 12}


def live_sql(column: str) -> str:
    return f"""(select k.{column} as key from decisions e join k using (posting_id) where kind in ('seen', 'applied', 'dismissed') and ts > {AS_OF} - to_hours(case kind when 'seen' then 4 when 'applied' then 24 else 12 end))"""


@query("anti_seen", f"with {U} select posting_id from k where url_norm not in {live_sql('url_norm')}", "postings", "decisions")
def _(spark, d):
    p = norm(spark, d)
    seen = A.decisions(spark, d).join(p.select("posting_id", "url_norm"), "posting_id")
    return p.join(ledger.live(seen, A.as_of(), TTL, "url_norm"), "url_norm", "left_anti").select("posting_id")


@query("anti_seen_bucketed", f"with {U} select posting_id from k where url_norm not in {live_sql('url_norm')}", "postings", "decisions")
def _(spark, d):
    """As anti_seen, against a history that was bucketed by its key once: the daily join deals out the postings only."""
    p = norm(spark, d).select("posting_id", "url_norm")
    seen = A.decisions(spark, d).join(p, "posting_id")
    most = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    history = ledger.bucketed(ledger.live(seen, A.as_of(), TTL, "url_norm").select("url_norm").distinct(), f"tamis_seen_{uuid.uuid4().hex}", "url_norm", most)
    return ledger.unseen(p, history, "url_norm").select("posting_id")


@query("anti_role", f"with {U} select posting_id from k where role not in (select role from decisions join k using (posting_id) where kind = 'applied')", "postings", "decisions")
def _(spark, d):
    p = norm(spark, d)
    roles = A.decisions(spark, d).where("kind = 'applied'").join(p.select("posting_id", "role"), "posting_id").select("role")
    return p.join(roles, "role", "left_anti").select("posting_id")


@query("anti_company_threshold", f"with {U} select posting_id from k where company_key not in (select company_key from decisions join k using (posting_id) where kind = 'dismissed' and ts > {AS_OF} - interval 5 days group by 1 having count(distinct role) >= 2)", "postings", "decisions")
def _(spark, d):
    p = norm(spark, d)
    bad = A.decisions(spark, d).where((F.col("kind") == "dismissed") & (F.col("ts") > A.as_of() - F.expr("interval 5 days"))).join(p.select("posting_id", "company_key", "role"), "posting_id")
    bad = bad.groupBy("company_key").agg(F.count_distinct("role").alias("n")).where("n >= 2")
    return p.join(bad, "company_key", "left_anti").select("posting_id")


@query("sent_split", f"select posting_id, posting_id in (select posting_id from decisions where kind = 'sent') as sent from postings where {PACK_SQL} is null", "postings", "decisions")
def _(spark, d):
    matched = ranked(spark, d).select("posting_id")
    sent = A.decisions(spark, d).where("kind = 'sent'").select("posting_id").distinct()
    fresh = matched.join(sent, "posting_id", "left_anti").withColumn("sent", F.lit(False))
    return fresh.unionByName(matched.join(sent, "posting_id", "left_semi").withColumn("sent", F.lit(True)))


@query("country_tab", "with tabs as (select n_name as country, r_name as tab from nation join region on n_regionkey = r_regionkey where n_regionkey < 3) select posting_id, coalesce(tab, case when source in ('src1', 'src2') then 'home' end, 'other') as tab from postings left join tabs using (country)", "postings")
def _(spark, d):
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    tabs = n.where("n_regionkey < 3").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("tab"))
    return A.postings(spark, d).join(tabs, "country", "left").select("posting_id", F.coalesce("tab", F.when(F.col("source").isin("src1", "src2"), "home"), F.lit("other")).alias("tab"))


@query("health_join", f"""with r as (select *, row_number() over (partition by source order by ran_at desc, run_id desc) as i from feed_runs)
select a.source, a.rows_found, b.rows_found as rows_before, a.rows_found - b.rows_found as change from r a left join r b on a.source = b.source and b.i = 2 where a.i = 1""", "feed_runs")
def _(spark, d):
    last = ledger.newest_per(A.feed_runs(spark, d), ["source"], [F.col("ran_at").desc(), F.col("run_id").desc()], 2)
    before = last.where("place = 2").select("source", F.col("rows_found").alias("rows_before"))
    return last.where("place = 1").join(before, "source", "left").select("source", "rows_found", "rows_before", (F.col("rows_found") - F.col("rows_before")).alias("change"))


@query("decision_enrich", "select event_id, coalesce(title, 'event ' || event_id) as title, coalesce(company, '') as company from (select * from decisions where kind in ('applied', 'dismissed')) d left join (select * from postings where experience_min is not null) p using (posting_id)", "postings", "decisions")
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed"))
    p = A.postings(spark, d).where("experience_min is not null").select("posting_id", "title", "company")
    return e.join(p, "posting_id", "left").select("event_id", F.coalesce("title", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("title"), F.coalesce("company", F.lit("")).alias("company"))


@query("orphan_index", "select i.posting_id, p.posting_id is null as orphan from (select distinct posting_id from decisions) i left join (select posting_id from postings where salary_yearly_min is not null) p on i.posting_id = p.posting_id", "postings", "decisions")
def _(spark, d):
    index = A.decisions(spark, d).select("posting_id").distinct()
    store = A.postings(spark, d).where("salary_yearly_min is not null").select("posting_id")
    return index.join(store, "posting_id", "left_semi").withColumn("orphan", F.lit(False)).unionByName(index.join(store, "posting_id", "left_anti").withColumn("orphan", F.lit(True)))


SUPPORT = f"""t as (select e.kind, unnest({TITLE_TOKENS}) as word from decisions e join postings p using (posting_id) where kind in ('applied', 'dismissed')),
s as (select word, count(*) filter (kind = 'applied') as applied, count(*) filter (kind = 'dismissed') as dismissed from t group by 1),
w as (select word, round((applied - dismissed) / (applied + dismissed)::double * least(applied + dismissed, 4) / 4 * 4, 2) as weight from s where applied + dismissed >= 2),
g as (select * from w where abs(weight) >= 1 and (select count(*) from decisions join postings using (posting_id) where kind in ('applied', 'dismissed')) >= 4)"""
#: total and delta of every posting in x (posting_id, word), those of postings in p.
DELTA = """(select posting_id, coalesce(total, 0) as total, floor(coalesce(total, 0) + 0.5)::int as delta from p left join (select posting_id, greatest(-15, least(12, sum(weight))) as total from x join g using (word) group by 1) using (posting_id))"""


def decided(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed"))
    return e.join(A.postings(spark, d).select("posting_id", "title", "company"), "posting_id")


def title_tokens():
    return text.tokenize(F.concat_ws(" ", "title", "company"))


def weights(spark, d):
    e = decided(spark, d)
    return prefer.fit(prefer.word_support(e, title_tokens()), e)


@query("word_support", f"with {SUPPORT} select word, applied, dismissed from s", "postings", "decisions")
def _(spark, d):
    return prefer.word_support(decided(spark, d), title_tokens())


@query("preference_weights", f"with {SUPPORT} select word, weight from g", "postings", "decisions")
def _(spark, d):
    return weights(spark, d)


@query("preference_delta", f"""with {SUPPORT}, x as (select posting_id, unnest({TITLE_TOKENS}) as word from postings), p as (select posting_id from postings)
select posting_id, delta from {DELTA}""", "postings", "decisions")
def _(spark, d):
    return prefer.apply(A.postings(spark, d), "posting_id", title_tokens(), weights(spark, d)).select("posting_id", "delta")


@query("preference_inactive", "select posting_id, 0 as delta from postings", "postings")
def _(spark, d):
    """Three decisions say nothing yet."""
    few = decided(spark, d).orderBy("event_id").limit(3)
    words = prefer.fit(prefer.word_support(few, title_tokens()), few, least=1, smallest=0.0)
    return prefer.apply(A.postings(spark, d), "posting_id", title_tokens(), words).select("posting_id", "delta")


@query("top_words", f"""with {SUPPORT}, x as (select posting_id, unnest({TITLE_TOKENS}) as word from postings), m as (select posting_id, word, weight from x join g using (word)),
tot as (select posting_id, sum(weight) as total, (list(word order by -weight, word) filter (weight > 0))[1:2] as liked, (list(word order by weight, word) filter (weight < 0))[1:2] as disliked from m group by 1)
select posting_id, case when total >= 4 then array_to_string(liked, ',') else '' end as liked, case when total <= -4 then coalesce(array_to_string(disliked, ','), '') else '' end as disliked from tot where abs(total) >= 4""", "postings", "decisions")
def _(spark, d):
    got = prefer.apply(A.postings(spark, d), "posting_id", title_tokens(), weights(spark, d)).where("abs(total) >= 4")
    return got.select("posting_id", F.when(F.col("total") >= 4, F.array_join("liked", ",")).otherwise("").alias("liked"), F.when(F.col("total") <= -4, F.array_join("disliked", ",")).otherwise("").alias("disliked"))


# Dedup.


@query("dedup_cross_source", f"select posting_id from (select posting_id, row_number() over (partition by {NORM_COMPANY.format('company')}, {COLLAPSE.format('lower(split_part(title, ' + repr('|') + ', 1))')} order by {RANK}) as i from (select *, {SCORE_SQL} as score from postings where {PACK_SQL} is null)) where i = 1", "postings")
def _(spark, d):
    return dedup.keep_first(ranked(spark, d), [text.normalize_company(F.col("company")), text.base_title(F.col("title"))], rank_order()).select("posting_id")


#: The plain loop over postings in their order: one is kept if both its keys are new.
TWO_KEY = f"""{U}, q as materialized (select *, lower(trim(title)) || '|' || lower(trim(company)) || '|' || source as identity, row_number() over (order by ingest_ordinal) as n from k),
lp as (select 0::bigint as n, []::varchar[] as urls, []::varchar[] as names, []::bigint[] as kept
  union all select q.n, case when ok then list_append(urls, url_norm) else urls end, case when ok then list_append(names, identity) else names end, case when ok then list_append(kept, posting_id) else kept end
  from (select q.*, lp.urls, lp.names, lp.kept, not list_contains(lp.urls, q.url_norm) and not list_contains(lp.names, q.identity) as ok from lp join q on q.n = lp.n + 1) q),
two as (select unnest(kept) as posting_id from lp where n = (select max(n) from lp))"""


@query("dedup_two_key", f"with recursive {TWO_KEY} select posting_id, url_norm from two join k using (posting_id)", "postings")
def _(spark, d):
    return dedup.two_key_dedup(search.keyed(A.postings(spark, d)), "url_norm", "identity", "ingest_ordinal").select("posting_id", "url_norm")


@query("dedup_within_feed", "select source || '|' || url as key, min(ingest_ordinal) as ingest_ordinal, arg_max(title, ingest_ordinal) as title from postings group by 1", "postings")
def _(spark, d):
    p = A.postings(spark, d).select(F.concat_ws("|", "source", "url").alias("key"), "ingest_ordinal", "title")
    return dedup.merge_by_key(p, "key", "ingest_ordinal", "last")


@query("priority_dedup", "select posting_id from (select posting_id, row_number() over (partition by url order by source_priority, ingest_ordinal) as i from postings) where i = 1", "postings")
def _(spark, d):
    return dedup.keep_first(A.postings(spark, d), ["url"], [F.col("source_priority"), F.col("ingest_ordinal")]).select("posting_id")


# Ledger.


@query("ttl_ledger", f"select posting_id, kind from (select posting_id, kind, max(ts) as ts from decisions where kind in ('seen', 'applied', 'dismissed') group by all) where ts > {AS_OF} - to_hours(case kind when 'seen' then 4 when 'applied' then 24 else 12 end)", "decisions")
def _(spark, d):
    return ledger.live(A.decisions(spark, d), A.as_of(), TTL, "posting_id").select("posting_id", "kind")


@query("ttl_by_outcome", f"select event_id, {STAMP.format('ts + to_hours(case when kind = ' + repr('dismissed') + ' then greatest(48, 168) else 48 end)')} as expires_at, ts + to_hours(case when kind = 'dismissed' then 168 else 48 end) > {AS_OF} as live from decisions", "decisions")
def _(spark, d):
    e = ledger.with_expiry(A.decisions(spark, d), F.when(F.col("kind") == "dismissed", 168).otherwise(48))
    return e.select("event_id", stamp("expires_at").alias("expires_at"), (F.col("expires_at") > A.as_of()).alias("live"))


@query("ledger_current", "select profile_id, posting_id from (select profile_id, posting_id, arg_max(kind, {'t': ts, 'e': event_id}) as k from decisions group by all) where k <> 'reverted'", "decisions")
def _(spark, d):
    return ledger.current(A.decisions(spark, d), ["profile_id", "posting_id"], "kind", "reverted").select("profile_id", "posting_id")


@query("ledger_sizes", "select kind, count(distinct posting_id) as n from decisions group by 1", "decisions")
def _(spark, d):
    return A.decisions(spark, d).groupBy("kind").agg(F.count_distinct("posting_id").alias("n"))


@query("first_write_wins", f"select posting_id, arg_min(profile_id, {{'t': ts, 'e': event_id}}) as profile_id, {STAMP.format('min(ts)')} as first_at from decisions group by 1", "decisions")
def _(spark, d):
    e = A.decisions(spark, d)
    return ledger.first_write(e, "posting_id", ["profile_id", "ts"], ["ts", "event_id"]).select("posting_id", "profile_id", stamp("ts").alias("first_at"))


DECIDED = "e as (select *, row_number() over (partition by posting_id order by ts, event_id) as a, row_number() over (partition by posting_id order by ts desc, event_id desc) as z from decisions where kind in ('applied', 'dismissed'))"


@query("decision_upsert", f"with {DECIDED} select f.posting_id, f.profile_id, f.event_id as first_event, l.kind, round(l.score, 2) as score, {STAMP.format('l.ts')} as decided_at from e f join e l on f.posting_id = l.posting_id and f.a = 1 and l.z = 1", "decisions")
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed"))
    out = ledger.upsert(e.withColumn("first_event", F.col("event_id")).withColumn("o", F.col("event_id")), "posting_id", ["kind", "ts", "score"], ["ts", "o"])
    return out.select("posting_id", "profile_id", "first_event", "kind", F.round("score", 2).alias("score"), stamp("ts").alias("decided_at"))


def entries(spark, d):
    """Decisions as a ledger's entries: a reversal takes an application out; every entry has a life of its own."""
    e = A.decisions(spark, d).where(F.col("kind").isin("seen", "applied", "dismissed", "reverted"))
    e = ledger.with_expiry(e, F.when(F.col("kind") == "dismissed", 400).otherwise(240))
    back = F.col("kind") == "reverted"
    return e.select(F.when(back, "applied").otherwise(F.col("kind")).alias("kind"), F.col("posting_id").cast("string").alias("key"), F.when(back, "remove").otherwise("add").alias("op"), "ts", "event_id", "expires_at")


LAST_ENTRY = """x as (select case kind when 'reverted' then 'applied' else kind end as kind, posting_id::varchar as key, case kind when 'reverted' then 'remove' else 'add' end as op, ts, event_id, ts + to_hours(case kind when 'dismissed' then 400 else 240 end) as expires_at from decisions where kind in ('seen', 'applied', 'dismissed', 'reverted')),
l as (select * from x qualify row_number() over (partition by kind, key order by ts desc, event_id desc) = 1)"""
DAYS = ("2024-01-11", "2024-01-21")


def in_slices(rows):
    """Rows before each of DAYS, and the rest, with the time that a slice ends."""
    since = F.lit("1970-01-01").cast("timestamp")
    for day in (*DAYS, A.AS_OF):
        until = F.lit(day).cast("timestamp")
        yield rows.where((F.col("ts") >= since) & (F.col("ts") < until)), until
        since = until


@query("ledger_append", f"with {LAST_ENTRY} select kind, key, {STAMP.format('ts')} as ts, {STAMP.format('expires_at')} as expires_at from l where op <> 'remove' and expires_at > {AS_OF}", "decisions")
def _(spark, d):
    """What is in the sets of a stored ledger after three runs have appended to it."""
    store = ledger.stored_ledger(spark, shared_path(spark, "ledger"), 16)
    for part, _ in in_slices(entries(spark, d)):
        store.append(part)
    return ledger.members(store.read(), A.as_of()).select("kind", "key", stamp("ts").alias("ts"), stamp("expires_at").alias("expires_at"))


@query("ledger_compact", f"with {LAST_ENTRY} select kind, key, op, event_id, {STAMP.format('expires_at')} as expires_at from l where expires_at > {AS_OF}", "decisions")
def _(spark, d):
    """All that a stored ledger holds when each of three runs has appended to it and pruned it."""
    store = ledger.stored_ledger(spark, shared_path(spark, "ledger"), 16)
    for part, until in in_slices(entries(spark, d)):
        store.append(part)
        ledger.compact_ledger(store, until)
    return store.read().select("kind", "key", "op", "event_id", stamp("expires_at").alias("expires_at"))


@query("decision_merge", f"with {DECIDED} select f.posting_id, f.profile_id, f.event_id as first_event, l.kind, round(l.score, 2) as score, {STAMP.format('l.ts')} as decided_at from e f join e l on f.posting_id = l.posting_id and f.a = 1 and l.z = 1", "decisions")
def _(spark, d):
    """As decision_upsert, but into a stored table: three runs merge their decisions into what is there."""
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed")).withColumns({"first_event": F.col("event_id"), "o": F.col("event_id")})
    e = e.select("posting_id", "profile_id", "first_event", "kind", "score", "ts", "o")
    store = StoredTable(spark, shared_path(spark, "decisions"), e.schema, ["posting_id"], 16)
    for part, _ in in_slices(e):
        ledger.upsert_into(store, part, ("kind", "score", "ts", "o"), ["ts", "o"])
    return store.read().select("posting_id", "profile_id", "first_event", "kind", F.round("score", 2).alias("score"), stamp("ts").alias("decided_at"))


@query("backfill_stored", f"""with e as (select *, row_number() over (partition by posting_id order by kind, ts, event_id) as nth from decisions where kind in ('applied', 'dismissed'))
select 'https://history.example/' || posting_id as url, kind, event_id from e where nth = 1""", "decisions")
def _(spark, d):
    """A history put into a stored table that already has rows: only keys that are missing are added, the first row of each."""
    e = A.decisions(spark, d).select(F.concat(F.lit("https://history.example/"), F.col("posting_id").cast("string")).alias("url"), "kind", "ts", "event_id")
    store = StoredTable(spark, shared_path(spark, "history"), e.schema, ["url"], 16)
    for kind in ("applied", "dismissed"):
        ledger.insert_absent(store, e.where(F.col("kind") == kind), ["ts", "event_id"])
    return store.read().select("url", "kind", "event_id")


@query("decisions_recent", f"select event_id, posting_id, kind, {STAMP.format('ts')} as decided_at from decisions where kind in ('applied', 'dismissed') order by ts desc, event_id desc limit 50", "decisions")
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed")).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50)
    return e.select("event_id", "posting_id", "kind", stamp("ts").alias("decided_at"))


@query("newest_n_per_type", "select event_id, kind, place::int as place from (select *, row_number() over (partition by kind order by ts desc, event_id desc) as place from decisions) where place <= 50", "decisions")
def _(spark, d):
    return ledger.newest_per(A.decisions(spark, d), ["kind"], [F.col("ts").desc(), F.col("event_id").desc()], 50).select("event_id", "kind", "place")


TRANSITIONS = "t as (select event_id, posting_id, ts, status, coalesce(lag(status) over (partition by posting_id order by ts, event_id), 'open') as before from (select *, case when kind = 'reverted' then 'open' else kind end as status from decisions where kind in ('applied', 'dismissed', 'reverted')))"


@query("decision_transitions", f"with {TRANSITIONS} select event_id, posting_id, before, status from t", "decisions")
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed", "reverted"))
    return ledger.transitions(e, "posting_id").select("event_id", "posting_id", "before", "status")


@query("decision_current", f"with {TRANSITIONS} select posting_id, arg_max(status, {{'t': ts, 'e': event_id}}) as status, count(*) as changes from t group by 1", "decisions")
def _(spark, d):
    e = A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed", "reverted"))
    status = F.when(F.col("kind") == "reverted", "open").otherwise(F.col("kind"))
    return e.groupBy("posting_id").agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


@query("audit_log", f"""with {TRANSITIONS} select '{{"posting_id":' || posting_id || ',"url":"' || url || '","old_status":"' || before || '","new_status":"' || status || '","at":"' || {STAMP.format('ts')} || '"}}' as line from t join postings using (posting_id)""", "postings", "decisions")
def _(spark, d):
    e = ledger.transitions(A.decisions(spark, d).where(F.col("kind").isin("applied", "dismissed", "reverted")), "posting_id")
    rows = e.join(A.postings(spark, d).select("posting_id", "url"), "posting_id")
    line = F.struct("posting_id", "url", F.col("before").alias("old_status"), F.col("status").alias("new_status"), stamp("ts").alias("at"))
    return rows.select(F.to_json(line).alias("line"))


@query("followups_due", f"select event_id, posting_id from decisions where kind = 'applied' and abs(epoch({AS_OF})::bigint - floor(epoch(ts))::bigint - 604800) <= 72000 and posting_id not in (select posting_id from decisions where kind = 'sent' and ts > {AS_OF} - interval 4 days)", "decisions")
def _(spark, d):
    e = A.decisions(spark, d)
    return ledger.followups_due(e.where("kind = 'applied'"), e.where((F.col("kind") == "sent") & (F.col("ts") > A.as_of() - F.expr("interval 4 days"))), A.as_of(), "posting_id").select("event_id", "posting_id")


@query("aging_rows", f"select posting_id, published_at < {AS_OF} - interval 48 hours as aging from postings", "postings")
def _(spark, d):
    return A.postings(spark, d).select("posting_id", (F.col("published_at") < A.as_of() - F.expr("interval 48 hours")).alias("aging"))


@query("retry_backlog", "select posting_id, attempts, case when arg_max(kind, {'t': ts, 'e': event_id}) = 'sent' and attempts < 12 then 'pending' when attempts >= 12 then 'given_up' else 'done' end as state from (select *, count(*) over (partition by posting_id) as attempts from decisions) group by posting_id, attempts", "decisions")
def _(spark, d):
    last = A.decisions(spark, d).groupBy("posting_id").agg(F.count("*").alias("attempts"), F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    state = F.when((F.col("kind") == "sent") & (F.col("attempts") < 12), "pending").when(F.col("attempts") >= 12, "given_up").otherwise("done")
    return last.select("posting_id", "attempts", state.alias("state"))


@query("url_repair", r"""with r as (select page_id, case when page_id % 5 = 0 then 'https://www.site.example' || (page_id % 100)::varchar || '-post' when page_id % 5 = 1 then 'https://www.site.example/item/' || (page_id % 100 + 4)::varchar || '-post' else url end as url from pages)
select page_id, regexp_replace(url, '^https://www[.]site[.]example([0-9].*)$', 'https://www.site.example/item/\1') as repaired from r where regexp_matches(url, '^https://www[.]site[.]example([0-9].*)$') and regexp_replace(url, '^https://www[.]site[.]example([0-9].*)$', 'https://www.site.example/item/\1') not in (select url from r)""")
def _(spark, d):
    i = F.col("page_id")
    broken = F.concat(F.lit("https://www.site.example"), (i % 100).cast("string"), F.lit("-post"))
    right = F.concat(F.lit("https://www.site.example/item/"), (i % 100 + 4).cast("string"), F.lit("-post"))
    rows = A.table(spark, d, "pages").select("page_id", F.when(i % 5 == 0, broken).when(i % 5 == 1, right).otherwise(F.col("url")).alias("url"))
    return ledger.repair_urls(rows, "^https://www[.]site[.]example([0-9].*)$", "https://www.site.example/item/$1").select("page_id", "repaired")


BROKEN = "^https://www[.]site[.]example([0-9].*)$"


@query("url_repair_stored", rf"""with r as (select page_id, case when page_id % 5 = 0 then 'https://www.site.example' || (page_id % 100)::varchar || '-post' when page_id % 5 = 1 then 'https://www.site.example/item/' || (page_id % 100 + 4)::varchar || '-post' else url end as url from pages),
b as (select min(page_id) as page_id, to_url from (select page_id, regexp_replace(url, '{BROKEN}', 'https://www.site.example/item/\1') as to_url from r where regexp_matches(url, '{BROKEN}')) where to_url not in (select url from r) group by to_url)
select r.page_id, coalesce(b.to_url, r.url) as url from r left join b using (page_id)""")
def _(spark, d):
    """Broken urls rewritten in a stored table, of which only the buckets that hold one are written again."""
    i = F.col("page_id")
    broken = F.concat(F.lit("https://www.site.example"), (i % 100).cast("string"), F.lit("-post"))
    right = F.concat(F.lit("https://www.site.example/item/"), (i % 100 + 4).cast("string"), F.lit("-post"))
    rows = A.table(spark, d, "pages").select("page_id", F.when(i % 5 == 0, broken).when(i % 5 == 1, right).otherwise(F.col("url")).alias("url"))
    store = StoredTable(spark, shared_path(spark, "pages"), rows.schema, ["page_id"], 16)
    store.append(rows)
    ledger.repair_stored(store, "url", BROKEN, "https://www.site.example/item/$1", ["page_id"])
    return store.read()


@query("history_backfill", """with h as (select 'https://history.example/' || posting_id as url, kind, ts, event_id from decisions where kind in ('applied', 'dismissed'))
select url, arg_max(kind, {'t': ts, 'e': event_id}) as kind, count(*) as n from h group by 1""", "decisions")
def _(spark, d):
    e = A.decisions(spark, d)
    both = e.where("kind = 'applied'").unionByName(e.where("kind = 'dismissed'"))
    keyed = both.withColumn("url", F.concat(F.lit("https://history.example/"), F.col("posting_id").cast("string")))
    return keyed.groupBy("url").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n"))


# Health.


@query("failure_streak", f"""with r as (select *, error is not null as failed from feed_runs), i as (select *, sum((not failed)::int) over w as island, max(case when rows_found > 0 then ts_s end) over w as last_success from (select *, {STAMP.format('ran_at')} as ts_s from r) window w as (partition by source order by ran_at, run_id rows unbounded preceding))
select run_id, source, sum(failed::int) over (partition by source, island order by ran_at, run_id rows unbounded preceding)::bigint as failures, last_success from i""", "feed_runs")
def _(spark, d):
    got = health.streaks(A.feed_runs(spark, d), "source", ["ran_at", "run_id"], F.col("error").isNotNull(), F.col("rows_found") > 0)
    return got.select("run_id", "source", "failures", stamp("last_success").alias("last_success"))


CLASS = """case when error is not null and p and regexp_matches(lower(error), 'proxy|tunnel|503|523') then 'proxy_offline' when error is not null and regexp_matches(lower(error), '403|429|forbidden|captcha|blocked') then 'blocked' when error is not null then 'error'
  when rows_found = 0 and p and not up then 'proxy_offline' when rows_found = 0 then 'empty' else 'ok' end"""
RUNS = "c as (select run_id, source, ran_at, rows_found, case when error is not null and run_id % 3 = 0 then 'tunnel closed' when error is not null and run_id % 3 = 1 then 'timeout' else error end as error, source in ('feed1', 'feed2', 'feed3') as p from feed_runs), u as (select *, bool_or(p and rows_found > 400) over (partition by cast(ran_at as date)) as up from c)"


def classified(spark, d):
    i = F.col("run_id") % 3
    error = F.when(F.col("error").isNotNull() & (i == 0), "tunnel closed").when(F.col("error").isNotNull() & (i == 1), "timeout").otherwise(F.col("error"))
    runs = A.feed_runs(spark, d).withColumns({"error": error, "p": F.col("source").isin("feed1", "feed2", "feed3"), "day": F.to_date("ran_at")})
    up = runs.groupBy("day").agg(F.bool_or(F.col("p") & (F.col("rows_found") > 400)).alias("up"))  # a proxied feed that worked shows the proxy works
    return runs.join(up, "day").withColumn("status", health.classify(F.col("error"), F.col("rows_found"), F.col("p"), ~F.col("up")))


@query("health_classify", f"with {RUNS} select run_id, {CLASS} as status from u", "feed_runs")
def _(spark, d):
    return classified(spark, d).select("run_id", "status")


@query("health_order", f"""with {RUNS}, l as (select source, {CLASS} as status, row_number() over (partition by source order by ran_at desc, run_id desc) as i from u)
select source, status, row_number() over (order by case status when 'proxy_offline' then 1 when 'error' then 2 when 'blocked' then 3 when 'empty' then 4 else 5 end, source)::int as place from l where i = 1""", "feed_runs")
def _(spark, d):
    last = classified(spark, d).groupBy("source").agg(F.max_by("status", F.struct("ran_at", "run_id")).alias("status"))
    order = Window.partitionBy().orderBy(health.severity(F.col("status")), "source")  # one row a feed
    return last.select("source", "status", F.row_number().over(order).alias("place"))
