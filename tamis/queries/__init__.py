"""Registered queries: each has a Spark callable and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The adapter views of tamis.plans.adapters as SQL.
VIEWS = {
    "n": "select (select count(*) from pages) np, (select count(*) from supplier) ns, (select count(*) from part) npt",
    "postings": """select d.doc_id as posting_id, d.doc_id as ingest_ordinal, d.source, cast(d.doc_id % 8 + 1 as int) as source_priority, g.url,
  substring(split_part(d.text, chr(10), 1), 1, 60) as title,
  s.s_name || case cast(d.doc_id % 4 as int) when 0 then '' when 1 then ' GmbH' when 2 then ' GmbH & Co. KG' else ' SAS' end as company,
  t.n_name as country, case cast(d.doc_id % 3 as int) when 0 then 'remote' when 1 then 'hybrid' else 'on-site' end as work_mode,
  d.lang as language, d.text as description,
  case when d.doc_id % 5 = 0 then null else cast(d.doc_id % 10 as int) end as experience_min,
  case when d.doc_id % 7 = 0 then null else p.p_retailprice * 40 end as salary_yearly_min,
  case cast(d.doc_id % 5 as int) when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' when 3 then 'CHF' else 'XXX' end as salary_currency,
  d.doc_id % 6 = 0 as offers_relocation, timestamp '2024-01-30 00:00:00' - to_hours(cast(d.doc_id % 240 as int)) as published_at
from documents d cross join n join pages g on g.page_id = d.doc_id % n.np join supplier s on s.s_suppkey = d.doc_id % n.ns
join part p on p.p_partkey = d.doc_id % n.npt join nation t on t.n_nationkey = s.s_nationkey""",
    "decisions": """select event_id, ts, user_id as profile_id, cast(event_id % (select count(*) from documents) as bigint) as posting_id,
  case event_type when 'purchase' then 'applied' when 'error' then 'dismissed' when 'click' then 'seen' when 'view' then 'sent' else 'reverted' end as kind,
  value as score from events""",
    "feed_runs": """select event_id as run_id, ts as ran_at, 'feed' || cast(user_id % 47 as varchar) as source,
  case when event_type in ('error', 'signup') then 0 else cast(floor(value) as int) end as rows_found,
  case event_type when 'error' then 'HTTP 403 forbidden' else null end as error from events""",
    "model_scores": """select d.doc_id as posting_id,
  case when l.doc_id is null then null when l.quality = 1 then cast(50 + d.doc_id % 51 as int) else cast(d.doc_id % 55 as int) end as model_score,
  coalesce(l.toxic = 1, false) as model_veto, cast(d.doc_id * 7 % 101 as int) as fraud_score
from documents d left join labels l on l.doc_id = d.doc_id""",
    "rates": "select * from (values ('EUR', 1.0::double), ('USD', 0.88::double), ('GBP', 1.16::double), ('CHF', 1.04::double)) r(currency, rate)",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the adapter views, and common table expressions of its own, in front."""
    needed = [v for v in VIEWS if v in names or v == "n" and "postings" in names]
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in needed)
    sql = sql.strip()
    if not views:
        return sql
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"


def query(name: str, sql: str | None = None, *views: str):
    """Register a query (spark, sf_dir) -> DataFrame under a name, with its SQL over the given adapter views."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views)
        return f

    return register


def load() -> None:
    """Import all modules that register queries."""
    from . import aggregates, feeds, ledgers, rules, runs, scalars, streams  # noqa: F401
