"""Sources and sinks: landed JSON, HTML pages, canonical rows, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import health, report
from ..operators.stages import shared_path
from ..plans import adapters as A
from ..sources import feeds, html
from ..sources.variant import first_list, string_or_object
from . import query
from .rules import PACK_SQL, RANK, REASONS_SQL, SCORE_SQL, rank_order, ranked, reasons
from .scalars import COLLAPSE, MONTHLY, SALARY_LABEL, salary_label, with_monthly

STRIP = COLLAPSE.format("replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')").replace("{{", "{").replace("}}", "}")


def pages(spark, d):
    return A.table(spark, d, "pages")


@query("feed_json_explode", "select event_id, k::int as k, k::int * 2 as twice from (select event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) as k from events)")
def _(spark, d):
    """Each event's property text stands for a landed response with a list of one item."""
    response = F.concat(F.lit('{"hits":['), "props", F.lit("]}"))
    rows = A.table(spark, d, "events").select("event_id", F.from_json(response, "hits array<struct<k:int>>").alias("r"))
    return rows.select("event_id", F.explode("r.hits").alias("item")).select("event_id", "item.k", (F.col("item.k") * 2).alias("twice"))


@query("feed_alias_paths", "select posting_id, title, case when posting_id % 3 = 2 then 'plain ' || company else company end as company from postings", "postings")
def _(spark, d):
    i = F.col("posting_id") % 3
    one = F.to_json(F.struct("title", F.struct(F.col("company").alias("name")).alias("company")))
    plain = F.to_json(F.struct("title", F.concat(F.lit("plain "), "company").alias("company")))
    body = F.when(i == 0, F.concat(F.lit('{"jobs":['), one, F.lit("]}"))).when(i == 1, F.concat(F.lit('{"jobs":[],"data":{"jobs":['), one, F.lit("]}}"))).otherwise(F.concat(F.lit('{"results":['), plain, F.lit("]}")))
    rows = A.postings(spark, d).select("posting_id", F.explode(first_list(F.try_parse_json(body), html.LIST_PATHS)).alias("v"))
    return rows.select("posting_id", F.try_variant_get("v", "$.title", "string").alias("title"), string_or_object(F.try_variant_get("v", "$.company", "variant")).alias("company"))


INNER = "list_transform(regexp_extract_all(html, '(?is)<(?:{0})(?:[ \\t\\n][^>]*)?>(.*?)</(?:{0})>', 1), lambda x: " + STRIP.format("x") + ")"


@query("html_items", f"select page_id, unnest(list_filter({INNER.format('li|p')}, lambda t: t <> '')) as item from pages")
def _(spark, d):
    return pages(spark, d).select("page_id", F.explode(html.items(F.col("html"))).alias("item"))


@query("html_links", """select page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda u: replace(replace(u, '&#x2F;', '/'), '&amp;', '&')))) as link from pages""")
def _(spark, d):
    return pages(spark, d).select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query("html_link_cards", f"""with a as (select page_id, unnest(regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>')) as a, unnest(range(len(regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>')))) as i from pages),
c as (select page_id, i, regexp_extract(a, '(?is)^<a [^>]*href="([^"]+)"', 1) as url, coalesce(nullif({STRIP.format("regexp_extract(a, '(?is)<a [^>]*>(.*?)</a>', 1)")}, ''), nullif(trim(regexp_extract(a, '(?is)^<a [^>]*title="([^"]*)"', 1)), '')) as title from a)
select page_id, title, url from c where (contains(url, '/a') or contains(url, '/e') or contains(url, '.example')) and length(title) between 5 and 200 qualify row_number() over (partition by page_id, url order by i) = 1""")
def _(spark, d):
    return pages(spark, d).select("page_id", F.explode(html.link_cards(F.col("html"), ("/a", "/e", ".example"))).alias("r")).select("page_id", "r.title", "r.url")


@query("html_first_offsite", """with l as (select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host, list_filter(list_transform(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda u: replace(replace(u, '&#x2F;', '/'), '&amp;', '&')), lambda u: regexp_matches(u, '(?i)^https?://')) as u from pages)
select page_id, list_filter(u, lambda x: lower(regexp_extract(x, '^[A-Za-z]+://([^/?#:]+)', 1)) <> host)[1] as link from l""")
def _(spark, d):
    return pages(spark, d).select("page_id", html.first_offsite(F.col("html"), F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]+)", 1)).alias("link"))


RSS = """with i as (select posting_id, unnest([{'nth': 0, 'title': title, 'region': 'Anywhere', 'at': strftime(published_at, '%Y-%m-%d %H:%M:%S')}, {'nth': 1, 'title': 'Second of ' || company, 'region': country, 'at': '2024-01-31 00:00:00'}]) as r from postings)
select posting_id, r.title as title, case r.nth when 0 then url else 'https://guid.example/' || posting_id end as url, case r.nth when 0 then 'About <b>it</b>' else '' end as description, r.region as region, r.at as at
from (select posting_id, case when r.nth = 0 then {'nth': 0, 'title': nullif(trim(r.title), ''), 'region': r.region, 'at': r.at} else r end as r from i) join postings using (posting_id) where r.title is not null"""


def rss_parts(postings):
    """The items of a feed for a posting: one with all its parts, one with a guid and a category and no date, one whose date can't be read, one without a link."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    cdata = lambda value: F.concat(F.lit("<![CDATA["), value, F.lit("]]>"))
    item = lambda *parts: tag("item", F.concat(*parts))
    first = item(tag("title", cdata(F.col("title"))), tag("link", F.col("url")), tag("description", cdata(F.lit("About <b>it</b>"))), tag("pubDate", F.date_format("published_at", "E, d MMM yyyy HH:mm:ss 'GMT'")), tag("region", F.lit("Anywhere")))
    guid = F.concat(F.lit("https://guid.example/"), F.col("posting_id").cast("string"))
    second = item(tag("title", F.concat(F.lit("Second of "), "company")), tag("guid", guid), tag("category", F.col("country")))
    broken = item(tag("title", F.lit("x")), tag("link", F.lit("y")), tag("pubDate", F.lit("soon")))
    return first, second, broken, item(tag("title", F.lit("no link")))


@query("rss_items", RSS, "postings")
def _(spark, d):
    """A feed a posting."""
    p = A.postings(spark, d)
    rows = p.select("posting_id", F.concat(F.lit("<rss>"), *rss_parts(p), F.lit("</rss>")).alias("xml"))
    got = rows.select("posting_id", F.explode(html.rss_items(F.col("xml"), A.as_of())).alias("r"))
    return got.select("posting_id", "r.title", "r.url", "r.description", "r.region", F.date_format("r.published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("rss_xml", f"with rss as ({RSS}) select title, url, description, region, rss.at as at from rss", "postings")
def _(spark, d):
    """Two landed feeds with the items of half of all postings each, of which Spark reads parts of a megabyte."""
    p = A.postings(spark, d).withColumn("half", F.pmod(F.xxhash64("posting_id"), F.lit(2)))
    at = shared_path(spark, "rss")
    p = p.withColumns({c: F.replace(c, F.lit("&"), F.lit("&amp;")) for c in ("url", "company")})
    p.select("half", F.concat(*rss_parts(p)).alias("value")).repartition(2, "half").sortWithinPartitions("half").select("value").write.text(at)
    got = feeds.rss_files(spark, at, A.as_of())
    return got.select("title", "url", "description", "region", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


CARD = f"""select page_id, i as nth, title, link from (select page_id, unnest(range(len(b))) as i, unnest(b) as x from (select page_id, b from (select page_id, regexp_extract_all(html, '(?is)<(?:li)(?:[ \\t\\n][^>]*)?>(.*?)</(?:li)>', 1) as b from pages))),
  lateral (select {STRIP.format('''coalesce(nullif(regexp_extract(x, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1), ''), regexp_extract(x, '(?is)<a [^>]*>(.*?)</a>', 1))''')} as title, regexp_extract(x, 'href="([^"]+)"', 1) as link) where length(title) >= 3 and link <> ''"""


@query("html_cards", f"select page_id, title, link from ({CARD})")
def _(spark, d):
    return pages(spark, d).select("page_id", F.explode(html.cards(F.col("html"), "li")).alias("r")).select("page_id", "r.title", F.col("r.url").alias("link"))


LD = """concat('<script type="application/ld+json">{"@type":"JobPosting","title":"post ', page_id, '","url":"/p/', page_id, '"}</script>')"""


@query("html_cascade", f"""with c as (select page_id, title, link, nth from ({CARD})) select page_id, 'cards' as strategy, title, link as url from c where page_id % 3 <> 0 and page_id % 9 not in (4, 7)
 union all select page_id, case page_id % 9 when 4 then 'state' else 'next_data' end, 'held ' || page_id, '/h/' || page_id from pages where page_id % 9 in (4, 7)
 union all select page_id, 'json_ld', 'post ' || page_id, '/p/' || page_id from pages where page_id % 3 = 0""")
def _(spark, d):
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"post '), F.col("page_id").cast("string"), F.lit('","url":"/p/'), F.col("page_id").cast("string"), F.lit('"}</script>'))
    held = F.to_json(F.array(F.struct(F.concat(F.lit("held "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("/h/"), F.col("page_id").cast("string")).alias("url"))))
    state = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"vacatures":{"items":'), held, F.lit("}};</script>"))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"jobOffers":'), held, F.lit("}}}</script>"))
    nine = F.col("page_id") % 9
    rows = pages(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("html", ld)).when(nine == 4, F.concat("html", state)).when(nine == 7, F.concat("html", page)).otherwise(F.regexp_replace("html", "(?i)<(/?)(div|article)", "<$1span")).alias("html"))
    return html.extract_records(rows).select("page_id", "strategy", "title", "url")


@query("html_jsonld", "select page_id, 'post ' || page_id as title, '/p/' || page_id as url, 'Firm ' || (page_id % 7) as company, case page_id % 2 when 0 then 'Town ' else 'Region ' end || (page_id % 5) as location, '2024-01-' || lpad((page_id % 28 + 1)::varchar, 2, '0') as date_posted from pages")
def _(spark, d):
    i, five = F.col("page_id"), (F.col("page_id") % 5).cast("string")
    item = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("post "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("url"), F.struct(F.concat(F.lit("Firm "), (F.col("page_id") % 7).cast("string")).alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.when(i % 2 == 0, F.concat(F.lit("Town "), five)).alias("addressLocality"), F.concat(F.lit("Region "), five).alias("addressRegion")).alias("address")).alias("jobLocation"), F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("datePosted")))
    page = F.concat("html", F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">['), item, F.lit("]</script>"))
    return pages(spark, d).select("page_id", F.explode(html.json_ld(page)).alias("r")).select("page_id", "r.title", "r.url", "r.company", "r.location", "r.date_posted")


@query("main_text", f"""with b as (select page_id, list_filter({INNER.format('div|section|article')}, lambda t: length(t) > 200) as blocks, list_filter({INNER.format('p')}, lambda t: length(t) > 80) as ps from pages)
select page_id, sha256(coalesce(list_sort(list_transform(blocks, lambda t: {{'n': length(t), 't': t}}), 'DESC')[1].t, nullif(array_to_string(ps, ' '), ''))) as text_sha from b""")
def _(spark, d):
    return pages(spark, d).select("page_id", F.sha2(html.main_text(F.col("html")), 256).alias("text_sha"))


@query("post_parse", f"""with l as (select posting_id, company || ' (note) | ' || country || ' | ' || work_mode as line, company, country, work_mode from postings)
select posting_id, trim(company) as company, country as location, work_mode as mode from l""", "postings")
def _(spark, d):
    line = F.concat("company", F.lit(" (note) | "), "country", F.lit(" | "), "work_mode")
    return A.postings(spark, d).select("posting_id", html.post_parse(line).alias("p")).select("posting_id", "p.company", "p.location", "p.mode")


@query("detail_enrich", """select posting_id, case when posting_id % 4 = 0 then substring(p.description, 1, 60) when length(p.description) > 60 then p.description else substring(p.description, 1, 60) end as description, posting_id % 4 = 0 as partial from postings p""", "postings")
def _(spark, d):
    p = A.postings(spark, d)
    listing = p.select("posting_id", F.substring("description", 1, 60).alias("description"))
    detail = p.select(F.when(F.col("posting_id") % 4 != 0, F.col("posting_id")).alias("posting_id"), "description")
    return feeds.enrich(listing, detail, "posting_id")


def raw_items(spark, d):
    """Postings as two feeds would land them, with alias names of their own."""
    p = A.postings(spark, d)
    a = p.where("work_mode = 'remote'").select(F.struct("posting_id", F.col("title").alias("jobTitle"), F.col("url").alias("link"), F.col("company").alias("companyName")).alias("item"))
    b = p.where("work_mode <> 'remote'").select(F.struct("posting_id", F.when(F.col("posting_id") % 10 == 1, "").otherwise(F.col("title")).alias("name"), "url", "company", F.unix_timestamp("published_at").alias("epoch")).alias("item"))
    return a, b


FEED_A = feeds.Feed("feed-a", 1, "jobs array<struct<jobTitle:string,link:string,companyName:string>>", "jobs", {"title": ("jobTitle",), "url": ("link",), "company": ("companyName",)})


def feed_b():
    return feeds.Feed("feed-b", 2, "data array<struct<name:string,url:string,company:string,epoch:long>>", "data", {"title": ("name",), "url": ("url",), "company": ("company",)}, F.timestamp_seconds("item.epoch"))


def canonical(spark, d):
    a, b = raw_items(spark, d)
    return feeds.union([FEED_A.canonical(a, A.as_of()), feed_b().canonical(b, A.as_of())])


CANON = """(select case when work_mode = 'remote' then 'feed-a' else 'feed-b' end as source, case when work_mode = 'remote' then 1 else 2 end as source_priority, url, nullif(trim(title), '') as title, nullif(trim(company), '') as company,
  case when work_mode = 'remote' then '2024-01-31 00:00:00' else strftime(published_at, '%Y-%m-%d %H:%M:%S') end as published_at from postings where nullif(trim(title), '') is not null and not (work_mode <> 'remote' and posting_id % 10 = 1))"""


@query("canonical_postings", f"select * from {CANON}", "postings")
def _(spark, d):
    return canonical(spark, d).select("source", "source_priority", "url", "title", "company", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


#: Responses a line: with a list, with a broken one, without any, with an empty one.
BODY = {0: "'{\"jobs\":[{\"id\":' || posting_id || '},{\"id\":-1}]}'", 1: "'{\"jobs\":[{\"id\":' || posting_id", 2: "'{\"error\":\"' || source || '\"}'", 3: "'{\"jobs\":[]}'"}
LANDED = feeds.Feed("landed", 1, "jobs array<struct<id:bigint>>, error string", "jobs", {"title": ("id",)}, lines=True)


def landed_responses(spark, d):
    at = shared_path(spark, "responses")
    i = F.col("posting_id")
    body = F.expr("case posting_id % 4 " + " ".join(f"when {k} then {v}" for k, v in BODY.items()) + " end")
    A.postings(spark, d).select(i, "source", body.alias("value")).select("value").write.text(at)
    return LANDED.responses(spark, at)


@query("feed_quarantine", f"select 'landed' as feed, case posting_id % 4 when 1 then {BODY[1]} end as raw, case posting_id % 4 when 1 then 'malformed' else 'no list' end as reason from postings where posting_id % 4 in (1, 2)", "postings")
def _(spark, d):
    """Responses that were landed broken or without a list."""
    return LANDED.quarantine(landed_responses(spark, d)).select("feed", "raw", "reason")


@query("feed_landed_items", "select unnest([posting_id, -1]) as id from postings where posting_id % 4 = 0", "postings")
def _(spark, d):
    """Items of the responses beside those."""
    return LANDED.explode(LANDED.good(landed_responses(spark, d))).select("item.id")


@query("feed_run_counts", f"""with r as (select 'landed' as source, count(*) as responses, count(*) filter (posting_id % 4 in (1, 2)) as broken, (2 * count(*) filter (posting_id % 4 = 0))::bigint as rows_found from postings)
select *, case when rows_found = 0 then 'empty' else 'ok' end as status from r""", "postings")
def _(spark, d):
    """What the health report reads of that run."""
    counts = LANDED.run_counts(landed_responses(spark, d))
    return counts.select("source", "responses", "broken", "rows_found", health.classify(F.col("error"), F.col("rows_found"), F.lit(False), F.lit(False)).alias("status"))


@query("feed_union", f"select source, count(*) as n from {CANON} group by 1", "postings")
def _(spark, d):
    return canonical(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("feed_select", "select posting_id, source from postings where source in ('src1', 'src3', 'src5')", "postings")
def _(spark, d):
    config = spark.createDataFrame([(f"src{i}", i % 2) for i in range(20)], "source string, fast int").select("source")
    return feeds.select_feeds(A.postings(spark, d), config, only=("src1", "src2", "src3", "src5"), exclude=("src2",)).select("posting_id", "source")


@query("feed_coverage", "select source from (select distinct source from postings) where source not in ('src1', 'src2', 'src3')", "postings")
def _(spark, d):
    config = spark.createDataFrame([("src1",), ("src2",), ("src3",)], "source string")
    return A.postings(spark, d).select("source").distinct().exceptAll(config)


def top(spark, d, n):
    return ranked(spark, d).orderBy(*rank_order()).limit(n)


@query("rank_matches", f"select posting_id, score, row_number() over (order by {RANK})::int as place from (select *, {SCORE_SQL} as score from postings where {PACK_SQL} is null) qualify place <= 100", "postings")
def _(spark, d):
    """Places of the best hundred; ranked on the bounded rest that a top-k leaves."""
    from pyspark.sql import Window

    return top(spark, d, 100).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*rank_order()))).select("posting_id", "score", "place")


@query("report_table", f"select '| ' || concat_ws(' | ', replace(title, '|', '\\|'), replace(company, '|', '\\|'), country, work_mode, coalesce(experience_min::varchar, 'n/a'), score::varchar) || ' |' as line from (select *, {SCORE_SQL} as score from postings where {PACK_SQL} is null) order by {RANK} limit 20", "postings")
def _(spark, d):
    return top(spark, d, 20).select(report.markdown_row(*[F.col(c) for c in ("title", "company", "country", "work_mode", "experience_min", "score")]).alias("line"))


@query("report_details", f"""with {MONTHLY}, t as (select *, row_number() over (order by {RANK})::int as place from (select *, {SCORE_SQL} as score, {REASONS_SQL} as reasons from postings where {PACK_SQL} is null) qualify place <= 5),
w as (select t.*, s.fraud_score, (select {SALARY_LABEL} from e where e.posting_id = t.posting_id) as label from t join model_scores s using (posting_id))
select place, unnest(range(7))::int as nth, unnest(['## ' || title || ' — ' || company, '- Link: ' || url, '- Match score: ' || score || '%', '- Place: ' || country || ', ' || work_mode, '- Why it fits: ' || reasons, '- Salary: ' || label, '- Fraud risk: ' || fraud_score || '% ' || case when fraud_score >= 40 then '⚠️' else '✓' end]) as line from w""", "postings", "model_scores", "rates")
def _(spark, d):
    """What the report says of each of the best five: where it is, why it fits, what it pays, how risky it is."""
    from pyspark.sql import Window

    best = top(spark, d, 5).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*rank_order()))).select("place", "posting_id", "score")
    # Salary, reasons and risk are worked out for the five alone.
    rows = with_monthly(spark, d).join(best, "posting_id").join(A.model_scores(spark, d).select("posting_id", "fraud_score"), "posting_id")
    c = F.col
    return report.details(rows, "place", report.match_lines(c("title"), c("company"), c("url"), c("score"), c("country"), c("work_mode"), reasons(), salary_label(), c("fraud_score")))


@query("slim_matches", f"select posting_id, '' as description, substring(title, 1, 20) as title, array_to_string(string_split(title, ' ')[1:3], ' ') as words from postings", "postings")
def _(spark, d):
    p = A.postings(spark, d).select("posting_id", "description", "title", F.split("title", " ", -1).alias("words"))
    return report.slim(p, {"title": 20}, ("description",), {"words": 3}).select("posting_id", "description", "title", F.array_join("words", " ").alias("words"))
